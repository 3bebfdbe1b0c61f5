"""URL filtering with pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over the host, one over the path, or both, and the literal tokens
that any url it fits must hold whole.  One pass over the urls counts the tokens that rules name; each rule
is then filed under its rarest one.  A url's own tokens fetch the rules filed under them, and only those run
their expressions.  Rules without a token always run.

Up to ``max_table_rules`` rules are a constant hash table that travels with the plan, and all is one projection: no
shuffle, no Python, only the url column is read.  Rule banks beyond that are a table themselves: the urls' tokens are joined
with the filed ones, and each url's fitting rules come back by its number.  Both ways give the same verdicts.

Host and path: the host is what stands after the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased; the path what follows up to ``?``, ``#`` or the end.

* A ``SiteRule`` (``host/path``) fits its host and all its subdomains where the url's
  path starts with the rule's; the longest that fits decides.
* Where none fits, the first ``PatternRule`` in order that fits decides, and else ``default``.

Defined results: a null url, or one without ``://``, has an empty host and path
and gets the default verdict; repeated rows are each judged.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import ascii_lower

MAX_TABLE_RULES = 20_000
_TOKEN = "[0-9A-Za-z]+"


@dataclass(frozen=True)
class SiteRule:
    site: str
    verdict: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.site.partition("/")[2] if "/" in self.site else ""

    def expressions(self) -> tuple[str, str]:
        """Over the host, and over the path."""
        return rf"(?s)\A(?:.*\.)?{_quoted(self.host)}\z", rf"\A{_quoted(self.path)}"

    def tokens(self) -> list[str]:
        """Whole tokens; one that ends the path may go on in the url."""
        open_end = re.search(f"{_TOKEN}$", self.path)
        return re.findall(_TOKEN, self.host) + re.findall(_TOKEN, self.path[: open_end.start()] if open_end else self.path)


@dataclass(frozen=True)
class PatternRule:
    """``host`` and ``path`` are expressions (empty: any); ``literals`` are whole tokens of any url they fit."""

    name: str
    verdict: str
    host: str = ""
    path: str = ""
    literals: tuple[str, ...] = ()

    def expressions(self) -> tuple[str, str]:
        return self.host, self.path

    def tokens(self) -> list[str]:
        return list(self.literals)


SITE_RULES = (
    SiteRule("com/en/", "block"),
    SiteRule("example.com/en/7", "allow"),
    SiteRule("net/de/", "allow"),
    SiteRule("example.net/de/8", "block"),
    SiteRule("org/es/", "block"),
)
#: Kinds of unwanted sites, and the words that stand in their host names between dots and hyphens.
HOST_WORDS = {
    "adult": "adult porn porno xxx sex sexcam webcams escort escorts hentai nude nudes milf fetish camgirl camgirls erotik erotica swingers hookup striptease onlyadults",
    "gambling": "casino bet bets betting poker roulette slots jackpot lottery lotto bingo gambling sportsbook blackjack wetten baccarat bookmaker spielbank kasino freespins apuestas",
    "pills": "pills pharmacy viagra cialis levitra tramadol xanax steroids weightloss pharma apotheke pillen ozempic diet slimming testosterone hgh modafinil farmacia pharmacie kamagra",
    "warez": "warez torrent torrents crack cracks keygen serials nulled pirate piracy streamripper iptv megaupload fullfilms moviez mp3free apkmod activators rom roms",
    "ads": "adserver adservice ads banner banners doubleclick popunder clicktrack affiliate affiliates adnetwork adsystem adclick adtrack popads sponsored openx adtech",
    "tracking": "tracker tracking telemetry beacon fingerprinting analytics pixelserver pixel metrics stats counter hitcounter webstats tagmanager",
    "malware": "malware phishing trojan botnet ransomware exploitkit spyware adware scareware keylogger stealer dropper fakeupdate driveby",
    "spam": "spam spamfarm linkfarm seofarm doorway splog autoblog backlinks contentfarm linkbuilding pbn guestposts articlespinner traffic bulkmail massmail",
    "loans": "payday loans quickloan cashadvance debtrelief kredite forex binaryoptions cryptodouble microloan creditrepair moneyfast getrich pyramid ponzi airdrop",
    "fakes": "replica replicas fakewatches knockoff counterfeit fakeid fakedocs clonecards dumps cvv superclone repwatches fakepass",
}
#: Kinds of pages without prose, and the whole path segments that lead to them.
PATH_WORDS = {
    "account": "login logout signin signout signup register account password checkout cart basket wishlist logon auth oauth sso profile settings myaccount forgot",
    "listing": "search tag tags category categories archive archives sitemap feed rss print calendar results browse index directory latest popular trending author authors page",
    "transfer": "download downloads torrent torrents upload uploads attachment attachments",
    "machine": "cgi-bin wp-admin wp-login wp-json xmlrpc api graphql ajax",
}


def _word_rules() -> tuple[PatternRule, ...]:
    """No group repeats, so that very long urls need no deep stack."""
    rules = [
        PatternRule(f"{kind}-host:{word}", "block", host=rf"(?s)\A(?:.*[.\-])?{word}(?:-[-0-9a-z]*)?[.]", literals=(word,)) for kind, words in HOST_WORDS.items() for word in words.split()
    ]
    rules += [
        PatternRule(f"{kind}-path:{word}", "block", path=rf"(?s)\A/(?:.*/)?{word.replace('-', '[-]')}(?:/|\z)", literals=tuple(word.split("-"))) for kind, words in PATH_WORDS.items() for word in words.split()
    ]
    return tuple(rules)


#: The first that fits decides.
PATTERN_RULES = (
    PatternRule("spam-farm", "block", host=r"(?s)\A(?:.*[.])?spam-farm[.]", literals=("spam", "farm")),
    PatternRule("pills", "block", host=r"(?s)\A(?:.*[.])?cheap-pills[.]", literals=("cheap", "pills")),
    PatternRule("bets", "block", host=r"(?s)\A(?:.*[.])?free-bets[.]", literals=("free", "bets")),
    PatternRule("ad-tracker", "block", host=r"(?s)\A(?:.*[.])?ads?-track(?:er|ing)?[.]"),
    *_word_rules(),
)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)


def url_host(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat(host, F.lit("/"), path), F.lit(f"({_TOKEN})"), F.lit(1)))


def token_counts(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``token, count``: in how many urls each wanted token occurs."""
    found = parts.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    return found.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def _listed(beside: DataFrame, values: list, kind: str, name: str) -> DataFrame:
    """A table with a row a value of a list, made by the JVM from one literal."""
    return beside.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), kind)).alias(name))


def _rarest(tokens: list[str], counts: dict[str, int]) -> str | None:
    return min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else None


def _entries(rules: list[tuple[str, object, int]], counts: dict[str, int]) -> list[dict]:
    """Every rule with the token it is filed under (none: it always runs)."""
    out = []
    for kind, rule, rank in rules:
        host, path = rule.expressions()
        name = rule.site if kind == "site" else rule.name
        out.append({"token": _rarest(rule.tokens(), counts), "kind": kind, "rank": rank, "name": name, "verdict": rule.verdict, "host": host, "path": path})
    return out


_RULE = "struct<token: string, kind: string, rank: int, name: string, verdict: string, host: string, path: string>"


def _fits(rule: Column, host: Column, path: Column) -> Column:
    """Only the expressions that a rule has run."""
    return ((rule["host"] == "") | F.regexp_like(host, rule["host"])) & ((rule["path"] == "") | F.regexp_like(path, rule["path"]))


def _by_table(parts: DataFrame, entries: list[dict]) -> DataFrame:
    """``fits`` by a constant hash table: slots of rules by the CRC of their token."""
    n_slots = 2 * len(entries) + 1
    slots: list[list[dict]] = [[] for _ in range(n_slots)]
    for entry in entries:
        if entry["token"] is not None:
            slots[zlib.crc32(entry["token"].encode()) % n_slots].append(entry)
    table = F.from_json(F.lit(json.dumps(slots)), f"array<array<{_RULE}>>")
    always = F.from_json(F.lit(json.dumps([e for e in entries if e["token"] is None])), f"array<{_RULE}>")
    fetched = F.flatten(
        F.transform(
            url_tokens(F.col("host"), F.col("path")),
            lambda t: F.filter(F.element_at(table, (F.crc32(t) % n_slots + 1).cast("int")), lambda r: r["token"] == t),
        )
    )
    return parts.withColumn("fits", F.filter(F.concat(fetched, always), lambda r: _fits(r, F.col("host"), F.col("path"))))


def _by_join(parts: DataFrame, entries: list[dict]) -> DataFrame:
    """``fits`` by joins: of each url's distinct host and path, tokens meet the rules filed under them.

    A token that a third of all urls hold meets few rules, since rules are filed under their rarest token; adaptive execution splits what is skewed.
    """
    bank = _listed(parts, entries, f"array<{_RULE}>", "rule").select("rule.token", "rule")
    always = F.from_json(F.lit(json.dumps([e for e in entries if e["token"] is None])), f"array<{_RULE}>")
    sites = parts.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    asked = sites.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(bank.filter("token is not null"), "token")
    hits = asked.filter(_fits(F.col("rule"), F.col("host"), F.col("path"))).groupBy("host", "path").agg(F.collect_list("rule").alias("held"))
    joined = parts.join(hits, ["host", "path"], "left")
    rest = F.filter(always, lambda r: _fits(r, F.col("host"), F.col("path")))
    return joined.withColumn("fits", F.concat(F.coalesce("held", F.array().cast(f"array<{_RULE}>")), rest)).drop("held")


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    site_rules: tuple[SiteRule, ...] = SITE_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
    default: str = "allow",
    max_table_rules: int = MAX_TABLE_RULES,
) -> DataFrame:
    """``key, host, path, rule, verdict, pattern_rule`` for every row; any number of rules."""
    parts = pages.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rules = [("site", r, len(r.site)) for r in site_rules] + [("pattern", r, -i) for i, r in enumerate(pattern_rules)]
    few = len(rules) <= max_table_rules
    wanted = sorted({t for _, r, _ in rules for t in r.tokens()})
    counts: dict[str, int] = {}
    if wanted:
        asked = _listed(pages, wanted, "array<string>", "token")
        counted = token_counts(parts, F.broadcast(asked) if few else asked)
        counts = {r["token"]: r["count"] for r in counted.collect()}  # a row a token of the rules, which the driver holds anyway
    entries = _entries(rules, counts)
    best = lambda kind: F.array_max(
        F.transform(F.filter("fits", lambda r: r["kind"] == kind), lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict")))
    )
    judged = (_by_table if few else _by_join)(parts, entries).withColumns({"site": best("site"), "pattern": best("pattern")})
    return judged.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("site.name").alias("rule"),
        F.coalesce("site.verdict", "pattern.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("pattern.name")).alias("pattern_rule"),
    )
