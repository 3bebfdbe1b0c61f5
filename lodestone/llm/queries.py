"""The queries of this subpackage for ``__spark_entry__`` and their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chat import format_chats
from lodestone.llm.decontaminate import contamination
from lodestone.llm.filter_audit import audit_filters
from lodestone.llm.importance import importance_ranks
from lodestone.llm.licenses import scan_licenses
from lodestone.llm.mixture import mix_sources, token_count
from lodestone.llm.ngram_join import ngram_components
from lodestone.llm.onebit import nearest_vectors
from lodestone.llm.sharding import shard_records
from lodestone.llm.spotsigs import fingerprint_edits
from lodestone.llm.substrings import remove_repeats
from lodestone.llm.toxicity import toxicity
from lodestone.llm.url_rules import PATTERN_RULES, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(_table(spark, sf_dir, "documents"), n_shards=24, carry=["doc_id"])


#: Target weights of the mixture's tree; what isn't named has weight 1.
WEIGHTS = {"domain": {"domain0": 4.0, "domain2": 2.0}, "lang": {"en": 3.0, "de": 1.5}, "source": {"src0": 0.5, "src1": 2.0}}


def op4_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), weights=WEIGHTS)
    return mixed.select(
        "doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), token_count(F.col("text")).alias("n_tokens")
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the places of the hit words in the original texts, in code points: ``12-80,95-140``."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), window=13, texts=False)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least_words=20)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def _dealt(name: str, level: str, nodes: str, parent: str) -> str:
    """One level of budgets: nodes with ``room`` and ``budget`` in, with ``given`` out."""
    weight = "".join(f" WHEN node = '{n}' THEN {w}::DOUBLE" for n, w in WEIGHTS[level].items())
    return f"""
{name}_w AS (SELECT *, CASE{weight} ELSE 1.0::DOUBLE END AS weight FROM {nodes}),
{name}_l AS (SELECT *, (budget - coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY room / weight, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
               / sum(weight) OVER (PARTITION BY {parent} ORDER BY room / weight, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}_w),
{name} AS (SELECT *, least(room, coalesce(max(CASE WHEN level * weight <= room THEN level END) OVER (PARTITION BY {parent}), 'infinity'::DOUBLE) * weight) AS given FROM {name}_l)"""


_OP4 = rf"""
WITH d AS (SELECT doc_id, lang, source, 'domain' || CAST(('0x' || substr(md5(coalesce(source, '')), 1, 8))::UBIGINT % 4 AS VARCHAR) AS domain,
             coalesce(lang, '') AS l, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
leaf AS (SELECT domain, l, s, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * 2 AS DOUBLE) AS room FROM d GROUP BY ALL),
n1 AS (SELECT 0 AS root, domain AS node, domain, sum(room) AS room, (SELECT CAST(sum(tokens) AS DOUBLE) FROM leaf) AS budget FROM leaf GROUP BY domain),
{_dealt("g1", "domain", "n1", "root")},
n2 AS (SELECT leaf.domain, l, l AS node, sum(leaf.room) AS room, any_value(given) AS budget FROM leaf JOIN g1 USING (domain) GROUP BY leaf.domain, l),
{_dealt("g2", "lang", "n2", "domain")},
n3 AS (SELECT leaf.domain, leaf.l, s, s AS node, tokens, leaf.room, given AS budget FROM leaf JOIN g2 ON g2.domain = leaf.domain AND g2.l = leaf.l),
{_dealt("g3", "source", "n3", "domain, l")},
p AS (SELECT domain, l, s, goal // tokens AS whole, goal % tokens AS rest
      FROM (SELECT *, CAST(floor(given + 1e-6) AS BIGINT) AS goal FROM g3 WHERE tokens > 0)),
k AS (SELECT d.*, whole, rest, md5('23|' || whole || '|' || doc_id) AS key FROM d JOIN p USING (domain, l, s)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY key) AS through FROM k),
t AS (SELECT *, whole + CASE WHEN rest > 0 AND through <= rest THEN 1 ELSE 0 END AS times FROM r)
SELECT doc_id, domain, lang, source, CAST(unnest(range(0, times)) AS BIGINT) AS epoch, CAST(tokens AS BIGINT) AS n_tokens FROM t
"""

#: Every pattern rule against every url, with no index.
_PATTERNS = ", ".join(f"({i}, '{r.name}', '{r.verdict}', '{r.host}', '{r.path}')" for i, r in enumerate(PATTERN_RULES))

_OP5 = rf"""
WITH p AS (SELECT page_id, coalesce(substr(url, CASE WHEN instr(url, '://') > 0 THEN instr(url, '://') + 3 ELSE length(url) + 1 END), '') AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule, h, pre, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
                                    ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
f AS (SELECT q.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
      FROM q LEFT JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.pre)),
w(nth, name, ruling, h, pre) AS (VALUES {_PATTERNS}),
s AS (SELECT DISTINCT host, path FROM f WHERE k = 1 AND rule IS NULL),
m AS (SELECT host, path, min_by(name, nth) AS name, min_by(ruling, nth) AS ruling FROM s JOIN w
      ON (w.h = '' OR regexp_matches(s.host, w.h)) AND (w.pre = '' OR regexp_matches(s.path, w.pre)) GROUP BY host, path)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.verdict, m.ruling, 'allow') AS verdict, CASE WHEN f.rule IS NULL THEN m.name END AS pattern_rule
FROM f LEFT JOIN m ON f.rule IS NULL AND m.host = f.host AND m.path = f.path WHERE f.k = 1
"""

_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + least(len(ws), 5) - 1], ' ') AS t
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(doc_id, y) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT doc_id, min(y) AS least_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS t
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS t
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, k WHERE len(ws) >= k)),
h AS (SELECT doc_id, item_id, s, dw.k AS k FROM dw JOIN iw ON dw.k = iw.k AND dw.t = iw.t),
hp AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h)),
p AS (SELECT doc_id, count(*) AS n_hit FROM hp GROUP BY doc_id),
o AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: length(w)) AS wl,
             list_transform(regexp_split_to_array(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda g: length(g)) AS gl
      FROM documents WHERE doc_id IN (SELECT doc_id FROM hp)),
run AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hp) GROUP BY doc_id, run),
sp AS (SELECT doc_id, string_agg(CAST(list_sum(gl[1:a]) + coalesce(list_sum(wl[1:a - 1]), 0) AS BIGINT) || '-' || CAST(list_sum(gl[1:b]) + list_sum(wl[1:b]) AS BIGINT), ',' ORDER BY a) AS spans
       FROM run JOIN o USING (doc_id) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN sp USING (doc_id)
"""

_OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS t FROM win),
f AS (SELECT t, min(doc_id) AS m FROM k GROUP BY t),
hit AS (SELECT k.doc_id, unnest(range(k.s, k.s + 13)) AS p FROM k JOIN f USING (t) WHERE f.m < k.doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM hit GROUP BY doc_id),
j AS (SELECT w.doc_id, w.ws, coalesce(g.ps, []) AS ps FROM w LEFT JOIN gone g USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM j
"""

#: The registers that a byte leaves of CRC-32, from the CRCs of single bytes.
_REGISTERS = ", ".join(str(zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000) for i in range(256))

_OP11 = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
      UNION ALL SELECT 't', NULL, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS (SELECT side, r, array_to_string(ws[i:i + k - 1], ' ') AS f FROM (SELECT side, r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) n(k) WHERE len(ws) >= k)),
n AS MATERIALIZED (SELECT side, r, f, count(*) AS n FROM g GROUP BY ALL),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT)),
                                  lambda c, y: xor(c >> 8, [{registers}][(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT f FROM n)),
c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM n JOIN b USING (f) GROUP BY bucket),
a AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ()) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c),
v AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN b USING (f) JOIN a USING (bucket) WHERE side = 'd' GROUP BY r),
z AS (SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM w LEFT JOIN v USING (r) WHERE side = 'd'),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM k
""".replace("{registers}", _REGISTERS)

#: Every document against every step of every order.
_OP12 = r"""
WITH RECURSIVE l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        map {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(x),
             'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)} AS fails
      FROM t LEFT JOIN l USING (doc_id)),
o AS (SELECT '' AS o UNION ALL SELECT o || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE instr(o, c) = 0),
s AS (SELECT o AS filter_order, k AS step, substr(o, k, 1) AS c, string_split(substr(o, 1, k - 1), '') AS earlier, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: y <> substr(o, k, 1)) AS others
      FROM o, range(1, 6) r(k) WHERE length(o) = 5),
m AS (SELECT f.part, f.good, f.toxic, s.filter_order, s.step, s.c, f.fails[s.c] AS fail,
             len(list_filter(s.earlier, lambda y: y <> '' AND f.fails[y])) > 0 AS gone, len(list_filter(s.others, lambda y: f.fails[y])) = 0 AS clean FROM f, s),
g AS (SELECT part, filter_order, step, c, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (NOT gone AND fail) AS removed, count(*) FILTER (gone AND fail) AS redundant,
             count(*) FILTER (fail AND clean) AS unique_fails, count(*) FILTER (NOT gone AND fail AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fail AND toxic = 1) AS toxic_lost
      FROM m GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM g
"""

#: All pairs; the operator's result is that of the bound's chance of failing apart.
_OP13 = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_spotsigs": op2_spotsigs,
        "op3_sharding": op3_sharding,
        "op4_source_mixture": op4_source_mixture,
        "op5_url_rules": op5_url_rules,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_license_scan": op7_license_scan,
        "op8_decontamination": op8_decontamination,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_chat_format": op10_chat_format,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_filter_audit": op12_filter_audit,
        "op13_nearest_vectors": op13_nearest_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mixture": _OP4,
        "op5_url_rules": _OP5,
        "op6_ngram_jaccard_join": _OP6,
        "op8_decontamination": _OP8,
        "op9_substring_dedup": _OP9,
        "op11_importance_resampling": _OP11,
        "op12_filter_audit": _OP12,
        "op13_nearest_vectors": _OP13,
    }
