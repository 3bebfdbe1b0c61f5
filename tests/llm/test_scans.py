"""Toxicity, decontamination, license and url scans, and chat formatting, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, licenses
from lodestone.llm.decontaminate import contamination, drop_contaminated
from lodestone.llm.toxicity import drop_toxic, toxicity
from lodestone.llm.url_rules import PATTERN_RULES, PatternRule, SiteRule, judge_urls

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall((text or "").encode().lower())


def brute_contamination(rows, items, window=10):
    owners = {}
    for item, text in items:
        words = plain(text)
        for s in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(tuple(words[s : s + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        words, hit, found = plain(text), set(), set()
        for size in {len(w) for w in owners}:
            for s in range(len(words) - size + 1):
                held = owners.get(tuple(words[s : s + size]))
                if held:
                    hit.update(range(s, s + size))
                    found |= held
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short question?"), (3, None), (4, "..."), (10, "short QUESTION"), (5, "漢字 mixed")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, documents, awkward, block_bytes):
    rows = [
        *awkward, (20, "x Beta-gamma, delta epsilon zeta eta theta iota kappa lambda! mu and more"), (21, "a short question here; short question"),
        (22, "alpha beta gamma delta epsilon zeta eta theta iota"), (23, "shorter questions short questioning"),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(documents(rows), items, block_bytes=block_bytes, offsets=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(rows, ITEMS)
    docs = documents(rows).withColumn("hit_words", F.lit(3)).withColumn("items", F.lit("i"))
    clean = drop_contaminated(docs, items, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in brute_contamination(rows, ITEMS) if not r[5])


def test_contamination_offsets(spark, documents):
    text = "Ünï says: SHORT, question? yes"
    row = contamination(documents([(1, text)]), spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["SHORT, question"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(documents([(1, text)]), none).first()["n_hit"] == 0
    assert contamination(documents([]), none).count() == 0


def test_training_is_bounded(spark, documents):
    """Rows that repeat an id are one document, and texts beyond the bound of bytes aren't learned from."""
    from lodestone.llm.toxicity import train

    rows = [(i, f"{'scum' if i % 3 == 0 else 'moss'} and word{i} here " * 3) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    once, often = train(documents(rows), labels), train(documents(rows + [rows[1]] * 3000 + [rows[3]] * 3000), labels)
    assert (once.at == often.at).all() and (once.weights == often.weights).all() and once.bias == often.bias
    assert train(documents(rows), labels, max_bytes=10).bias is None
    assert train(documents(rows), labels, max_bytes=400).bias not in (None, once.bias)


def test_contamination_of_long_texts(spark, documents):
    long = "filler words without end " * 400_000
    rows = [(1, long), (2, f"{long}short question"), (3, "short question")] + [(10 + i, long[:2_000_000]) for i in range(5)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in contamination(documents(rows), items).collect()}
    assert got == {1: 0, 2: 2, 3: 2} | {10 + i: 0 for i in range(5)}


def test_toxicity(spark, documents, awkward):
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(100, 1100):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))]
        bad = rnd.random() < 0.3
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scum"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    noise = [(None, 1), (5000, 1), (100, None), (100, labels[0][1])]
    table = spark.createDataFrame(labels + noise, "doc_id long, toxic int")
    docs = documents(rows + awkward)
    got = toxicity(docs, table).collect()
    assert len(got) == len(rows) + len(awkward)
    truth = dict(labels)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    again = {r["doc_id"]: r["score"] for r in toxicity(docs.repartition(3), table).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got if r["doc_id"] is not None)
    wide = docs.withColumn("label", F.lit(1)).withColumn("toxicity_score", F.lit(9))
    kept = drop_toxic(wide, table)
    assert kept.columns == wide.columns and {r["toxicity_score"] for r in kept.collect()} == {9}
    assert toxicity(documents([]), table).count() == 0
    none = toxicity(docs, table.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}


def brute_base(text):
    words = [w.decode(errors="replace") for w in plain(text)]
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        here = [s for s in range(len(words) - len(parts) + 1) if words[s : s + len(parts)] == parts]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(documents, awkward):
    rows = [
        *awkward, (20, "Released under the MIT License."), (21, "Licensed under the Apache License, Version 2.0. CC-BY-NC 4.0; cc by nc cc by nc"),
        (22, "This work is licensed under the GNU General Public License, version 3."), (23, "commit licenses are not it"),
        (24, "under the mit license under the MIT license"), (25, "SPDX-License-Identifier: BSD-3-Clause"), (26, "All rights reserved. Creative Commons Attribution-ShareAlike 4.0"),
        (27, "under the mit license " * 300), (28, "apache license version 20"),
    ]
    got = licenses.scan_licenses(documents(rows).withColumn("line", F.lit("l"))).collect()
    base = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str)
    assert base == sorted(((i, *brute_base(t)) for i, t in rows), key=str)
    own = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert own[20] == ("mit", 1.0) and own[21] == ("apache-2,cc-by-nc", 1.0) and own[22][0] == "gpl-3" and own[23] == ("", 0.0)
    assert own[25] == ("bsd-3", 0.98) and own[26][0] == "all-rights-reserved,cc-by-sa" and own[28][0] == "apache" and own[1] == ("", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(len(f["rules"]) for f in licenses.families()) > 300
    assert licenses.scan_licenses(documents([])).count() == 0


LICENSED = {
    "GNU Affero General Public License v3": "agpl-3", "AGPL-3.0": "agpl-3", "GNU Lesser General Public License 2.1": "lgpl-2", "lgpl": "lgpl",
    "the GNU General Public License version 2 or any later": "gpl-2", "gplv3": "gpl-3", "GNU Free Documentation License": "gfdl", "apache 2.0": "apache-2",
    "Apache License": "apache", "MIT No Attribution": "mit-0", "Expat license": "mit", "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "3-clause BSD": "bsd-3", "FreeBSD license": "bsd-2", "0BSD": "bsd-0", "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "ISC license": "isc", "Mozilla Public License 2.0": "mpl-2", "MPL-2.0": "mpl-2", "Eclipse Public License": "epl", "CC0 1.0": "cc0", "CC-BY 4.0": "cc-by",
    "cc by-nc-nd": "cc-by-nc,cc-by-nc-nd", "Creative Commons Attribution-NonCommercial": "cc-by-nc", "Open Font License": "ofl", "WTFPL": "wtfpl", "the Unlicense": "unlicense",
    "dedicated to the public domain": "public-domain", "proprietary and confidential": "proprietary", "for non-commercial use only": "non-commercial", "OpenRAIL-M": "openrail",
    "License: MIT": "mit", "licence type: Boost Software License 1.0": "boost", "llama 3 community license": "llama",
}


def test_license_samples(documents):
    """Each passes the gate and ends as one label: inner and equal intervals are suppressed."""
    rows = list(enumerate(LICENSED))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(documents([(i, f"Some words, {t}. More words.") for i, t in rows])).collect()}
    assert {t: got[i] for i, t in rows} == LICENSED


def test_urls(spark):
    rows = [
        (1, "https://a.Example.com/en/7x"), (2, "http://example.com/en/8"), (3, "http://notexample.com/en/1"), (4, None), (5, "no scheme"), (6, "http://x.net/de/1?u"),
        (7, "http://example.net/de/81#f"), (8, "http://spam-farm.example.org/fr/1"), (9, "http://b.org"), (10, "http://b.org/es"), (10, "http://b.org/es"), (11, "://org/es/"), (12, ""),
        (13, "http://h/login?x"), (14, "http://a.com.evil/en/"),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["pattern_rule"]) for r in judge_urls(pages).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow", None)
    assert got[2][2:4] == ("com/en/", "block") and got[3][2:4] == ("com/en/", "block") and got[4] == got[5] == got[12] == ("", "", None, "allow", None)
    assert got[6] == ("x.net", "/de/1", "net/de/", "allow", None) and got[7][2:4] == ("example.net/de/8", "block")
    assert got[8][3:] == ("block", "spam-farm") and got[9] == ("b.org", "", None, "allow", None) and got[10][2:4] == (None, "allow")
    assert got[11][:3] == ("org", "/es/", "org/es/") and got[13][4] == "account-path:login" and got[14][2] is None
    assert judge_urls(pages).count() == len(rows) and judge_urls(pages.limit(0)).count() == 0
    many = tuple(SiteRule(f"h{i}.org/p{i}/", "block") for i in range(500))
    hit = judge_urls(spark.createDataFrame([(1, "http://a.h77.org/p77/x"), (2, "http://h77.org/p78/")], "page_id long, url string"), site_rules=many, pattern_rules=(PatternRule("any", "block", path="p78"),))
    assert [(r["rule"], r["pattern_rule"]) for r in hit.orderBy("page_id").collect()] == [("h77.org/p77/", None), (None, "any")]


def test_urls_with_line_breaks(spark):
    rows = [(1, "http://a\nb.com/en/1"), (2, "http://com\n/en/"), (3, "http://x.com/e\nn/"), (4, "http://x\ny.net/de/\n"), (5, "http://a\n.casino.fr/x"), (6, "http://x.fr/a\nb/login")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["pattern_rule"]) for r in judge_urls(pages).collect()}
    assert got[1] == ("com/en/", "block", None) and got[2] == (None, "allow", None) and got[3] == (None, "allow", None) and got[4][:2] == ("net/de/", "allow")
    assert got[5] == (None, "block", "gambling-host:casino") and got[6] == (None, "block", "account-path:login")


def test_many_rules_and_every_rule(spark):
    """The joined way gives what the constant table gives, and every rule of the bank catches its own url and not a longer word."""
    assert len(PATTERN_RULES) > 200
    rows, expected = [], {}
    for rule in PATTERN_RULES[4:]:
        word = rule.name.partition(":")[2]
        urls = (f"http://www.my-{word}-24.fr/", f"https://{word}s1.fr/a") if rule.host else (f"http://x.fr/a/{word}/b", f"http://x.fr/{word}x/")
        for url in urls:
            rows.append((len(rows), url))
        expected[len(rows) - 2] = rule.name
    rows += [(100_000 + i, u) for i, u in enumerate(["http://a.com/en/1", None, "", "http://ad-tracking.fr", "http://a.spam-farm.fr"])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    seen = [{r["page_id"]: tuple(r) for r in judge_urls(pages, max_table_rules=n).collect()} for n in (20_000, 0)]
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
    assert {i: seen[0][i][5] for i in expected} == expected
    assert not [i for i in seen[0] if i < 100_000 and i not in expected and seen[0][i][5]]
    assert judge_urls(pages, site_rules=(), pattern_rules=()).filter("verdict <> 'allow'").count() == 0
    assert judge_urls(pages.limit(0), max_table_rules=0).count() == 0


def test_very_long_url(spark):
    pages = spark.createDataFrame([(1, "http://h.com/en/" + "a/" * 100_000 + "login"), (2, "http://" + "x." * 50_000 + "casino.fr/"), (3, "http://casino" + "-x" * 50_000 + ".fr/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["pattern_rule"]) for r in judge_urls(pages).collect()}
    assert got == {1: ("com/en/", None), 2: (None, "gambling-host:casino"), 3: (None, "gambling-host:casino")}


def least_cost(roles, costs):
    table, ends = chat.transitions(costs), chat.endings(costs)
    ways = itertools.product(chat.ROLES, repeat=len(roles))
    return min(sum(int(table[r, p, q]) for r, p, q in zip(roles, (chat.START, *s[:-1]), s)) + int(ends[s[-1]]) for s in ways) // chat._ONE


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(merge=5, insert=1, relabel=2, relabel_unknown=0)])
def test_chat_costs(spark, costs):
    rnd = random.Random(7)
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "tool", " User", None]), rnd.choice(["a", "b", None, "<|im_end|>"])) for c in range(40) for t in range(rnd.randint(1, 5))]
    rows += [(99, t, rnd.choice(["user", "assistant"]), "x") for t in range(500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, chat.format_chats(table, costs).collect()))
    assert whole == sorted(map(tuple, chat.format_chats(table.repartition(5), costs, part_bytes=50).collect()))
    for conv in range(40):
        made = [r for r in whole if r[0] == conv]
        codes = [chat.SPELLINGS.get((r[2] or "").strip().lower(), 0) for r in rows if r[0] == conv]
        kept = [r for r in made if r[2] is not None]
        spent = costs.insert * (len(made) - len(kept)) + costs.merge * sum("merge" in r[4] for r in kept)
        spent += sum((costs.relabel if c else costs.relabel_unknown) for c, r in zip(codes, kept) if "relabel" in r[4])
        assert spent == least_cost(codes, costs) and [r[1] for r in made] == list(range(len(made)))
        text = "".join(r[5] for r in made)
        turns = re.findall(r"<\|im_start\|>(\w+)\n.*?<\|im_end\|>\n", text, re.DOTALL)
        body = turns[1:] if turns[0] == "system" else turns
        assert body == ["user", "assistant"] * (len(body) // 2) and body


def colex_best(roles, costs):
    """The cheapest way by trying all; of equal ones that with the earliest states from the end on."""
    table, ends = chat.transitions(costs), chat.endings(costs)
    ways = itertools.product(chat.ROLES, repeat=len(roles))
    total = lambda w: sum(int(table[r, p, q]) for r, p, q in zip(roles, (chat.START, *w[:-1]), w)) + int(ends[w[-1]])
    return list(min(ways, key=lambda w: (total(w), w[::-1])))


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(merge=2, insert=1, relabel=2, relabel_unknown=0)])
def test_chat_ties_do_not_depend_on_cuts(costs):
    rnd = random.Random(11)
    table, ends = chat.transitions(costs), chat.endings(costs)
    for trial in range(1000):
        roles = [rnd.randrange(4) for _ in range(rnd.randint(2, 6) if trial % 2 else rnd.randint(20, 60))]
        whole = chat.trace(roles, chat.START, ends, table)
        if len(roles) <= 6:
            assert whole == colex_best(roles, costs)
        cuts = sorted(rnd.sample(range(1, len(roles)), rnd.randint(1, min(5, len(roles) - 1))))
        pieces = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)])]
        stretches = []
        for part, piece in enumerate(pieces):
            held = chat.Stretch.empty()
            for role in piece:
                held = held.then(chat.Stretch.of_turn(table[role]))
            stretches.append((part, 7, len(piece), held.dumps()))
        found, got = chat.boundaries(stretches, costs), []
        for part, piece in enumerate(pieces):
            start, stop, _, _ = found[part, 7]
            end = [chat._FAR] * 4
            end[stop] = 0
            got += chat.trace(piece, start, chat.np.array(end), table)
        assert got == whole, roles


def test_chat_layouts(spark):
    rnd = random.Random(12)
    names = [*chat.SPELLINGS, "tool"]
    rows = [(c, t % 30, rnd.choice(names), f"t{rnd.randrange(3)}") for c in range(120) for t in range(rnd.randint(20, 40))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, chat.format_chats(table).collect()))
    for part_bytes in (60, 900):
        assert whole == sorted(map(str, chat.format_chats(table.repartition(3), part_bytes=part_bytes).collect()))


def test_chat_awkward(spark):
    rows = [(None, 1, "user", "no id"), (1, None, "user", "first"), (1, 1, "user", "same"), (1, 1, "user", "same"), (2, 1, None, None), (3, 5, "assistant", "")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = chat.format_chats(table).collect()
    assert {r["conv_id"] for r in got} == {None, 1, 2, 3}
    one = "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["pos"]))
    assert one == "<|im_start|>user\nfirst\nsame<|im_end|>\n<|im_start|>assistant\nsame<|im_end|>\n"  # as cheap as merging and inserting, with no insertion
    assert chat.format_chats(table.limit(0)).count() == 0


def test_ftrl_against_a_plain_loop():
    """Weights, bias and scores against FTRL-proximal written out one coordinate at a time."""
    import math

    import numpy as np

    from lodestone.llm.toxicity import Model, Settings, _sigmoid, features, fit
    from lodestone.llm._words import PLAIN_LOWER, word_hashes

    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["vile", "nasty"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 25))) for _ in range(120)] + [""]
    labels = [int("vile" in t or "nasty" in t) for t in texts]
    words, bounds = word_hashes(chat.pa.array(texts), PLAIN_LOWER)
    rows = [(features(words[i:j]), y) for i, j, y in zip(bounds[:-1], bounds[1:], labels)]
    settings = Settings(alpha=0.5, beta=1.0, l1=0.3, l2=0.1, epochs=2)
    z, n, bias_z, bias_n, bias = {}, {}, 0.0, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= 0.3 else (math.copysign(0.3, z[i]) - z[i]) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.1)
    for _ in range(2):
        for at, label in rows:
            held = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-(sum(held.values()) + bias))) - label
            for i, w in held.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / 0.5 * w
            before, bias_n = bias_n, bias_n + g * g
            bias_z += g - (math.sqrt(bias_n) - math.sqrt(before)) / 0.5 * bias
            bias = -bias_z / ((1.0 + math.sqrt(bias_n)) / 0.5)
    expected = {i: weight(i) for i in z if weight(i)}
    at, weights, found_bias = fit(rows, settings)
    got = dict(zip(at.tolist(), weights.tolist()))
    close = lambda a, b: abs(a - b) < 1e-3  # sums are kept in single precision
    assert {i for i, w in expected.items() if abs(w) > 0.01} <= set(got) and len(got) < len(z) and close(bias, found_bias)
    assert all(close(got.get(i, 0.0), w) for i, w in expected.items()) and all(close(expected.get(i, 0.0), w) for i, w in got.items())
    model = Model(at.astype(np.int64), weights, found_bias)
    for i, j in zip(bounds[:-1], bounds[1:]):
        assert close(model.score(words[i:j]), _sigmoid(sum(expected.get(k, 0.0) for k in features(words[i:j]).tolist()) + bias))
