"""Importance resampling, the filter audit and the vector search, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, importance, onebit

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_ranks(rows, items, percent=5, least=20):
    found = [(i, *features(t)) for i, t in rows]
    s, t = (Counter(b for x in bags for b in x) for bags in ([f[2] for f in found], [features(t)[1] for _, t in items]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for i, n, bag in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bag))
        out.append((i, n, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return out, drawn


def texts(n, seed=3):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(["Alpha", "beta-2", "gamma", "Ünï", "漢字", "x" * 80, "delta"]) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 18, 5])
def test_text_buckets(monkeypatch, block):
    monkeypatch.setattr(importance, "_BLOCK", block)
    rows = [t for _, t in texts(30)] + ["", None, "a", "A b", "y" * 71 + " Z " + "é" * 50, "A-b,c"]
    got = [[] for _ in rows]
    for owners, buckets in importance.text_buckets(pa.array(rows)):
        for b in buckets:
            for row, value in zip(owners, b):
                if value >= 0:
                    got[row].append(int(value))
    assert [sorted(g) for g in got] == [sorted(features(t)[1]) for t in rows]


def test_importance_ranks(spark, documents, awkward):
    rows = [*awkward, *texts(400), *[(7777, "one text many times " * 8)] * 40]
    items = [(1, "gamma alpha alpha"), (2, None), (3, "漢字 one text many times")]
    target = spark.createDataFrame(items, "item_id long, text string")
    every, drawn = brute_ranks(rows, items)
    got = importance.importance_ranks(documents(rows), target).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter((r[0], *r[2:]) for r in every)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]

    docs = documents(rows).withColumn("SCORE", F.lit("mine")).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    whole = importance.resample(docs, target, percent=30)
    assert whole.columns == [*docs.columns, "n_words", "n_features", "weight", "score_"]
    kept = brute_ranks(rows, items, percent=30)[1]
    assert Counter((r["doc_id"], r["score_"]) for r in whole.collect()) == Counter((r[0], r[4]) for r in kept)


def test_importance_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.importance_ranks(documents([]), none).count() == 0
    assert importance.resample(documents([]), none).count() == 0
    got = importance.importance_ranks(documents([(1, "a b"), (2, None)]), none).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {(1, 3, None), (2, 0, None)}


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    flagged = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        flagged.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, total = {}, Counter()
    for part in {r[0] for r in flagged}:
        mine = [r[1:] for r in flagged if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                left = [r for r in mine if not r[0] & set(order[: step - 1])]
                lost = [r for r in left if f in r[0]]
                total[part, f] += len(lost)
                failing = sum(f in r[0] for r in mine)
                figures = [len(left) - len(lost), len(lost), failing - len(lost), sum(r[0] == {f} for r in mine), sum(r[1] for r in lost), sum(r[2] for r in lost)]
                out[part, "".join(order), step] = (f, figures)
    return {(*key, *figures, total[key[0], f]) for key, (f, figures) in out.items()}


def test_audit(spark, awkward):
    rnd = random.Random(5)
    words = ["plain", "Words", "CAPS", "here", "cost$", "漢字", "\tand\n", "more", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice([3, 68])]) for _ in range(rnd.choice([5, 49, 50, 80]))), rnd.choice(["a", "b", None])) for i in range(120)]
    rows += [(i + 500, rows[i][1], rnd.choice(["a", "c"])) for i in range(0, 60, 2)] + [(i, t, "odd") for i, t in awkward] + [(3, rows[3][1], "a"), (None, rows[5][1], "a"), (None, rows[5][1], "a")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 600, 3)] + [(3, 1, 0), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, good int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit_filters(docs, marks).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit_filters(docs, marks.limit(0)).collect()} == {0}


def product(v, w):
    total = 0.0
    for a, b in zip(v, w):  # the built-in sum is compensated
        total += a * b
    return total


def brute_nearest(rows, every=20, k=20):
    held = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    asked, out = {(i, tuple(v)): v for i, v in held if i % every == 0}, []
    for (i, key), v in asked.items():
        near = sorted((-product(v.tolist(), w.tolist()), j) for j, w in held if j != i and len(w) == len(v))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


def vectors(n, dim=32, seed=8):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((n, dim)).astype(np.float32)
    base[::7] = base[0] + rnd.standard_normal((len(base[::7]), dim)).astype(np.float32) / 50
    return [(i, v.tolist()) for i, v in enumerate(base)]


def test_nearest_vectors_of_awkward_rows(spark):
    rows = vectors(90) + [(None, [1.0] * 32), (200, None), (201, []), (202, [0.0] * 32), (203, [1.0, None] * 16), (204, [float("nan")] * 32), (220, [float("inf")] * 32)]
    rows += [(240, [1.0, 2.0]), (241, [2.0, -1.0]), (242, [2.0, -1.0]), (260, [1.0, 2.0, 3.0]), (-20, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (40, rows[40][1])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    for settings in ({}, {"part_bytes": 2000, "block_rows": 2, "fit_rows": 5}):
        assert sorted(map(tuple, onebit.nearest_vectors(table, **settings).collect())) == brute_nearest(rows)
    doubles = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert sorted(map(tuple, onebit.nearest_vectors(doubles).collect())) == brute_nearest(rows)
    assert onebit.nearest_vectors(table.limit(0)).count() == 0


def test_nearest_vectors_recall(spark):
    rows = vectors(6000)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = onebit.nearest_vectors(table, part_bytes=300_000).collect()
    m = np.array([v for _, v in rows], np.float32).astype(float)
    exact = {(q, int(j)) for q in range(0, 6000, 20) for j in np.argsort(-np.where(np.arange(6000) == q, -np.inf, m @ m[q]), kind="stable")[:20]}
    assert Counter(r["query_id"] for r in got) == {q: 20 for q in range(0, 6000, 20)}
    assert all(r["score"] == product(m[r["query_id"]].tolist(), m[r["vec_id"]].tolist()) for r in got[:500])
    assert len(exact & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.98 * len(exact)


def test_codes_spare_reranking():
    m = np.array([v for _, v in vectors(6000, 64)], np.float32)
    ids, centre = np.arange(6000), m[:1000].astype(float).mean(axis=0)
    codes, scalars = onebit.encode(m, centre, 7)
    assert codes.shape == (6000, 8)
    best, reranked = onebit.search_block(ids[:50], m[:50].astype(float), [(ids, codes, scalars, m)], centre, 20, 1.9, 7)
    assert len(best.ids) == 1000 and reranked < 0.5 * 50 * 6000


def test_nearest_vectors_are_exact_though_bounds_fail():
    m = np.array([v for _, v in vectors(3000, 64)], np.float32)
    ids, centre = np.arange(3000), m[:500].astype(float).mean(axis=0)
    codes, scalars = onebit.encode(m, centre, 7)
    want = {(q, int(j)) for q in range(40) for j in np.argsort(-np.where(ids == q, -np.inf, onebit.products(m.astype(float), m[q].astype(float))), kind="stable")[:20]}
    for epsilon in (-2.0, 0.0, 1.9):
        best, _ = onebit.search_block(ids[:40], m[:40].astype(float), [(ids, codes, scalars, m)], centre, 20, epsilon, 7)
        assert set(zip(best.query.tolist(), best.ids.tolist())) == want
