"""Near-duplicate joins, substring removal and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ngram_join
from lodestone.llm.components import connected_components
from lodestone.llm.ngram_join import CostModel, guarded, keep_one_of_each, leads, least_overlap, ngram_components
from lodestone.llm.spotsigs import edited, fingerprint_edits, likeness, spot_components
from lodestone.llm.substrings import remove_repeats


def near_copies(seed=5, n=40):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows, base = [], [rnd.choice(vocabulary) for _ in range(120)]
    for i in range(n):
        words = list(base) if i % 3 == 0 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 90))]
        if i % 3 == 0:
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        elif i % 3 == 1:
            at = rnd.randint(0, len(words))
            words[at:at] = passage
        rows.append((i * 7 + 1, " ".join(words)))
    return rows + [(1000, rows[0][1]), (1001, rows[0][1].upper())]


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i][0]), root(i)) for i in ids}


@pytest.mark.parametrize(
    "settings",
    [{}, {"run": 2}, {"run": 3, "group_tokens": 300, "max_broadcast_rows": 1}, {"model": CostModel(verify=5.0), "max_frequent": 1}, {"run": 2, "group_rows": 3}, {"model": CostModel(most=0.0), "run": 4}],
)
def test_ngram_components(documents, settings):
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(documents(rows), **settings).collect()}
    assert got == brute_components(rows)


def test_leads_follow_estimated_cost():
    import numpy as np

    model, n = CostModel(), 300
    rare = np.zeros(n, np.int64)
    shared = np.full(n, 20)
    dear = np.full(n, 5000)
    few, many, none = (leads(x, 80, model, 32) for x in (rare, shared, dear))
    assert few[0] < many[0] and few[1] < many[1] and none[0] == 1  # dear tokens are matched with nothing
    some = [leads(np.where(np.arange(n) < n - k, 0, 10), 80, model, 32)[0] for k in (0, 100, 250, 300)]
    assert some == sorted(some) and some[0] < some[-1]
    by_hand = []
    for lead in range(1, 121):  # the least of the costs of all leads, one by one
        width = n - least_overlap(n, 80) + lead
        by_hand.append(width + 19.0 * width + model.verify * n * 19.0 * width / lead)
    assert many[0] == 1 + int(np.argmin(by_hand)) and abs(many[1] - min(by_hand)) < 1e-6
    assert all(1 <= leads(np.full(k, 9), 80, model, 32)[0] <= k for k in range(1, 40))


def test_leads_are_guarded():
    """No lead is under its share of the set, none is shortened, and none asks for more than any partner must share."""
    model = CostModel()
    for percent in (50, 80, 95):
        for size in (1, 2, 9, 10, 11, 300, 5000):
            for lead in sorted({1, min(2, least_overlap(size, percent)), least_overlap(size, percent)}):
                own = guarded(lead, size, percent, model)
                assert lead <= own <= least_overlap(size, percent) and (own == lead or own == -(-size // 10))
                assert own >= min(-(-size // 10), least_overlap(size, percent))


def test_twin_classes_of_one_node(documents):
    """Two classes whose digests share their first half are still held against one another and against others."""
    from lodestone.llm.ngram_join import set_components, shingle_builder

    build = shingle_builder(5)

    def halved(column):
        sets, keys = build(column)
        return sets, [(1 if k[0] is not None else None, k[1]) for k in keys]

    rows = near_copies()
    got = {r["doc_id"]: (r["size"], r["component_id"]) for r in set_components(documents(rows), halved, 80, run=3).collect()}
    assert got == brute_components(rows)


def test_ngram_awkward(documents, awkward):
    got = ngram_components(documents(awkward)).collect()
    assert len(got) == len(awkward)
    known = brute_components(awkward)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == known[r["doc_id"]]
    assert ngram_components(documents([])).count() == 0


def test_keep_one(documents):
    rows = near_copies()
    docs = documents(rows).withColumn("dropped_id", F.lit(1)).withColumn("kept", F.lit("x"))
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {root for _, root in brute_components(rows).values()}


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_keep_one_by_row(documents, broadcast_rows):
    """Repeated rows, two texts of one id, and texts without an id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(5, a), (5, a), (7, a + " end"), (8, b), (8, c), (9, b), (9, b), (None, c), (None, d), (None, d), (None, " "), (None, None), (10, None), (10, None), (11, None), (12, d + " x")]
    kept = [(r["doc_id"], r["text"]) for r in keep_one_of_each(documents(rows), broadcast_rows).collect()]
    sure = [(5, a), (8, b), (10, None), (11, None), (12, d + " x"), (None, " "), (None, None)]
    assert all(kept.count(x) == 1 for x in sure)
    assert len(kept) == len(sure) + 1 and sum(t == c for _, t in kept) == 1


@pytest.mark.parametrize("in_task", [0, 1_000_000])
def test_components(spark, in_task):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), in_task).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long"), in_task).count() == 0


def brute_removal(rows, window=13):
    low = -(1 << 63)
    split = [(low if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for key, _, words in split:
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, key), key)
    out = []
    for key, i, words in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < key:
                gone.update(range(s, s + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 2000])
def test_substrings(documents, block_bytes):
    rows = near_copies()
    got = sorted(map(tuple, remove_repeats(documents(rows), block_bytes=block_bytes, texts=False).collect()), key=str)
    assert got == brute_removal(rows)


@pytest.mark.parametrize("window", [2, 5, 30])
def test_substring_windows(documents, window):
    rows = near_copies(seed=8, n=20)
    got = sorted(map(tuple, remove_repeats(documents(rows), window=window, texts=False).collect()), key=str)
    assert got == brute_removal(rows, window)


def test_substrings_awkward(documents, awkward):
    rows = [*awkward, (11, awkward[9][1])]
    docs = documents(rows).withColumn("block", F.lit(1)).withColumn("bucket", F.lit("b"))
    assert sorted(map(tuple, remove_repeats(docs, texts=False).collect()), key=str) == brute_removal(rows)
    texts = {r["doc_id"]: r["kept_text"] for r in remove_repeats(docs).collect()}
    assert texts[4] == "word" and texts[1] == "" and texts[11] == ""
    assert remove_repeats(documents([])).count() == 0


def colliding():
    """Two words of 1,024 characters that every polynomial hash modulo 2 ** 64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_equality_is_not_a_polynomial_hash(documents):
    a, b = colliding()
    assert {r["doc_id"]: r["component_id"] for r in ngram_components(documents([(1, a), (2, b)])).collect()} == {1: 1, 2: 2}
    few = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{few} {a}"), (2, f"{few} {b}"), (3, f"{few} {a}")]
    assert sorted(map(tuple, remove_repeats(documents(rows), texts=False).collect()), key=str) == brute_removal(rows)


def test_word_hashes():
    import numpy as np
    import pyarrow as pa

    from lodestone.llm._words import SPACED, wide_hashes

    rnd = random.Random(4)
    words = {"".join(rnd.choice("ab\0é") for _ in range(rnd.randint(1, 60))) for _ in range(5000)} | set(colliding())
    words = sorted(words)
    one, two, at = wide_hashes(pa.array([" ".join(words[:2000]), None, " ".join(words[2000:]), ""]), SPACED)
    assert list(at) == [0, 2000, 2000, len(words), len(words)] and len(np.unique(one)) == len(np.unique(two)) == len(words)
    again, _, _ = wide_hashes(pa.array(["x", *words[::-1]]), SPACED)
    assert list(again[1:]) == list(one[::-1])


def test_pairs_of_halves():
    import numpy as np

    from lodestone.llm.substrings import _pairs_within

    known = np.array([(1, 5), (1, 6), (1, 9), (4, 1)], np.uint64)
    asked = np.array([(1, 5), (1, 9), (1, 7), (4, 1), (4, 2), (0, 0), (9, 9)], np.uint64)
    assert list(_pairs_within(asked[:, 0], asked[:, 1], known[:, 0], known[:, 1])) == [True, True, False, True, False, False, False]
    assert not _pairs_within(asked[:, 0], asked[:, 1], known[:0, 0], known[:0, 1]).any()


def test_fingerprints(documents, awkward):
    prose = "the boat was slow and the river is wide where a bend of the valley that is green was seen by an old farmer"
    rows = near_copies() + [(i, t) for i, t in awkward if i not in (9,)] + [(2000 + i, " ".join([prose, *(f"the stone{j} is heavy" for j in range(20 + i))])) for i in range(8)]
    docs = documents(rows).withColumn("part", F.lit(9)).withColumn("order", F.lit("o"))
    one = sorted(map(str, fingerprint_edits(docs).collect()))
    assert one == sorted(map(str, fingerprint_edits(docs.repartition(3), part_bytes=5000).collect()))
    got = fingerprint_edits(docs).collect()
    low = -(1 << 63)
    order = sorted(((low if i is None else i), t or "", i) for i, t in rows)
    expected = []
    for (_, t, i), (_, f, _) in zip(order, order[1:] + order[:1]):
        expected.append((i, len(t), hashlib.sha256(edited(t, f).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == sorted(e for e in expected if e[0] is not None)
    # Likeness, fingerprints and components by the definition, one text at a time.
    prints = {t: brute_signatures(t) for t in {t or "" for _, t in rows}}
    hexed = lambda found: "".join(f"{x:08x}" for x in sorted(found))
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    wanted = []
    for (_, t, i), (_, f, _) in zip(order, order[1:] + order[:1]):
        changed = brute_signatures(edited(t, f))
        wanted.append((i, hexed(prints[t]), hexed(changed), round(share(prints[t], changed), 9), round(share(prints[t], prints[f]), 9)))
    seen = [(r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(seen, key=str) == sorted(wanted, key=str)
    up = {i: i for _, _, i in order if i is not None}
    for _ in range(len(up)):
        before = dict(up)
        for _, t, i in order:
            for _, f, j in order:
                if i is not None and j is not None and prints[t] and prints[f] and 100 * len(prints[t] & prints[f]) >= 80 * len(prints[t] | prints[f]):
                    up[i] = up[j] = min(up[i], up[j])
        if up == before:
            break
    assert {(r["doc_id"], r["component_id"]) for r in got} == {*up.items(), (None, None)}
    by_text = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by_text[2] == "" and by_text[1000] == {t: hexed(p) for t, p in prints.items()}[dict(near_copies())[1000]] != ""
    assert fingerprint_edits(documents([])).count() == 0
    assert fingerprint_edits(documents([(4, "only one")])).first()["near_next"] == 1.0


def brute_signatures(text, chain=3):
    """Upper halves of the hashes of the signatures of one text, word by word."""
    import pyarrow as pa

    from lodestone.llm import spotsigs
    from lodestone.llm._words import PLAIN_LOWER, word_hashes

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return {int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") >> 32} if text else set()
    limit, mixed = 2**64 - 1, {}

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & limit
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & limit
        return x ^ x >> 31

    code = dict(zip(sorted(set(words)), word_hashes(pa.array(sorted(set(words))), PLAIN_LOWER)[0].tolist()))
    out = set()
    for at, word in enumerate(words):
        if word not in spotsigs.ANCHORS:
            continue
        follow = [w for w in words[at + 1 :] if w not in spotsigs.ANCHORS and w not in spotsigs.COMMON][:chain]
        total = mix(code[word])
        for step in range(chain):
            total = mix((total * 0x9E3779B97F4A7C15 + (code[follow[step]] if step < len(follow) else 0)) & limit)
        if follow:
            out.add(total >> 32)
    if out:
        return out
    size = min(chain, len(words))
    weights = [mix(j * 0x9E3779B97F4A7C15 & limit) | 1 for j in range(1, size + 1)]
    return {mix((sum(code[words[i + j]] * weights[j] for j in range(size)) + size) & limit) >> 32 for i in range(len(words) - size + 1)}


def test_spot_components(documents):
    base = "The river is wide and the boat was slow when it crossed the bend of a valley that is green. " * 3
    extra = " ".join(f"the thing{i} was seen by person{i}" for i in range(40))
    rows = [(1, base + extra), (2, extra + " MENU home contact"), (3, "the cat is here"), (4, base + extra + " the end"), (5, None), (6, "")]
    got = {r["doc_id"]: r["component_id"] for r in spot_components(documents(rows), percent=70).collect()}
    assert got[4] == 1 and got[2] == 1 and got[3] == 3 and got[5] == 5 and got[6] == 6


def test_bands():
    import numpy as np

    from lodestone.llm.ngram_join import band_limits, banded

    tokens = np.arange(5, dtype=np.uint64)
    for percent in (50, 80, 100):
        limits = band_limits(percent, 10_000)
        sets = {n: set(banded(tokens, n, percent, limits).tolist()) for n in range(1, 400)}
        assert all(sets[a] & sets[b] for a in sets for b in range(a, min(399, a * 100 // percent) + 1))
        assert not sets[1] & sets[399]


def test_spots_by_size(documents):
    rows = [(i, t) for i, t in near_copies(seed=6, n=30)]
    one, two = ({tuple(r) for r in spot_components(documents(rows), percent=p, run=run).collect()} for p, run in ((60, 32), (60, 2)))
    assert one == two


def test_likeness():
    import numpy as np

    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4, 5], np.uint32)
    assert likeness(a, b) == 2 / 5 and likeness(a, a) == 1.0 and likeness(a, b, least=0.8) == 0.0
    assert likeness(a[:0], a[:0]) == 1.0 and likeness(a, a[:0]) == 0.0


def _colliding_words():
    """Two texts of five words each, none in common, whose words agree in the first hash of theirs."""
    import struct

    from lodestone.llm._words import U64, mix

    start = int(mix(np.array([16 * 0x9E3779B97F4A7C15 % (1 << 64)], U64))[0])
    after = lambda lane: int(mix(np.array([start ^ lane], U64))[0])
    rnd, texts, printable = random.Random(1), ([], []), lambda b: all(33 <= x < 127 and not 65 <= x <= 90 for x in b)
    while len(texts[0]) < 5:
        word = bytes(rnd.choice(b"abcdefghijklmnop") for _ in range(16))
        one, two = struct.unpack("<QQ", word)
        for _ in range(40_000):
            other = bytes(rnd.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(8))
            second = struct.pack("<Q", after(one) ^ two ^ after(struct.unpack("<Q", other)[0]))
            if printable(second):
                texts[0].append(word.decode())
                texts[1].append((other + second).decode())
                break
    return " ".join(texts[0]), " ".join(texts[1])


def test_words_that_agree_in_one_hash(documents):
    from lodestone.llm._words import SPACED_LOWER, word_hashes

    texts = _colliding_words()
    assert not set(texts[0].split()) & set(texts[1].split())
    hashes, at = word_hashes(pa.array(texts), SPACED_LOWER)
    assert (hashes[at[0] : at[1]] == hashes[at[1] : at[2]]).all()
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[1].upper())]
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(documents(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_large_groups_are_sent_few_times(spark, documents, monkeypatch):
    """However small the groups that a task takes, blocks are no smaller than they must be; small ones give the same result."""
    seen, match = [], ngram_join._match

    def counted(queries, members, percent):
        seen.append(members.agg(F.max("block")).first()[0])
        return match(queries, members, percent)

    monkeypatch.setattr(ngram_join, "_match", counted)
    rows = near_copies()
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    for settings, several in (({}, False), ({"block_rows": 2}, True)):
        seen.clear()
        got = ngram_components(documents(rows), run=2, group_rows=3, **settings).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert seen and (max(seen) > 0) == several
