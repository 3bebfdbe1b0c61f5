"""Mixing, sharding, the registered queries and the pipeline."""

import random
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries as registered
from lodestone.llm.mixture import leaf_budgets, mix_sources, token_count
from lodestone.llm.sharding import shard_records, write_shards

from .test_joins import brute_components
from .test_scans import brute_contamination

SMALL = "/root/testdata/sf0.001"


def many_sources(spark, n=400):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        source = "src0" if rnd.random() < 0.4 else f"src{rnd.randrange(1, 9)}"
        rows.append((i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["en", "de", None]), rnd.choice([source, source, None]), 0))
    rows += [(i, None, "fr", "nothing", 0) for i in (900, 901)] + [rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def deal(budget, children):
    """Shares of a budget by weight, up to each child's room."""
    given, left, open_ = {}, Fraction(budget), dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k for k, (w, room) in open_.items() if left * w / total >= room}
        if not full:
            return given | {k: left * w / total for k, (w, _) in open_.items()}
        for k in full:
            given[k] = Fraction(open_.pop(k)[1])
            left -= given[k]
    return given


@pytest.mark.parametrize("budget, epochs, weights", [(None, 2, {}), (3000, 1, {}), (9000, 3, {"lang": {"de": 3.0}, "domain": {"domain1": 0.5}})])
def test_budgets(spark, budget, epochs, weights):
    docs = many_sources(spark)
    mixed = mix_sources(docs, budget, epochs, weights)
    supply = docs.select(*_leaf(), token_count(F.col("text")).alias("tokens")).groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"))
    leaves = {(r["domain"], r["lang"], r["source"]): r["tokens"] for r in supply.collect()}
    room = lambda prefix: epochs * sum(t for k, t in leaves.items() if k[: len(prefix)] == prefix)
    total = sum(leaves.values())
    targets = {(): Fraction(min(room(()), total if budget is None else budget))}
    for depth, level in enumerate(("domain", "lang", "source")):
        nodes = {k[: depth + 1] for k in leaves}
        for parent in {n[:-1] for n in nodes}:
            children = {n: (Fraction(weights.get(level, {}).get(n[-1], 1.0)), room(n)) for n in nodes if n[:-1] == parent}
            targets |= deal(targets[parent], children)
    got = {(r["domain"], r["lang"], r["source"]): r["target"] for r in leaf_budgets(supply, budget, epochs, weights).collect()}
    assert all(abs(got[k] - float(targets[k])) < 1e-6 for k in leaves)

    held = Counter()
    largest = max(r[0] for r in docs.select(token_count(F.col("text"))).collect())
    rows = mixed.select("mix_domain", "lang", "source", "mix_epoch", "doc_id", token_count(F.col("text")).alias("t")).collect()
    for r in rows:
        held[r["mix_domain"], r["lang"] or "", r["source"] or ""] += r["t"]
        assert 0 <= r["mix_epoch"] < epochs
    for leaf, tokens in leaves.items():
        assert held[leaf] <= float(targets[leaf]) + 1e-6
        if tokens:
            assert held[leaf] > float(targets[leaf]) - 2 * largest - 1
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs.repartition(5), budget, epochs, weights, max_broadcast_rows=1).select("mix_domain", "lang", "source", "mix_epoch", "doc_id", token_count(F.col("text")).alias("t")).collect()))


def _leaf():
    from lodestone.llm.mixture import domain_of

    return [domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]


def test_mixture_edges(spark):
    docs = many_sources(spark).withColumn("tokens", F.lit("x")).withColumn("domain", F.lit("mine"))
    mixed = mix_sources(docs)
    assert mixed.columns == [*docs.columns, "mix_domain", "mix_epoch"] and {r["domain"] for r in mixed.collect()} == {"mine"}
    assert mix_sources(docs.limit(0)).count() == 0 and mix_sources(docs, budget=0).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, weights={"lang": {"en": 0.0}})


def check_shards(rows, n_shards, n_rows):
    assert len(rows) == n_rows
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(by.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_sharding(spark, documents, awkward, tmp_path):
    rows = [*awkward, *((i, f"text {i}") for i in range(100, 400))]
    docs = documents(rows).withColumn("size", F.lit(1)).withColumn("copy", F.lit("c"))
    got = shard_records(docs, carry=["doc_id"]).collect()
    check_shards(got, 24, len(rows))
    truth = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == truth
    assert sorted(map(str, got)) == sorted(map(str, shard_records(docs.repartition(3), carry=["doc_id"]).collect()))
    assert sorted(map(str, got)) != sorted(map(str, shard_records(docs, carry=["doc_id"], seed=1).collect()))
    whole = shard_records(docs, n_shards=5)
    back = whole.toDF(*(f"c{i}" for i in range(len(whole.columns))))
    assert Counter((r[0], r[1]) for r in back.collect()) == Counter(rows)
    copies = shard_records(documents([(1, "same")]).crossJoin(spark.range(9000)).drop("id"), carry=["doc_id"], min_buckets=4).collect()
    check_shards(copies, 24, 9000)
    assert shard_records(documents([])).count() == 0
    write_shards(shard_records(documents(rows), n_shards=3), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("shard=*"))) == 3


def test_clashing_names_and_maps_can_be_written(spark, documents, awkward, tmp_path):
    """Added columns never take a name that is there already, and maps are carried; the results are written, not only collected."""
    from lodestone.llm.chat import format_chats
    from lodestone.llm.decontaminate import drop_contaminated, scan_documents
    from lodestone.llm.ngram_join import keep_one_of_each
    from lodestone.llm.toxicity import drop_toxic

    docs = documents(awkward)
    for name in ("size", "Shard", "slot", "law", "mix_epoch", "hit_words", "hit_spans", "toxicity_score", "dropped_id", "label", "bucket", "key", "c0", "body", "row"):
        docs = docs.withColumn(name, F.lit("mine"))
    docs = docs.withColumn("tags", F.create_map(F.lit("a"), F.col("text"))).withColumn("more", F.array(F.struct(F.create_map(F.col("lang"), F.lit(1)).alias("m"))))
    items = spark.createDataFrame([("i", "one two three four")], "item_id string, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(12)], "doc_id long, toxic int")
    made = {
        "shards": shard_records(docs, n_shards=3), "mixed": mix_sources(docs), "scanned": scan_documents(docs, items), "clean": drop_contaminated(docs, items),
        "distinct": keep_one_of_each(docs), "mild": drop_toxic(docs, labels),
    }
    for name, df in made.items():
        df.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        assert back.columns[: len(docs.columns)] == docs.columns, name
        assert {r["size"] for r in back.collect()} == {"mine"}, name
        assert back.filter("not (tags['a'] <=> text)").count() == 0 and back.filter("more[0].m['en'] <> 1").count() == 0
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(awkward)
    check = {r["doc_id"] for r in made["clean"].collect()}
    assert 5 not in check and 4 in check
    for df in (shard_records(docs.limit(0)), mix_sources(docs.limit(0)), drop_contaminated(docs.limit(0), items), keep_one_of_each(docs.limit(0)), drop_toxic(docs.limit(0), labels)):
        assert df.count() == 0 and df.columns[: len(docs.columns)] == docs.columns
    long = spark.createDataFrame([(1, 1, "user", "word " * 200_000), (1, 2, "user", "x" * 1_000_000)], "conv_id long, turn long, role string, text string")
    assert sum(len(r["rendered"]) for r in format_chats(long).collect()) > 2_000_000


def test_queries_and_sql():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert {int(n[2:].split("_")[0]) for n in registered.queries()} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    found = con.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    rows = sorted(map(str, found.fetchall()))
    assert rows == sorted(str(tuple(r)) for r in registered.queries()[name](spark, SMALL).select(*columns).collect())


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    assert [f.__name__ for _, f in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in pipeline.toxicity(spark, docs, SMALL).collect()}
    assert kept <= set(rows)
    alive = {i: root for i, (_, root) in brute_components([(i, rows[i]) for i in kept]).items()}
    kept = {i for i, root in alive.items() if i == root}
    kept = {r[0] for r in brute_contamination([(i, rows[i]) for i in kept], items) if not r[5]}
    out = pipeline.run(spark, SMALL)
    got = out.collect()
    clean = spark.createDataFrame([(i,) for i in kept], "doc_id long")
    mixed = Counter(r["doc_id"] for r in pipeline.mixing(spark, docs.join(clean, "doc_id").select(*docs.columns), SMALL).collect())
    assert Counter(r["doc_id"] for r in got) == mixed and set(mixed) <= kept
    check_shards(got, 24, sum(mixed.values()))
    assert out.columns[: len(docs.columns)] == docs.columns


def test_pipeline_of_awkward_tables(spark, awkward, tmp_path):
    """Nulls, repeated ids and rows, very long texts, columns whose names the stages use themselves, and empty tables."""
    import corpus_pipeline as pipeline

    bad = [(100 + i, f"you utter scum number {i} of all the idiots here") for i in range(40)]
    good = [(200 + i, f"a calm remark number {i} about gardens, rain and {i} kinds of moss") for i in range(60)]
    leak = "which planet of the sun is the largest of them all then"
    rows = [*awkward, *bad, *good, (300, f"text before {leak} text after"), (301, "twin of one text that stands here twice with all of its words"), (302, "twin of one text that stands here twice with all of its words")]
    docs = spark.createDataFrame([(i, t, None if i == 200 else "en", "src0", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("toxicity_score", "row_id", "hit_words", "mix_epoch", "Shard", "size"):
        docs = docs.withColumn(name, F.lit("mine"))
    labels = spark.createDataFrame([(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good] + [(None, 1, 1), (200, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string")
    for folder, table in ((tmp_path / "full", lambda t: t), (tmp_path / "empty", lambda t: t.limit(0))):
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            table(df).write.parquet(f"{folder}/{name}.parquet")
    out = pipeline.run(spark, str(tmp_path / "full"))
    assert out.columns[: len(docs.columns)] == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    folder = str(tmp_path / "full")
    calm = pipeline.toxicity(spark, docs, folder)
    kept = pipeline.decontamination(spark, pipeline.near_duplicates(spark, calm, folder), folder)
    calm, kept = ({r["doc_id"] for r in df.select("doc_id").collect()} for df in (calm, kept))
    assert not {i for i, _ in bad} & kept and not {300, 302} & kept
    assert {i for i, _ in good} <= kept and kept == calm - {300, 302}
    assert set(got) <= kept and len(set(got)) > len(kept) // 2  # a full epoch of small leaves, a part of large ones
    assert set(out.select("toxicity_score", "row_id", "hit_words", "mix_epoch", "Shard", "size").distinct().collect()) == {("mine",) * 6}
    assert pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_nothing_else_imports_it():
    root = Path(__file__).resolve().parents[2]
    for file in (root / "lodestone").rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "lodestone.llm" not in file.read_text(), file
