"""The corpus pipeline: every stage on what its predecessor kept, against brute force."""

import random

import duckdb

import corpus_pipeline
from pyspark.sql import functions as F

from sourcemill.llm import mixing

from .test_dedup import brute_suffixes
from .test_filters import brute_leaks, brute_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def made(spark, folder):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(4)]
    texts, kinds = [], {}
    for k in range(30):
        texts.append(" ".join(words(rng.randrange(60, 160))))
        kinds[len(texts) - 1] = "clean"
    for k in range(5):
        base = texts[k].split()
        for _ in range(2):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
            kinds[len(texts) - 1] = "copy"
        texts.append(texts[k])
        kinds[len(texts) - 1] = "copy"
    passage = " ".join(words(20))
    for _ in range(3):
        texts.append(" ".join(words(80)) + " " + passage + " " + " ".join(words(80)))
        kinds[len(texts) - 1] = "passage"
    for i in (0, 2):
        texts.append(" ".join(words(60)) + " " + items[i][1] + " " + " ".join(words(60)))
        kinds[len(texts) - 1] = "leak"
    for bad in (None, "", "too short", "again and again " * 60):
        texts.append(bad)
        kinds[len(texts) - 1] = "bad"
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, kinds


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, items, kinds = made(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs)
    texts = {d: t for d, t, *_ in rows}

    good = {r.doc_id: r.text for r in kept[0].collect()}
    assert good == {d: t for d, t in texts.items() if brute_quality(t)[-1]}
    assert all(d not in good for d, k in kinds.items() if k == "bad")

    single = {r.doc_id: r.text for r in kept[1].collect()}
    assert set(single) == {d for d in good if kinds[d] != "copy"}

    alone = {r.doc_id: r for r in kept[2].collect()}
    removed = {d: n for d, _, n, *_ in brute_suffixes(list(single.items()))}
    assert set(alone) == set(single)
    assert {d: len(single[d].encode()) - len(r.text.encode()) for d, r in alone.items()} == removed
    assert all(r.n_chars == len(r.text) for r in alone.values())
    assert sum(n > 0 for n in removed.values()) == 2

    leaks = {d for d, _ in brute_leaks([(d, r.text) for d, r in alone.items()], items)}
    assert {r.doc_id for r in kept[3].collect()} == set(alone) - leaks
    assert leaks == {d for d, k in kinds.items() if k == "leak"}

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/benchmark_decontamination/*.parquet'")
    found = c.execute(mixing.ORACLE_SQL)
    order = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    assert sorted((tuple(r) for r in kept[4].select(order).collect()), key=str) == want
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).select(order).collect()), key=str) == want
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, "en", None, 0), (None, "", None, "s", 0), (2, "few words", "en", "s", 9), (2, "few words", "en", "s", 9)], SCHEMA)
    long = spark.createDataFrame([(d, " ".join(f"w{(k * 7919 + (d or 0)) % 100_003}" for k in range(60_000)), "en", "s", 1) for d in (None, 5, 5)], SCHEMA)
    names = {"row": F.lit(1), "id": F.lit("x"), "block": F.lit(2.5), "nid": F.lit(1), "__nid": F.lit(3), "nid_": F.lit(4), "part": F.lit(5), "a.b": F.lit(6), "text.x": F.lit(7), "c0": F.lit(8)}
    extra = long.withColumns(names)
    #: Which rows of odd each stage keeps: null, empty, and twice the same few words.
    odd_ids = {"quality_rules": [], "simhash_near_dedup": [1, 2], "suffix_array_dedup": [2, 2], "benchmark_decontamination": [None, 1, 2, 2], "source_mixing": None}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        found = stage(spark, odd, folder)
        if odd_ids[name] is None:
            assert {r.doc_id for r in found.collect()} <= {None, 1, 2}
        else:
            assert sorted((r.doc_id for r in found.collect()), key=str) == sorted(odd_ids[name], key=str)
        kept_long = stage(spark, extra, folder)
        assert kept_long.count() == (2 if name == "simhash_near_dedup" else 3)
        assert name == "source_mixing" or kept_long.columns == extra.columns
        if name != "source_mixing":
            assert all(r["a.b"] == 6 and r["__nid"] == 3 and r["nid"] == 1 for r in kept_long.collect())
    for df in kept[:-1]:
        assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
