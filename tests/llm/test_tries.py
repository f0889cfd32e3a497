"""The conversation trie against a plain one, for several block lengths and shapes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sourcemill.llm import tries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return len("".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ")) - "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ").count("")


def plain(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [k[2:] for k in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    own = {p: (0 if p in kids else 1, (len(m) - 1) * words(p[-1][1]) if p else 0) for p, m in members.items()}
    sums = {p: [0, 0] for p in members}
    for p, (leaf, saved) in own.items():
        for d in range(len(p) + 1):
            sums[p[:d]][0] += leaf
            sums[p[:d]][1] += saved
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in tries.conversation_trie(df, **options).select(COLUMNS).collect()), key=str)


def made(rng, convs, most, texts=3):
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "x\ty\nz "][:texts])))
    return rows


@pytest.mark.parametrize(("block", "most"), [(2, 8), (8, 20)])
def test_equal_to_a_plain_trie(spark, block, most):
    rng = random.Random(block)
    rows = made(rng, [*range(-25, 25, 3), *range(60, 90), 1000, 1003], most, texts=5)
    rows += [(40, t, "user", "same") for t in range(4)] + [(k, t, "user", "same") for k in range(100, 118) for t in range(4)]
    rows += [(None, 1, "user", "lost")] + rows[:3]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block) == plain(rows)


def test_long_conversation_over_many_partitions(spark):
    rows = [(0, t, "user", f"t{t % 7}") for t in range(150)] + [(1, t, "user", f"t{t % 7}") for t in range(130)] + [(20, None, "user", "u")] * 30
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7), block=4) == plain(rows)


def test_empty_table_turnless_and_extra_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    few = [(c, 0, "user", "t") for c in range(1, 20)]  # their family's first conversation is absent
    wide = spark.createDataFrame(few, SCHEMA).withColumns({"conv": F.lit("x"), "place": F.lit(1), "digest": F.lit(None).cast("int"), "a.b": F.lit(2)})
    assert found(wide) == plain(few)


def test_lists_of_endings_cut_by_partitions(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 10)
    ends = spark.range(5000).select(F.when(F.col("id") < 4800, F.lit(b"k")).otherwise(F.lit(b"z")).alias("key"), (F.col("id") * 3 - 700).alias("conv")).repartition(5)
    got = {bytes(r.key): r.ends_sha256 for r in tries.ending_digests(ends).collect()}
    want = {k: hashlib.sha256(",".join(str(i * 3 - 700) for i in span).encode()).hexdigest() for k, span in ((b"k", range(4800)), (b"z", range(4800, 5000)))}
    assert got == want
