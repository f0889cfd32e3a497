"""Structure repair against an exhaustive search, whole conversations and pieces alike."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sourcemill.llm import queries, repairs

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = out.setdefault(c, [])
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        r = "user" if kind == 4 else r
        own += [(t, r, x)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by a search over (cost, audit) in that order."""
    seen, best = set(), [(0, "", 0, 0, ())]
    while best:
        cost, audit, i, state, lines = heapq.heappop(best)
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        if (i, state) in seen:
            continue
        seen.add((i, state))
        need = "assistant" if state == 2 else "user"
        to = 3 if state == 2 else 2
        heapq.heappush(best, (cost + 2, audit + "I", i, to, (*lines, f"{need}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(best, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(best, (cost + 2 + more, audit + "R", i + 1, to, (*lines, f"{need}:{text}")))
                if role[:1] == need[0]:
                    heapq.heappush(best, (cost + more, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))
                if role[:1] == "s" and state == 0:
                    heapq.heappush(best, (cost + more, audit + "K", i + 1, 1, (*lines, f"{role}:{text}")))


def plain(rows):
    out = []
    for c, own in damaged(rows).items():
        own = sorted(own, key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
        seen, judged = set(), []
        for _, r, x in own:
            last = WORD.findall(x)
            fault = "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last[-1] not in ".!?" else None
            seen.add((r, x))
            judged.append((r, x, fault))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(judged)
        faults = [f for *_, f in judged]
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, convs, most, roles=("system", "user", "assistant", "assistant", "user", "tool", "", None)):
    texts = ["One.", "Two!", "three", "Four? ", " \t", None, "", "5.\n", "six\nseven."]
    return [(c, rng.choice([t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.") for c in convs for t in range(rng.randrange(1, most))]


def found(df, **options):
    return sorted((tuple(r) for r in repairs.conversation_repairs(df, **options).select(NAMES).collect()), key=str)


@pytest.mark.parametrize(("cut", "seed"), [(False, 1), (True, 2)])
def test_equal_to_an_exhaustive_search(spark, cut, seed):
    rng = random.Random(seed)
    rows = made(rng, [None, *range(-3, 120)], 14) + [(500, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(90)]
    rows += [(501, None, "user", "same.")] * 40 + [(502, t, "tool", "x") for t in range(25)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if cut:
        spark.conf.set("spark.sql.shuffle.partitions", "60")  # most conversations are cut by partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_turns_are_kept_on_demand(spark):
    rows = made(random.Random(3), range(40), 9)
    for r in repairs.conversation_repairs(spark.createDataFrame(rows, SCHEMA), keep_turns=True).collect():
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in r.repaired).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.repaired))


def test_empty_long_and_extra_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    dropped = [(c, 0, "user", "a.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = dropped + [(1000, t, ("user", "assistant", "system")[t % 3], "word " * 50_000 + ".!"[t % 2]) for t in range(6)] + [(1001, t, "user", f"é{t % 40}.") for t in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(1), "gone": F.lit("x"), "kind": F.lit(None).cast("int"), "a.b": F.lit(0)})
    assert found(df) == plain(rows)
    assert found(spark.createDataFrame(dropped, SCHEMA)) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in sorted((d[0] for d in dropped), key=lambda c: str((c,)))]


def test_query_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_structure_repair(spark, folder).select(NAMES).collect()), key=str) == plain(rows)
