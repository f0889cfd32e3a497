"""Comparison of result tables with golden ones, and coverage checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("path", "name", "offset", "end")


def compare_rows(actual: DataFrame, golden: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, missing and extra: how many rows of golden are not in actual, and the other way, as multisets.

    Both sides are counted in one aggregation of a union, so equal rows meet in one
    shuffle and nulls compare equal.
    """
    both = actual.select(*keys, F.lit(1).alias("d")).unionByName(golden.select(*keys, F.lit(-1).alias("d")))
    n = both.groupBy(*keys).agg(F.sum("d").alias("d")).where("d <> 0")
    return n.select(*keys, F.greatest(-F.col("d"), F.lit(0)).alias("missing"), F.greatest("d", F.lit(0)).alias("extra"))


def apply_residue(diffs: DataFrame, residue: DataFrame) -> DataFrame:
    """diffs(fixture, category, ...) without the known exceptions of residue(fixture, category)."""
    return diffs.join(residue.select("fixture", "category").distinct(), ["fixture", "category"], "left_anti")


def check_floors(counts: DataFrame, floors: DataFrame) -> DataFrame:
    """suite, n, floor and reached for every suite of floors(suite, floor); a suite without a count has 0."""
    return floors.join(counts.select("suite", "n"), "suite", "left").select("suite", F.coalesce("n", F.lit(0)).alias("n"), "floor", (F.coalesce("n", F.lit(0)) >= F.col("floor")).alias("reached"))


def uncovered(kinds: DataFrame, seen: DataFrame) -> DataFrame:
    return kinds.select("kind").distinct().join(seen.select("kind").distinct(), "kind", "left_anti")


def exactly_one(items: DataFrame, partitions: list[tuple[str, str]]) -> DataFrame:
    """item and n of the items that no partition, or several, cover; partitions: (name, prefix)."""
    hits = [F.when(F.startswith("item", F.lit(prefix)), 1).otherwise(0) for _, prefix in partitions]
    n = hits[0]
    for h in hits[1:]:
        n = n + h
    return items.select("item", n.alias("n")).where("n <> 1")


def shift_spans(rows: DataFrame, delta: int) -> DataFrame:
    """rows with offset and end moved by delta: what a prefix of delta bytes must do, and nothing else."""
    return rows.withColumns({"offset": F.col("offset") + delta, "end": F.col("end") + delta})


def prefix_check(files: DataFrame, extract: Callable[[DataFrame], DataFrame], prefix: str) -> DataFrame:
    """The rows in which extract departs from the rule that text before a source moves every span by its length and changes nothing else.

    files: file_id, source, ...; extract makes rows from them, with offset and end, or
    neither for rows without a place.  It runs twice, on the sources and on the sources
    after the prefix; missing counts rows that should be there, extra rows that should not.
    Where rows have a file_id, files are first compared by the sums of 128-bit hashes of
    their rows, and only the rows of files that differ are compared themselves.
    """
    both = _extracted(files, extract, prefix)
    if "file_id" in both[0].columns:
        differ = differing(*both, tuple(both[0].columns))
        differ = differ.withColumnRenamed("file_id", "_differs")
        both = _extracted(files.join(differ, F.col("file_id").eqNullSafe(F.col("_differs")), "left_semi"), extract, prefix)
    return compare_rows(*both, tuple(both[0].columns))


def _extracted(files: DataFrame, extract: Callable[[DataFrame], DataFrame], prefix: str) -> tuple[DataFrame, DataFrame]:
    """What extract makes of the sources after the prefix, and what it should make of them."""
    plain = extract(files)
    after = extract(files.withColumn("source", F.concat(F.lit(prefix), F.col("source"))))
    expected = shift_spans(plain, len(prefix.encode())) if "offset" in plain.columns else plain
    return after, expected.select(*plain.columns)


def differing(actual: DataFrame, golden: DataFrame, keys: tuple[str, ...], by: str = "file_id") -> DataFrame:
    """The values of ``by`` whose rows, as multisets, differ in the sums of their 128-bit hashes: one shuffled row for each value and task."""
    # A null is hashed as a flag and a value, so that it differs from every other.
    marked = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    halves = [h for seed in (1, 2) for x in [F.xxhash64(F.lit(seed), *marked)] for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    rows = lambda df, d: df.select(by, F.lit(d).cast("long").alias("_0"), *((h * d).alias(f"_{i}") for i, h in enumerate(halves, 1)))
    n = rows(actual, 1).unionByName(rows(golden, -1)).groupBy(by).agg(*(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(halves) + 1)))
    return n.where(" or ".join(f"_{i} <> 0" for i in range(len(halves) + 1))).select(by)
