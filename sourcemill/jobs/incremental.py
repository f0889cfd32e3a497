"""Batch forms of incremental change tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.session import Grown

STAMP = ("mode", "seconds", "nanos", "size")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", fields: tuple[str, ...] = STAMP) -> DataFrame:
    """key and state (unchanged, changed, added or removed) of every entry of two snapshots; nulls compare equal."""
    o = old.select(key, F.struct(*fields).alias("_o"))
    n = new.select(key, F.struct(*fields).alias("_n"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"_o.{f}").eqNullSafe(F.col(f"_n.{f}"))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, state.alias("state"))


def to_analyse(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("state").isin("changed", "added"))


def expire_snapshot(stamps: DataFrame, now: float, days: int = 30) -> DataFrame:
    """stamps(seen, ...) without the entries not seen for more than ``days`` days; seen and now in seconds."""
    return stamps.where(F.col("seen") >= now - days * 86400)


def upsert_batch(store: DataFrame, changes: DataFrame, partitions: int | None = None) -> DataFrame:
    """The store after a batch of changes.

    store: path, content_hash, language, flavor, generation, rebuilds, sequence;
    changes: path, version, content_hash, language, flavor, removed.  Of several changes of
    a path the latest version counts.  An entry with equal content, language and flavor
    stays; otherwise generation and rebuilds grow by one; a removal only bumps the
    generation and clears the content; new paths continue the sequence in path order.
    Paths are dealt to that many partitions (by default, as many as the session says) before
    their changes are held against the store, and the result is written once for both its uses.
    """
    n = partitions or max(1, int(store.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    store, changes = store.repartition(n, "path"), changes.repartition(n, "path")
    latest = changes.groupBy("path").agg(F.max_by(F.struct("content_hash", "language", "flavor", "removed"), "version").alias("c"))
    both = store.join(latest, "path", "full")
    fields = ("content_hash", "language", "flavor")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"c.{f}"))
    touched, new = F.col("c").isNotNull(), F.col("generation").isNull()
    gone = touched & F.coalesce("c.removed", F.lit(False))
    changed = touched & ~gone & ~new & ~same
    rows = both.where(~(new & gone)).select(
        "path", *(F.when(gone, None).when(changed | new, F.col(f"c.{f}")).otherwise(F.col(f)).alias(f) for f in fields),
        F.when(new, 1).otherwise(F.col("generation") + (changed | gone).cast("int")).cast("int").alias("generation"),
        F.when(new, 0).otherwise(F.col("rebuilds") + changed.cast("int")).cast("int").alias("rebuilds"), F.col("sequence").cast("long").alias("sequence"),
    )
    from ..sources.files import numbered

    rows = Grown(store.sparkSession).add(rows)
    kept, fresh = rows.where("sequence is not null"), rows.where("sequence is null").drop("sequence")
    top = rows.agg(F.coalesce(F.max("sequence"), F.lit(-1)).alias("_top"))
    fresh = numbered(fresh, "path", name="_n", partitions=n).crossJoin(F.broadcast(top))  # one row
    return kept.unionByName(fresh.withColumn("sequence", F.col("_top") + 1 + F.col("_n")).drop("_top", "_n"))
