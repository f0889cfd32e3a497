"""Planning and applying fixes, and following offsets through them."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How safe a fix is, from the least; display-only fixes are never applied.
APPLICABILITY = ("display", "unsafe", "safe")


class _Taken:
    """Spans that were taken, in order: a new one is held against its neighbours only."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, start)
        if k < len(self.starts) and (self.starts[k] == start or self.starts[k] < end):
            return False
        return k == 0 or self.ends[k - 1] <= start

    def take(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def plan_fixes(fixes: DataFrame, edits: DataFrame, minimum: str = "safe") -> DataFrame:
    """file_id and fix_id of the fixes that are taken.

    fixes: fix_id, file_id, applicability, isolation; edits: fix_id, ordinal, offset,
    length.  In each file, by first edit and then fix_id, a fix is taken if it is safe
    enough, no taken fix has its isolation group, and its edits overlap neither each other
    nor an edit that is taken.  Two spans overlap also where they only start together.

    Edits fall into islands that do not overlap.  A fix alone on its island is taken
    without more; islands without isolation groups and without fixes that reach into
    others are planned one by one; only the rest of a file is one plan, in the order that
    decides.  Plans run over sorted partitions and hold the spans taken so far.
    """
    good = fixes.where(F.array_position(F.array(*map(F.lit, APPLICABILITY)), F.col("applicability")) > max(1, APPLICABILITY.index(minimum)))
    ends = F.struct(F.col("offset").cast("long").alias("offset"), (F.col("offset") + F.col("length")).cast("long").alias("end"))
    spans = edits.groupBy("fix_id").agg(F.array_sort(F.collect_list(ends)).alias("spans"))
    clash = "exists(sequence(1, size(spans) - 1), k -> size(spans) > 1 and k > 0 and (spans[k].offset = spans[k - 1].offset or spans[k].offset < spans[k - 1].end))"
    rows = good.join(spans, "fix_id").where(f"size(spans) = 1 or not {clash}").select("file_id", "fix_id", F.col("isolation").cast("string").alias("isolation"), "spans")
    each = rows.select("file_id", "fix_id", "isolation", F.explode("spans").alias("s")).select("file_id", "fix_id", "isolation", "s.offset", "s.end")
    order = Window.partitionBy("file_id").orderBy("offset", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | ((F.col("offset") >= reach) & (F.col("offset") > F.lag("offset").over(order)))
    each = each.withColumn("new", new.cast("long"))
    each = each.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = each.groupBy("fix_id").agg(F.min("island").alias("island"), F.max("island").alias("other"))
    each = each.join(over.select("fix_id", (F.col("island") < F.col("other")).alias("wide")), "fix_id")
    kinds = each.groupBy("file_id", "island").agg(F.min("fix_id").alias("a"), F.max("fix_id").alias("b"), F.max(F.col("wide") | F.col("isolation").isNotNull()).alias("tied"))
    kinds = kinds.select("file_id", "island", "tied", (F.col("a") == F.col("b")).alias("alone"))
    rows = rows.join(over.select("fix_id", "island"), "fix_id").join(kinds, ["file_id", "island"])
    alone = rows.where("alone and not tied").select("file_id", "fix_id")
    rest = rows.where("not alone or tied").withColumn("island", F.when(F.col("tied"), 0).otherwise(F.col("island")))
    schema = rest.select("file_id", "fix_id").schema

    def plan(batches):
        now, taken, groups = None, _Taken(), set()
        for batch in batches:
            keep = []
            files, islands, isolation, starts, stops = (batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))
            for i, key in enumerate(zip(files, islands, strict=True)):
                if key != now:
                    now, taken, groups = key, _Taken(), set()
                if isolation[i] is not None and isolation[i] in groups:
                    continue
                own = list(zip(starts[i], stops[i], strict=True))
                if all(taken.free(x, y) for x, y in own):
                    for x, y in own:
                        taken.take(x, y)
                    groups.add(isolation[i])
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    rest = rest.repartition("file_id", "island").sortWithinPartitions("file_id", "island", F.col("spans")[0]["offset"], "fix_id")
    planned = rest.select("file_id", "fix_id", "island", "isolation", F.col("spans.offset").alias("starts"), F.col("spans.end").alias("stops")).mapInArrow(plan, schema)
    return alone.unionByName(planned)


def planned_edits(plan: DataFrame, edits: DataFrame) -> DataFrame:
    """file_id, offset, length and replacement of the edits of planned fixes."""
    return plan.join(edits, "fix_id").select("file_id", "offset", "length", "replacement")


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file_id, fixed and applied: each source with its non-overlapping edits spliced in, in bytes.

    An edit that is out of range, out of order or would split a character is dropped.
    One row holds a file and the list of its edits; files without edits stay.
    """
    lists = edits.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "replacement"))).alias("edits"))
    rows = files.join(lists, "file_id", "left")

    @F.pandas_udf("fixed string, applied int")
    def splice(source: pd.Series, edits: pd.Series) -> pd.DataFrame:
        out, counts = [], []
        for text, own in zip(source, edits, strict=True):
            if text is None or own is None:
                out.append(text)
                counts.append(0)
                continue
            data, parts, at, n = text.encode(), [], 0, 0
            edge = lambda i: i == len(data) or data[i] & 0xC0 != 0x80  # noqa: B023, E731
            for e in own:
                a, b = e["offset"], e["offset"] + e["length"]
                if a < at or b > len(data) or not (edge(a) and edge(b)):
                    continue
                parts += [data[at:a], (e["replacement"] or "").encode()]
                at, n = b, n + 1
            out.append(b"".join([*parts, data[at:]]).decode())
            counts.append(n)
        return pd.DataFrame({"fixed": out, "applied": counts})

    return rows.withColumn("_f", splice("source", "edits")).select("file_id", "_f.fixed", "_f.applied")


def remap_offsets(offsets: DataFrame, edits: DataFrame) -> DataFrame:
    """offsets(file_id, offset) with moved: where each lands after the edits (ascending, apart).

    At or inside a replaced stretch it lands at the end of its replacement; otherwise it
    moves by the sum of the length changes before it.  An as-of window over one union.
    """
    order = Window.partitionBy("file_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    change = F.octet_length(F.coalesce("replacement", F.lit(""))) - F.col("length")
    e = edits.withColumn("_sum", F.sum(change).over(order))
    mark = F.struct((F.col("offset") + F.col("length")).cast("long").alias("end"), F.col("_sum").cast("long").alias("sum"))
    e = e.select("file_id", F.col("offset").cast("long").alias("offset"), F.lit(0).alias("_kind"), mark.alias("_mark"))
    o = offsets.select("file_id", F.col("offset").cast("long").alias("offset"), F.lit(1).alias("_kind"), F.lit(None).cast(e.schema["_mark"].dataType).alias("_mark"))
    last = F.last("_mark", True).over(Window.partitionBy("file_id").orderBy("offset", "_kind"))
    rows = e.unionByName(o).withColumn("_last", last).where("_kind = 1")
    moved = F.when(F.col("_last").isNull(), F.col("offset")).otherwise(F.greatest("offset", "_last.end") + F.col("_last.sum"))
    return rows.select("file_id", "offset", moved.alias("moved"))
