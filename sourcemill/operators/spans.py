"""Spans, tokens and brackets: interval work as windows over (file, offset)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import marks

# Brackets and the kind of each pair.
OPENING = {"(": "paren", "[": "bracket", "{": "brace"}
CLOSING = {")": "paren", "]": "bracket", "}": "brace"}

_NOT_LINE_END = re.compile(rb"[^\n]")


def gaps(spans: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, offset and length of the stretches that no span covers, the head and tail of each file included.

    spans: file_id, offset, length; files: file_id, length.  Overlapping spans count
    as their union; gaps without length are left out.
    """
    ends = files.select("file_id", F.col("length").cast("long").alias("offset"), F.lit(0).cast("long").alias("length"))
    rows = spans.select("file_id", F.col("offset").cast("long"), F.col("length").cast("long")).unionByName(ends)
    order = Window.partitionBy("file_id").orderBy("offset", "length")
    reach = F.coalesce(F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("from", reach).where("offset > from").select("file_id", F.col("from").alias("offset"), (F.col("offset") - F.col("from")).alias("length"))


def bracket_tokens(files: DataFrame) -> DataFrame:
    """file_id, idx, offset, length and text of every bracket in the sources of files(file_id, source).

    Brackets and the stretches between them alternate; idx counts both.
    """
    found = marks(files, "".join([*OPENING, *CLOSING]))
    return found.select("file_id", "idx", "offset", F.lit(1).cast("long").alias("length"), "text")


def bracket_pairs(tokens: DataFrame) -> DataFrame:
    """Every bracket with depth (of its inside, from 1; 0 for a close that closes nothing) and partner (idx, null without one).

    tokens: file_id, idx, text (one of ``()[]{}``).  A close takes the open at its depth
    off even where the kinds differ, but they are partners only where they agree.
    The depth never falls below zero: with S the running sum of +1 and -1 and M its
    running minimum, it is S - min(0, M).
    """
    rows = tokens.where(F.col("text").isin(*OPENING, *CLOSING))
    opens = F.col("text").isin(*OPENING)
    order = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opens", opens).withColumn("_s", F.sum(F.when(opens, 1).otherwise(-1)).over(order))
    rows = rows.withColumn("_after", F.col("_s") - F.least(F.lit(0), F.min("_s").over(order)))
    before = F.coalesce(F.lag("_after").over(Window.partitionBy("file_id").orderBy("idx")), F.lit(0))
    rows = rows.withColumn("depth", F.when(opens, F.col("_after")).otherwise(before).cast("int"))
    pairs = Window.partitionBy("file_id", "depth").orderBy("idx")
    kinds = F.create_map(*[F.lit(x) for kv in {**OPENING, **CLOSING}.items() for x in kv])
    rows = rows.withColumn("_kind", kinds[F.col("text")]).withColumn("_prev", F.lag(F.struct("idx", "_kind", "opens")).over(pairs)).withColumn("_next", F.lead(F.struct("idx", "_kind", "opens")).over(pairs))
    agrees = lambda c: F.when(F.col(f"{c}._kind") == F.col("_kind"), F.col(f"{c}.idx"))
    partner = F.when(F.col("depth") == 0, None).when(opens & ~F.col("_next.opens"), agrees("_next")).when(~opens & F.col("_prev.opens"), agrees("_prev"))
    return rows.select(*tokens.columns, "depth", partner.alias("partner"))


def enclosing_group(points: DataFrame, pairs: DataFrame, commas: DataFrame) -> DataFrame:
    """points(file_id, offset, ...) with group (idx of the innermost bracket open before it) and argument (the commas since, outside inner groups).

    pairs: bracket_pairs output, with idx as position; commas: file_id, idx.  Brackets
    and commas first get their own group by a running window, so that each point looks
    up one row for its place and counts the commas of its group before it.
    """
    kinds = pairs.select("file_id", F.col("idx").alias("at"), F.when(F.col("text").isin(*OPENING), "open").otherwise("close").alias("what"), "depth")
    marks = kinds.unionByName(commas.select("file_id", F.col("idx").alias("at"), F.lit("comma").alias("what"), F.lit(None).cast("int").alias("depth")))
    rows = marks.withColumn("row", F.lit(None).cast(_struct_type(points))).unionByName(
        points.select("file_id", F.col("offset").alias("at"), F.lit("point").alias("what"), F.lit(None).cast("int").alias("depth"), F.struct(*points.columns).alias("row"))
    )
    rank = F.when(F.col("what") == "point", 0).otherwise(1)
    order = Window.partitionBy("file_id").orderBy("at", rank)
    step = F.when(F.col("what") == "open", F.col("depth")).when(F.col("what") == "close", F.greatest(F.col("depth") - 1, F.lit(0)))
    level = F.coalesce(F.last(step, True).over(order), F.lit(0))
    rows = rows.withColumn("level", F.when(F.col("what") == "open", F.col("depth")).otherwise(level))
    inner = Window.partitionBy("file_id", "level").orderBy("at", rank)
    rows = rows.withColumn("group", F.when(F.col("level") > 0, F.last(F.when(F.col("what") == "open", F.col("at")), True).over(inner)))
    counted = Window.partitionBy("file_id", "group").orderBy("at", rank)
    rows = rows.withColumn("argument", F.sum(F.when(F.col("what") == "comma", 1).otherwise(0)).over(counted))
    found = rows.where("what = 'point'")
    return found.select(*(F.col(f"row.{c}").alias(c) for c in points.columns), "group", F.when(F.col("group").isNotNull(), F.col("argument")).alias("argument"))


def _struct_type(df: DataFrame):
    return df.schema


def token_at(offsets: DataFrame, tokens: DataFrame) -> DataFrame:
    """offsets(file_id, offset) with holding (idx of the token that holds it), touching (holds it or ends there) and first_from (the first that starts there or later).

    tokens do not overlap.  As-of windows both ways over one union; no product of a file's rows.
    """
    t = tokens.select("file_id", F.col("offset").cast("long").alias("at"), F.lit(0).alias("kind"), F.struct("idx", F.col("offset").cast("long").alias("start"), (F.col("offset") + F.col("length")).cast("long").alias("end")).alias("tok"))
    o = offsets.select("file_id", F.col("offset").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(t.schema["tok"].dataType).alias("tok"))
    back = Window.partitionBy("file_id").orderBy("at", "kind")
    ahead = Window.partitionBy("file_id").orderBy(F.col("at").desc(), F.col("kind").asc())
    rows = t.unionByName(o).withColumn("left", F.last("tok", True).over(back)).withColumn("right", F.last("tok", True).over(ahead)).where("kind = 1")
    rows = rows.select(
        "file_id", F.col("at").alias("offset"), F.when(F.col("at") < F.col("left.end"), F.col("left.idx")).alias("holding"), F.when(F.col("at") <= F.col("left.end"), F.col("left.idx")).alias("touching"), F.col("right.idx").alias("first_from")
    )
    return rows


def tokens_in(spans: DataFrame, tokens: DataFrame, bucket: int = 4096) -> DataFrame:
    """span_id and idx of the tokens that lie whole inside each span; a range join on buckets of offsets.

    spans: file_id, span_id, offset, length.
    """
    s = spans.select("file_id", "span_id", F.col("offset").alias("a"), (F.col("offset") + F.col("length")).alias("b"))
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))))
    t = tokens.select("file_id", "idx", F.col("offset").alias("c"), (F.col("offset") + F.col("length")).alias("d"), F.floor(F.col("offset") / bucket).alias("bucket"))
    return s.join(t, ["file_id", "bucket"]).where("a <= c and d <= b").select("file_id", "span_id", "idx")


def kind_counts(tokens: DataFrame, by: str = "file_id", kind: str = "kind") -> DataFrame:
    return tokens.groupBy(by, kind).agg(F.count("*").alias("n"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """file_id, first and last of the line ranges that remain when those that meet are merged; ranges of one line are dropped first.

    Gaps and islands: a range starts a new island when it begins after the largest end so far.
    """
    order = Window.partitionBy("file_id").orderBy("first", "last")
    rows = runs.where("first < last").withColumn("_reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_reach").isNull() | (F.col("first") > F.col("_reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file_id", "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def innermost(points: DataFrame, spans: DataFrame, bucket: int = 4096) -> DataFrame:
    """points(file_id, offset) with span_id of the innermost span that holds each, or null.

    spans: file_id, span_id, offset, length, properly nested.  Each span stands in the
    buckets of offsets that it reaches, so only spans near a point are compared.
    """
    s = spans.select("file_id", "span_id", F.col("offset").alias("_a"), (F.col("offset") + F.col("length")).alias("_b"))
    s = s.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(F.col("_b") / bucket))))
    p = points.select("file_id", "offset").distinct().withColumn("_bucket", F.floor(F.col("offset") / bucket))
    held = p.join(s, ["file_id", "_bucket"]).where("_a <= offset and offset < _b")
    best = held.groupBy("file_id", "offset").agg(F.max_by("span_id", F.struct(F.col("_a"), -F.col("_b"))).alias("span_id"))
    return points.join(best, ["file_id", "offset"], "left")


def parent_spans(spans: DataFrame, bucket: int = 4096) -> DataFrame:
    """span_id and parent (the nearest span that holds it whole and is larger, or null); one span is one row."""
    s = spans.select("file_id", F.col("span_id").alias("_p"), F.col("offset").alias("_a"), (F.col("offset") + F.col("length")).alias("_b"))
    s = s.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(F.col("_b") / bucket))))
    c = spans.withColumn("_bucket", F.floor(F.col("offset") / bucket))
    held = c.join(s, ["file_id", "_bucket"]).where("_a <= offset and offset + length <= _b and length < _b - _a")
    best = held.groupBy("file_id", "span_id").agg(F.min_by("_p", F.struct(F.col("_b") - F.col("_a"), F.col("_p"))).alias("parent"))
    return spans.select("file_id", "span_id").join(best, ["file_id", "span_id"], "left")


def mask_spans(regions: DataFrame, holes: DataFrame, bucket: int = 4096) -> DataFrame:
    """regions(file_id, region, offset, text) with the bytes of holes(file_id, offset, length) made blanks; line ends and the length stay.

    Both stand in the buckets of offsets that they reach, and a pair counts in the first
    bucket that it shares, so only holes near a region are compared with it.
    """
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bucket)))
    r = regions.select("file_id", "region", F.col("offset").alias("_a"), (F.col("offset") + F.octet_length("text")).alias("_b")).withColumn("_bucket", reach("_a", "_b"))
    h = holes.select("file_id", F.col("offset").alias("_c"), (F.col("offset") + F.col("length")).alias("_d")).withColumn("_bucket", reach("_c", "_d"))
    near = r.join(h, ["file_id", "_bucket"]).where("_c < _b and _d > _a").where(F.col("_bucket") == F.floor(F.greatest("_a", "_c") / bucket))
    inside = near.groupBy("file_id", "region").agg(F.collect_list(F.struct((F.col("_c") - F.col("_a")).alias("c"), (F.col("_d") - F.col("_a")).alias("d"))).alias("holes"))

    @F.pandas_udf("string")
    def blanked(text: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t, hs):
            if t is None or hs is None:
                return t
            b = bytearray(t.encode())
            for x in hs:
                span = slice(max(0, x["c"]), min(len(b), x["d"]))
                b[span] = _NOT_LINE_END.sub(b" ", b[span])
            return b.decode("utf-8", "replace")

        return pd.Series([one(t, hs) for t, hs in zip(text, cuts, strict=True)])

    return regions.join(inside, ["file_id", "region"], "left").withColumn("text", blanked("text", "holes")).drop("holes")
