"""Lines of texts, and positions in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BOM
from .batches import cut_pieces, raw_lines


def split_lines(files: DataFrame, file: str = "file_id", source: str = "source") -> DataFrame:
    """file, line (from 0), raw (the line without its ``\\n``) and last (whether it is the last): narrow, without offsets."""
    parts = F.split(F.col(source), "\n", -1)
    rows = files.where(F.col(source).isNotNull()).select(F.col(file).alias("file_id"), F.posexplode(parts).alias("line", "raw"), F.size(parts).alias("_n"))
    return rows.select("file_id", "line", "raw", (F.col("line") == F.col("_n") - 1).alias("last"))


def explode_lines(files: DataFrame, file: str = "file_id", source: str = "source") -> DataFrame:
    """file_id, line (from 0), start, end (bytes) and text of every line.

    Only ``\\n`` ends a line; the ``\\r`` of ``\\r\\n`` and a BOM at the start of the file
    are outside the line's span.  The last line may be empty.  Narrow: a file's lines are
    placed in the task that reads it.
    """
    rows = raw_lines(files.select(F.col(file).alias("file_id"), F.col(source).alias("source")))
    bom = (F.col("line") == 0) & F.startswith("raw", F.lit(BOM))
    text = F.when(bom, F.substring("raw", 2, 1 << 30)).otherwise(F.col("raw"))
    text = F.when(~F.col("last") & F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    start = F.col("at") + F.when(bom, 3).otherwise(0)
    return rows.select("file_id", "line", start.cast("long").alias("start"), (start + F.octet_length(text)).cast("long").alias("end"), text.alias("text"))


def _units(prefix: Column, unit: str) -> Column:
    """Length of a text in utf8, utf16 or utf32 units."""
    if unit == "utf8":
        return F.octet_length(prefix)
    if unit == "utf16":
        return (F.octet_length(F.encode(prefix, "UTF-16BE")) / 2).cast("int")
    return F.char_length(prefix)


def _prefix(text: Column, n: Column) -> Column:
    """The first n bytes of a text, without a character that they cut."""
    whole = F.encode(text, "UTF-8")
    return F.coalesce(*[F.try_validate_utf8(F.substring(whole, F.lit(1), F.greatest(n - k, F.lit(0))).cast("string")) for k in range(4)])


def _prefix16(text: Column, n: Column) -> Column:
    """The first n units of UTF-16 of a text, without half a pair of them."""
    whole = F.encode(text, "UTF-16BE")
    half = F.hex(F.substring(whole, F.greatest(2 * n - 1, F.lit(1)), F.lit(1))).between("D8", "DB") & (n > 0)
    return F.decode(F.substring(whole, F.lit(1), F.when(half, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")


def column_at(text: Column, start: Column, offset: Column, unit: str = "utf32") -> Column:
    """The column of an offset in the line that has the text and start: 0 before it, and that of its end beyond it."""
    inside = F.greatest(F.lit(0), F.least(offset - start, F.octet_length(text))).cast("int")
    return F.when(F.octet_length(text) == F.char_length(text), inside).otherwise(_units(_prefix(text, inside), unit))


#: Characters of the pieces that lines beyond ASCII are looked up in.
PIECE = 64


def _pieces(lines: DataFrame, unit: str) -> DataFrame:
    """file_id, line, piece, at (bytes), units before it in its line, size and text of the pieces of lines.

    A line of ASCII is one piece whatever its length, and its text is null: bytes count
    its units.  Others are cut, so that an offset carries and reads PIECE characters.
    """
    key = F.struct("file_id", "line", "start").alias("file_id")
    rows = cut_pieces(lines.select(key, F.col("text").alias("source")), PIECE, unit)
    return rows.select("file_id.file_id", "file_id.line", "piece", (F.col("file_id.start") + F.col("at")).alias("at"), "units", "size", "text")


def locate(offsets: DataFrame, lines: DataFrame, unit: str = "utf32", offset: str = "offset") -> DataFrame:
    """offsets(file_id, offset, ...) with line and column, both from 0, in units of utf8, utf16 or utf32.

    An as-of join: offsets and line starts are put in one order per file and each offset
    takes the last line at or before it, so a file costs its rows, not their product.
    An offset beyond its line's end counts as the end; one before the first line as its start,
    for which line 0 is marked at offset 0 even where a BOM stands before it.  Long lines
    are marked piece by piece, so an offset never carries the whole text of its line.
    """
    begin = F.when((F.col("line") == 0) & (F.col("piece") == 0), F.lit(0)).otherwise(F.col("at")).cast("long")
    marks = _pieces(lines, unit).select("file_id", begin.alias("_at"), F.lit(0).alias("_kind"), F.struct("line", "at", "units", "size", "text").alias("_line"))
    points = offsets.select("file_id", F.greatest(F.col(offset).cast("long"), F.lit(0)).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_line"].dataType).alias("_line"), F.struct(*[c for c in offsets.columns]).alias("_row"))
    marks = marks.withColumn("_row", F.lit(None).cast(points.schema["_row"].dataType))
    order = Window.partitionBy("file_id").orderBy("_at", "_kind")
    found = marks.unionByName(points).withColumn("_line", F.last("_line", True).over(order)).where("_kind = 1")
    inside = F.greatest(F.lit(0), F.least(F.col("_at") - F.col("_line.at"), F.col("_line.size"))).cast("int")
    part = F.when(F.col("_line.text").isNull(), inside).otherwise(_units(_prefix(F.col("_line.text"), inside), unit))
    column = F.col("_line.units") + part
    return found.select(*(F.col(f"_row.{c}").alias(c) for c in offsets.columns), F.col("_line.line").alias("line"), column.alias("column"))


def offset_at(points: DataFrame, lines: DataFrame, unit: str = "utf32", strict: bool = True) -> DataFrame:
    """points(file_id, line, column, ...) with the byte offset.

    strict: null where the line or column does not exist or lies inside a character;
    otherwise the position is clamped to the line, and to the start of the character.
    """
    n = _units(F.col("text"), unit)
    joined = points.join(lines.select("file_id", "line", "start", "text"), ["file_id", "line"], "left")
    column = F.least(F.greatest(F.col("column"), F.lit(0)), n)
    if unit == "utf32":
        size = F.octet_length(F.substring("text", F.lit(1), column))
        whole = F.lit(True)
    elif unit == "utf8":
        prefix = _prefix(F.col("text"), column)
        size, whole = F.octet_length(prefix), F.octet_length(prefix) == column
    else:
        prefix = _prefix16(F.col("text"), column)
        size, whole = F.octet_length(prefix), F.octet_length(F.encode(prefix, "UTF-16BE")) == column * 2
    offset = (F.col("start") + size).cast("long")
    if strict:
        offset = F.when((F.col("column") >= 0) & (F.col("column") <= n) & whole, offset)
    return joined.withColumn("offset", offset).drop("start", "text")
