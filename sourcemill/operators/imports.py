"""Classes, blocks and order of import statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import member_class, natural_key

SECTIONS = ("future", "standard", "third_party", "first_party", "local")


def classify_imports(rows: DataFrame, standard: DataFrame, first_party: DataFrame) -> DataFrame:
    """rows(module, level, ...) with section: future, standard, third_party, first_party or local.

    standard and first_party list head modules (column module); both are joined by key.
    """
    head = F.regexp_extract("module", r"^([^.]*)", 1)
    out = rows.withColumn("_head", head)
    for name, table in (("_std", standard), ("_own", first_party)):
        out = out.join(table.select(F.col("module").alias("_head")).distinct().withColumn(name, F.lit(True)), "_head", "left")
    section = F.when(F.col("level") > 0, "local").when(F.col("_head") == "__future__", "future").when(F.col("_own"), "first_party").when(F.col("_std"), "standard").otherwise("third_party")
    return out.withColumn("section", section).drop("_head", "_std", "_own")


def import_blocks(statements: DataFrame) -> DataFrame:
    """file_id, block, first, last and n of the runs of import statements that follow each other.

    statements: file_id, ordinal, is_import.  Gaps and islands: a block is where
    ordinal less the running number of imports stays the same.
    """
    order = Window.partitionBy("file_id").orderBy("ordinal")
    rows = statements.where("is_import").withColumn("_island", F.col("ordinal") - F.row_number().over(order))
    runs = rows.groupBy("file_id", "_island").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"))
    return runs.withColumn("block", F.row_number().over(Window.partitionBy("file_id").orderBy("first"))).drop("_island")


def sort_imports(rows: DataFrame) -> DataFrame:
    """file_id, block, place, ordinal and moved: the sorted order of each block without repeats, and whether a row stands elsewhere now.

    rows: file_id, block, ordinal, section, plain (import against from), level, module,
    member, alias.
    """
    section = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    kind = member_class(F.coalesce("member", F.lit("")))
    keys = [
        section, ~F.col("plain"), F.col("level").desc(), natural_key(F.lower("module")), natural_key(F.col("module")), F.col("alias").isNotNull(),
        F.array_position(F.array(*map(F.lit, ("constant", "class", "variable"))), kind), natural_key(F.coalesce("member", F.lit(""))), F.coalesce("alias", F.lit("")), F.col("ordinal"),
    ]
    once = rows.dropDuplicates(["file_id", "block", "plain", "level", "module", "member", "alias"])
    out = once.withColumn("place", F.row_number().over(Window.partitionBy("file_id", "block").orderBy(*keys)))
    out = out.withColumn("_now", F.row_number().over(Window.partitionBy("file_id", "block").orderBy("ordinal")))
    return out.select("file_id", "block", "place", "ordinal", (F.col("place") != F.col("_now")).alias("moved"))


def import_symbol(rows: DataFrame, wanted: DataFrame, statements: DataFrame) -> DataFrame:
    """wanted(file_id, module, member) with bound (the name that holds it already, or null) and insert_at otherwise.

    rows: file_id, offset, module, member, local; statements: file_id, ordinal, kind
    (docstring, import, other), end.  The place is after the last import of the head run,
    else after the docstring, else 0.
    """
    held = rows.groupBy("file_id", "module", "member").agg(F.min_by("local", "offset").alias("bound"))
    order = Window.partitionBy("file_id").orderBy("ordinal")
    head = statements.withColumn("_other", F.sum(F.when(F.col("kind") == "other", 1).otherwise(0)).over(order)).where("_other = 0")
    place = head.groupBy("file_id").agg(F.max("end").alias("_end"))
    out = wanted.join(held, ["file_id", "module", "member"], "left").join(place, "file_id", "left")
    return out.withColumn("insert_at", F.when(F.col("bound").isNull(), F.coalesce("_end", F.lit(0)))).drop("_end")
