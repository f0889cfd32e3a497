"""Shared parts of the operators that cut spans of bytes out of texts."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import scratch
from .textbatch import chunks, cover, utf8

LAST = (1 << 63) - 1


def keyed(docs: DataFrame, doc_id: str, text: str, carry: list[str] | None = None) -> DataFrame:
    """row, text, id and th of every row: row is a struct of the carried columns, (id, th) the key.

    id is doc_id, a null counting as the largest.  th tells rows with the same id apart
    by their text; it is 0 throughout where no id occurs twice.  Later steps hand all
    four columns on, so that the shuffle of the texts by key is the same in each of them
    and is made once.
    """
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    twice = docs.groupBy(ids.alias("id")).count().where("count > 1").limit(1).count()
    # Always 0, but no literal: one would be folded out of some of the joins, whose shuffles would then differ.
    th = F.xxhash64(F.col(text).cast("string")) if twice else F.pmod(ids, F.lit(1).cast("long"))
    row = F.struct(*([F.col(c) for c in carry] if carry is not None else [F.col(doc_id).cast("long").alias("doc_id")]))
    return docs.select(row.alias("row"), F.col(text).cast("string").alias("text"), ids.alias("id"), th.alias("th"))


def copies(rows: DataFrame) -> DataFrame:
    """id, th and n (bytes) of the rows whose whole text a row with a smaller id has too; only digests are shuffled."""
    digest = rows.select("id", "th", F.octet_length("text").alias("n"), F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("d"))
    first = digest.groupBy("d").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    return digest.join(first, "d").where("first < id").select("id", "th", "n").distinct()


def with_spans(rows: DataFrame, spans: DataFrame, how: str, *columns: str) -> DataFrame:
    """rows joined by key with the lists of the named columns of spans (id, th, ...).

    The lists, not the texts, are the hashed side of the join; texts are not sorted.
    """
    lists = spans.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct(*columns)).alias("spans"))
    lists = lists.hint("shuffle_hash")
    return rows.join(lists, (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th")), how).drop("_id", "_th")


def lists_of(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each element, and the fields of all elements, of a column of lists of structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.value_parent_indices().to_numpy(), [f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten()]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: computed once for several uses."""
    path = f"{scratch(df.sparkSession)}/spans-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_place(df: DataFrame, function) -> DataFrame:
    """df.mapInArrow(function) for a function that drops rows and knows columns by their place, whatever their names are."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(function, plain.schema).toDF(*df.columns)


def pieces(batches, limit: int = 8 << 20):
    """The batches in slices of whole rows with at most about limit bytes of text."""
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        for a, b in chunks(offsets, limit):
            yield batch.slice(a, b - a)


def strip(joined: DataFrame) -> DataFrame:
    """row and text of joined(row, text, ..., spans), with the spans cut out of text; null stays null."""
    schema = joined.select("row", "text").schema

    def apply(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            row, (start, end) = lists_of(batch.column("spans"))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            gone = np.zeros(len(data), dtype=bool)
            for i in np.flatnonzero(edges[1:] > edges[:-1]):
                r = slice(edges[i], edges[i + 1])
                gone[offsets[i] : offsets[i + 1]] = cover(start[r], end[r], int(offsets[i + 1] - offsets[i]))
            kept = np.zeros(len(data) + 1, np.int64)
            np.cumsum(~gone, out=kept[1:])
            left, at = data[~gone].tobytes(), kept[offsets]
            null = batch.column("text").is_null().to_pylist()
            texts = [None if null[i] else left[at[i] : at[i + 1]].decode("utf-8", "ignore") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return joined.mapInArrow(apply, schema)


def cut(joined: DataFrame, *, min_run: int = 1, texts: bool = False) -> DataFrame:
    """Each text of joined(row, text, ..., spans) without the union of its spans (start, end).

    Adjacent and overlapping spans make one run; runs of fewer than min_run bytes stay.
    Returns the carried columns, n_bytes, n_removed, n_spans, kept_sha256, n_parts (the
    different spans) and, if asked, kept: the remaining bytes as text.
    """
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_parts"] + ["kept"] * texts
    schema = joined.select("row", *(F.lit(0).cast("long").alias(c) for c in names[1:4]), F.lit("").alias(names[4]), F.lit(0).cast("long").alias(names[5]), *(F.lit("").alias(c) for c in names[6:])).schema

    def apply(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n = batch.num_rows
            removed, runs, parts = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            row, (start, end) = lists_of(batch.column("spans"))
            edges = np.searchsorted(row, np.arange(n + 1))
            whole, digests, kept = memoryview(data), [], []
            for i in range(n):
                body = whole[offsets[i] : offsets[i + 1]]
                if edges[i] < edges[i + 1]:
                    own = slice(edges[i], edges[i + 1])
                    parts[i] = len(np.unique(start[own]))
                    gone = cover(start[own], end[own], len(body))
                    step = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    long = b - a >= min_run
                    a, b = a[long], b[long]
                    removed[i], runs[i] = (b - a).sum(), len(a)
                    ends = [0, *b.tolist()]
                    body = b"".join(bytes(body[x:y]) for x, y in zip(ends, [*a.tolist(), len(body)], strict=True))
                digests.append(hashlib.sha256(body).hexdigest())
                if texts:
                    kept.append(bytes(body).decode("utf-8", "ignore"))
            columns = [batch.column("row"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array(digests, pa.string()), pa.array(parts)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if texts else []), names=names)

    return joined.mapInArrow(apply, schema).select("row.*", *names[1:])


def firsts(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the smallest id among the rows of its key, and the index of its key."""
    _, of = np.unique(keys, return_inverse=True)
    least = np.full(of.max(initial=-1) + 1, LAST, np.int64)
    np.minimum.at(least, of, ids)
    return least[of], of


def smallest(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with least: the smallest id that shares the keys."""
    return rows.withColumn("least", F.min("id").over(Window.partitionBy(*keys)))
