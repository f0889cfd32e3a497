"""Texts in blocks: the rows of a few megabytes of text as one compressed Arrow payload.

Operators that send positions of a text back and forth name them by block and byte, so
that one row of a shuffle carries what a whole block has for one bucket, packed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import LAST, pieces, written
from .textbatch import utf8

BLOCK_BYTES = 4 << 20


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers of one length, compressed by planes of bytes."""
    whole = np.stack([np.ascontiguousarray(c).astype(np.int64, copy=False) if c.dtype != np.uint64 else c.view(np.int64) for c in columns])
    return pa.compress(whole.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def expand(packed: bytes, n: int, columns: int = 1) -> np.ndarray:
    """What squeeze packed: an array of the columns."""
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(columns, n)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first as it is; undone by a running sum."""
    return np.diff(x, prepend=x.dtype.type(0))


def blocks_of(docs: DataFrame, doc_id: str, text: str, carry: list[str], *, least: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, n_bytes, ids, digests, here and payload: docs as a written table of blocks of about block_bytes of text.

    payload holds row (a struct of the carried columns), text and id of the rows; ids and
    digests are theirs, in order.  here are the places of texts that a smaller id in the
    block has whole; these, and texts under ``least`` bytes, have no digest, so a text
    with very many copies has one for each block.  A null doc_id is the largest id.  A
    text is never cut: a longer one is a block of its own.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id")
    )

    def pack(batches):
        from pyspark import TaskContext

        first, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            nonlocal n, held, size
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, offsets = utf8(batch.column("text"))
            whole = memoryview(data)
            digests = [hashlib.sha256(whole[a:b]).digest()[:16] if b - a >= least else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids, first_of, here = batch.column("id").to_pylist(), {}, []
            for k, d in zip(ids, digests, strict=True):
                first_of[d] = min(k, first_of.get(d, k))
            for at, (k, d) in enumerate(zip(ids, digests, strict=True)):
                if d is not None and k > first_of[d]:
                    here.append(at)
                    digests[at] = None
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_batch(batch)
            row = {"block": [first + n], "n_bytes": [len(data)], "ids": [ids], "digests": [digests], "here": [here], "payload": [sink.getvalue().to_pybytes()]}
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("here", pa.list_(pa.int32())), ("payload", pa.binary())]))

        for piece in pieces(batches, block_bytes):
            more = len(utf8(piece.column("text"))[0])
            if held and size + more > block_bytes:
                yield block()
            held.append(piece)
            size += more
        if held:
            yield block()

    return written(rows.mapInArrow(pack, "block long, n_bytes long, ids array<long>, digests array<binary>, here array<int>, payload binary"))


def unpacked(payload) -> pa.RecordBatch:
    """row, text and id of the rows of a block."""
    return pa.ipc.open_stream(payload).read_next_batch()


def copies_in(blocks: DataFrame) -> DataFrame:
    """block and gone: places in it of the texts that a smaller id has whole; only digests are shuffled."""
    texts = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "t")).select("block", "at", F.col("t.ids").alias("id"), F.col("t.digests").alias("d")).where("d is not null")
    first = texts.groupBy("d").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    gone = texts.join(first, "d").where("first < id")
    return gone.groupBy("block").agg(F.collect_list("at").alias("gone"))


def beside(blocks: DataFrame, lists: DataFrame) -> DataFrame:
    """blocks(block, payload, ...) with the row of lists(block, ...) for each, or nulls: the lists are the hashed side."""
    lists = lists.withColumnRenamed("block", "_block").hint("shuffle_hash")
    return blocks.join(lists, F.col("block") == F.col("_block"), "left").drop("_block")
