"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a position depends on the 32 bytes up to it.  A chunk ends where its
top bits are zero, at the earliest after ``MIN`` and at the latest after ``MAX`` bytes, so
an insertion changes the chunks around it and no others.  A chunk is a duplicate if
its 128-bit digest occurred before, in order of doc_id and position.  Runs of adjacent
duplicate chunks of at least ``min_run`` bytes are removed; shorter runs, which common
phrases make by chance, stay.

Duplicates within an Arrow batch are settled where they stand; of each digest only the
first chunk of a batch is shuffled, so the rows of a digest are bounded by the number of
batches, however many copies a passage has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import cut, keyed, pieces, with_spans
from .textbatch import chunks, mix, utf8

MIN, BITS, MAX = 16, 5, 256
MIN_RUN = 96

#: The gear table follows from a rule: the high half of the mixed byte value.
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of every position: the sum of table values of the last 32 bytes, each shifted by its distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
    return h


def cuts(data: np.ndarray, least: int = MIN, bits: int = BITS, most: int = MAX) -> list[int]:
    """Ends of the chunks of one text."""
    return _ends((np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1).tolist(), 0, len(data), least, most)


def _ends(marks: list[int], last: int, end: int, least: int = MIN, most: int = MAX) -> list[int]:
    """Ends of the chunks of last..end, given where the hash allows one."""
    out = []
    for at in marks:
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least:
            out.append(at)
            last = at
    while end - last > most:
        last += most
        out.append(last)
    return [*out, end] if last < end else out


def _chunks_of(data: np.ndarray, offsets: np.ndarray):
    """Text, start, end and digest (two halves) of every chunk."""
    text, start, end, digests = [], [], [], []
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    h = gear(data) >> np.uint32(32 - BITS) == 0
    marks = np.flatnonzero(h) + 1
    # The first 31 positions of a text would see the text before it; its hashes are made anew.
    edges = np.searchsorted(marks, offsets + 31, "right")
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if a == b:
            continue
        early = np.flatnonzero(gear(data[a : min(a + 31, b)]) >> np.uint32(32 - BITS) == 0) + 1 + a
        late = marks[edges[i] : np.searchsorted(marks, b, "right")]
        ends = _ends([*early.tolist(), *late.tolist()], a, b)
        starts = [a, *ends[:-1]]
        text += [i] * len(ends)
        start += starts
        end += ends
        digests += [digest(raw[x:y]) for x, y in zip(starts, ends, strict=True)]
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2) if digests else np.zeros((0, 2), np.uint64)
    return np.array(text, np.int64), np.array(start, np.int64), np.array(end, np.int64), halves


def duplicate_chunks(rows: DataFrame) -> DataFrame:
    """(id, th, start, end) of every duplicate chunk of rows(row, text, id, th)."""
    schema = "d1 long, d2 long, id long, th long, start int, end int, own boolean"

    def scan(batches):
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            ids, ths = (batch.column(k).to_numpy() for k in ("id", "th"))
            parts = []
            for a, b in chunks(offsets):
                text, start, end, halves = _chunks_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                base = (offsets[a:b] - offsets[a])[text]
                parts.append((text + a, start - base, end - base, halves))
            if not parts:
                continue
            text, start, end, halves = (np.concatenate(p) for p in zip(*parts, strict=True))
            # In order of key and position, the first chunk of each digest goes on.
            order = np.lexsort((start, ths[text], ids[text], halves[:, 1], halves[:, 0]))
            text, start, end, halves = text[order], start[order], end[order], halves[order]
            out = np.append(True, (halves[1:] != halves[:-1]).any(axis=1))
            lead = np.flatnonzero(out)[np.cumsum(out) - 1]
            key = ids[text], ths[text], start
            own = np.zeros(len(text), dtype=bool)
            for k in key:
                own |= k != k[lead]
            out |= own
            d1, d2 = halves[:, 0].copy(), halves[:, 1].copy()
            d1[own] = mix(ids[text[own]].astype(np.uint64))
            d2[own] = 0
            columns = [d1.view(np.int64), d2.view(np.int64), key[0], key[1], start.astype(np.int32), end.astype(np.int32), own]
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    found = rows.select("text", "id", "th").mapInArrow(scan, schema)
    place = F.struct("id", "th", "start")
    first = F.min(place).over(Window.partitionBy("d1", "d2", "own"))
    return found.withColumn("first", first).where(F.col("own") | (F.col("first") != place)).select("id", "th", "start", "end")


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN, texts: bool = False) -> DataFrame:
    """Every document with its duplicate runs removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_dup_chunks and, with
    texts, kept.  The first occurrence of a chunk, by doc_id and position, always stays.
    Null and empty texts have no chunk and come back empty; a null doc_id comes after
    all others; rows repeated with the same doc_id and text count as one document and each
    get their row; a very long text is chunked whole; other columns, whatever their
    names, are not read; an empty table gives an empty result.
    """
    rows = keyed(docs, doc_id, text)
    joined = with_spans(rows, duplicate_chunks(rows), "left", "start", "end")
    return cut(joined, min_run=min_run, texts=texts).withColumnRenamed("n_parts", "n_dup_chunks")
