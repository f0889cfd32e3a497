"""Stretches of bytes in the sources of files, found in Arrow batches: narrow, without a shuffle or a sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of whole texts that one step takes; a longer text is a step of its own.
STEP = 1 << 22


def table(chars: str) -> np.ndarray:
    """For each byte whether it is one of chars."""
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


LETTERS = table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _steps(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, bytes and ends (one more than keys, from 0) of texts that are not null, a few megabytes at a time."""
    for batch in batches:
        held = batch.filter(batch.column(1).is_valid())
        keys, texts = held.column(0), held.column(1)
        if not len(keys):
            continue
        large = pa.types.is_large_string(texts.type)
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(keys):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP, "right")) - 1)
            yield keys.slice(first, last - first), data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            first = last


def _runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the longest stretches of inside that do not cross a text's end."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[ends] = True
    before, after = np.zeros(len(inside), dtype=bool), np.zeros(len(inside), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _owner(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each start, and its number among the starts of that text."""
    own = np.searchsorted(ends, starts, "right") - 1
    return own, np.arange(len(starts)) - np.searchsorted(starts, ends)[own]


def _rows(keys: pa.Array, own: np.ndarray, columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    arrays = [keys.take(pa.array(own)), *(v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, names=["file_id", *columns])


def _mapped(files: DataFrame, run, columns: str) -> DataFrame:
    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "source").mapInArrow(run, f"file_id {kind}, {columns}")


def letter_runs(files: DataFrame) -> DataFrame:
    """file_id, idx, offset, length (bytes) and upper of the stretches of ASCII letters; idx also counts the stretches between them."""

    def run(batches):
        for keys, data, ends in _steps(batches):
            inside = LETTERS[data]
            starts, stops = _runs(inside, ends)
            own, n = _owner(starts, ends)
            yield _rows(keys, own, {"idx": 2 * n + ~inside[ends[own]], "offset": starts - ends[own], "length": stops - starts, "upper": data[starts] <= ord("Z")})

    return _mapped(files, run, "idx long, offset long, length long, upper boolean")


def marks(files: DataFrame, chars: str) -> DataFrame:
    """file_id, idx, offset and text of each of the ASCII chars in the sources; idx also counts the stretches between them."""
    wanted = table(chars)

    def run(batches):
        for keys, data, ends in _steps(batches):
            found = wanted[data]
            at = np.flatnonzero(found)
            own, n = _owner(at, ends)
            others, _ = _runs(~found, ends)
            between = np.searchsorted(others, at) - np.searchsorted(others, ends)[own]
            text = pa.DictionaryArray.from_arrays(pa.array(data[at].astype(np.int16)), pa.array([chr(i) for i in range(128)])).cast(pa.string())
            yield _rows(keys, own, {"idx": n + between, "offset": at - ends[own], "text": text})

    return _mapped(files, run, "idx long, offset long, text string")


def raw_lines(files: DataFrame) -> DataFrame:
    """file_id, line (from 0), at (bytes), raw (the line without its ``\\n``) and last (whether it is the last)."""

    def run(batches):
        for keys, data, ends in _steps(batches):
            cuts = np.flatnonzero(data == 10)
            # A line begins with each text and after each line end; texts without a byte have one, too.
            per = np.diff(np.searchsorted(cuts, ends)) + 1
            own = np.repeat(np.arange(len(per)), per)
            first = np.cumsum(per) - per
            line = np.arange(len(own)) - first[own]
            starts, stops = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            heads = np.zeros(len(own), dtype=bool)
            heads[first] = True
            tails = np.zeros(len(own), dtype=bool)
            tails[first + per - 1] = True
            starts[heads], starts[~heads] = ends[:-1], cuts + 1
            stops[tails], stops[~tails] = ends[1:], cuts
            offsets = np.zeros(len(own) + 1, np.int32)
            np.cumsum(stops - starts, out=offsets[1:])
            raw = pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[data != 10])))
            yield _rows(keys, own, {"line": line.astype(np.int32), "at": starts - ends[own], "raw": raw, "last": tails})

    return _mapped(files, run, "line int, at long, raw string, last boolean")


def cut_pieces(files: DataFrame, chars: int, unit: str) -> DataFrame:
    """file_id, piece (from 0), at and size (bytes), units of utf8, utf16 or utf32 before it, and text of the stretches of chars characters of the sources.

    A source of ASCII is one piece, and its text is null.
    """

    def run(batches):
        for keys, data, ends in _steps(batches):
            lead = (data & 0xC0) != 0x80
            lead[ends[:-1][np.diff(ends) > 0]] = True
            at = np.flatnonzero(lead)
            first = np.searchsorted(at, ends)
            per = np.diff(first)
            plain = per == np.diff(ends)
            own = np.repeat(np.arange(len(per)), per)
            n = np.arange(len(at)) - first[own]
            cut = ~plain[own] & (n % chars == 0)
            starts, own, n = at[cut], own[cut], n[cut]
            stops = ends[own + 1]
            inner = own[:-1] == own[1:]
            stops[:-1][inner] = starts[1:][inner]
            if unit == "utf8":
                units = starts - ends[own]
            elif unit == "utf16":
                pairs = np.flatnonzero(data >= 0xF0)
                units = n + np.searchsorted(pairs, starts) - np.searchsorted(pairs, ends)[own]
            else:
                units = n
            offsets = np.zeros(len(own) + 1, np.int32)
            np.cumsum(stops - starts, out=offsets[1:])
            held = np.ascontiguousarray(data[np.repeat(~plain, np.diff(ends))])
            text = pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets), pa.py_buffer(held))
            whole = np.flatnonzero(plain)
            none = np.zeros(len(whole), np.int64)
            both = lambda a, b: np.concatenate([a, b])
            yield _rows(keys, both(whole, own), {
                "piece": both(none, n // chars).astype(np.int32), "at": both(none, starts - ends[own]), "units": both(none, units).astype(np.int32),
                "size": both(np.diff(ends)[whole], stops - starts).astype(np.int32), "text": pa.concat_arrays([pa.nulls(len(whole), pa.string()), text]),
            })

    return _mapped(files, run, "piece int, at long, units int, size int, text string")
