"""Token-ID files: texts encoded by a public tokenizer, in patched frame-of-reference blocks.

A file holds the ids of whole documents, one after the other, in segments of blocks of
256 ids.  Of a block the minimum is subtracted, the rest is packed at the width that a
percentile of its values needs, and the values beyond that width are listed as
exceptions.  A segment begins with the minimum, the width, the number of exceptions and
the start of each of its blocks, so a block is read without those before it.  The
footer lists the segments and the documents; a document is never cut between files.

Documents are dealt by ranges of doc_id before they are encoded, so only texts are
shuffled, and the files in the order of their names hold the ids in that of doc_id.
Files are read and written with ``pyarrow.fs``; their folder must be on a file system
that it knows by URI and that all executors share.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbatch import SPACE, chunks, utf8
from .warc import _fs

BLOCK, SEGMENT = 256, 1 << 18
#: The share of a block's values that its width must hold; the rest are exceptions.
PERCENTILE = 0.98
#: Ids of a file; it ends with the document that reaches them.
FILE_IDS = 32 << 20
#: The id that ends a document.
END = 0
MAGIC = b"PFORIDS1"
#: Encoded pieces that a worker keeps, and the longest piece among them, in bytes.
KEPT, KEPT_BYTES = 600_000, 48


def _widths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values packed at the width, low bits first."""
    small = width <= 16
    flat = np.ascontiguousarray(values.astype("<u2" if small else "<u4")).view(np.uint8)
    bits = np.unpackbits(flat.reshape(len(values), -1), axis=1, bitorder="little").reshape(len(values), BLOCK, 16 if small else 32)
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _values(packed: np.ndarray, width: int) -> np.ndarray:
    """What _bits packed."""
    if width == 0:
        return np.zeros((len(packed), BLOCK), np.uint32)
    size = 16 if width <= 16 else 32
    bits = np.zeros((len(packed), BLOCK, size), np.uint8)
    bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    return np.packbits(bits.reshape(len(packed), -1), axis=1, bitorder="little").view("<u2" if size == 16 else "<u4").astype(np.uint32)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A segment: ids in patched frame-of-reference blocks; the last block is filled up with its last id."""
    n = len(ids)
    count = -(-n // BLOCK)
    whole = np.empty(count * BLOCK, np.uint32)
    whole[:n] = ids
    whole[n:] = ids[-1] if n else 0
    rows = whole.reshape(count, BLOCK)
    least = rows.min(axis=1) if count else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _widths(np.partition(rest, at, axis=1)[:, at]) if count else np.zeros(0, np.uint8)
    beyond = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    row, place = np.nonzero(beyond)
    values = rest[row, place]
    rest[row, place] = 0
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        body[(starts[own][:, None] + np.arange(w * BLOCK // 8)).ravel()] = _bits(rest[own], w).ravel()
    counts = np.bincount(row, minlength=count).astype("<u2")
    head = struct.pack("<IIII", n, count, len(row), len(body))
    return b"".join([head, least.astype("<u4").tobytes(), width.tobytes(), counts.tobytes(), starts[:-1].astype("<u4").tobytes(), body.tobytes(), place.astype(np.uint8).tobytes(), values.astype("<u4").tobytes()])


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids first..last of a segment; only the blocks that hold them are decoded."""
    n, count, extra, size = struct.unpack_from("<IIII", segment)
    at, parts = 16, []
    for kind, many in (("<u4", count), ("<u1", count), ("<u2", count), ("<u4", count), ("<u1", size), ("<u1", extra), ("<u4", extra)):
        parts.append(np.frombuffer(segment, kind, many, at))
        at += parts[-1].nbytes
    least, width, counts, starts, body, place, values = parts
    last = n if last is None else min(last, n)
    a, b = first // BLOCK, -(-last // BLOCK)
    out = np.zeros((max(0, b - a), BLOCK), np.uint32)
    for w in np.unique(width[a:b]).tolist():
        own = np.flatnonzero(width[a:b] == w)
        out[own] = _values(body[starts[a + own].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)], w)
    listed = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    own = slice(listed[a], listed[b] if b > a else listed[a])
    out[np.repeat(np.arange(max(0, b - a)), counts[a:b]), place[own]] = values[own]
    out += least[a:b, None]
    return out.ravel()[first - a * BLOCK : last - a * BLOCK]


class _Writer:
    """One file: whole documents, in segments."""

    def __init__(self, files, draft: str, path: str):
        self.files, self.draft, self.path, self.out = files, draft, path, files.open_output_stream(draft)
        self.out.write(MAGIC)
        self.at, self.segments, self.held, self.waiting, self.ids = len(MAGIC), [], [], 0, 0
        self.docs: list[int] = []
        self.null: list[bool] = []
        self.counts: list[int] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= SEGMENT:
            self._flush(self.waiting // SEGMENT * SEGMENT)

    def _flush(self, n: int) -> None:
        whole = np.concatenate(self.held)
        for a in range(0, n, SEGMENT):
            packed = pack(whole[a : min(a + SEGMENT, n)])
            self.out.write(packed)
            self.segments.append((self.at, len(packed)))
            self.at += len(packed)
        self.held, self.waiting = [whole[n:]], len(whole) - n

    def close(self) -> dict:
        if self.waiting:
            self._flush(self.waiting)
        raw = b"".join([np.array(self.docs, "<i8").tobytes(), np.array(self.null, np.uint8).tobytes(), np.array(self.counts, "<i8").tobytes(), np.array(self.segments, "<i8").reshape(-1, 2).tobytes()])
        footer = pa.compress(raw, codec="zstd", asbytes=True)
        self.out.write(footer + struct.pack("<QQQQQ", len(footer), len(raw), len(self.docs), len(self.segments), self.ids) + MAGIC)
        self.out.close()
        self.files.move(self.draft, self.path)
        return {"path": [self.path], "documents": [len(self.docs)], "ids": [self.ids], "bytes": [self.at]}


class TokenFile:
    """A file opened for reading: its documents, and any run of its ids."""

    def __init__(self, path: str):
        files, inner = _fs(path)
        self.file = files.open_input_file(inner)
        tail = struct.calcsize("<QQQQQ") + len(MAGIC)
        size = self.file.size()
        end = self._read(size - tail, tail) if size >= tail + len(MAGIC) else b""
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is no whole file of token ids")
        packed, raw, docs, segments, self.ids = struct.unpack_from("<QQQQQ", end)
        body = pa.decompress(self._read(size - tail - packed, packed), decompressed_size=raw, codec="zstd", asbytes=True)
        self.docs = np.frombuffer(body, "<i8", docs)
        self.null = np.frombuffer(body, np.uint8, docs, 8 * docs).astype(bool)
        self.counts = np.frombuffer(body, "<i8", docs, 9 * docs)
        self.segments = np.frombuffer(body, "<i8", 2 * segments, 17 * docs).reshape(-1, 2)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def window(self, first: int, last: int) -> np.ndarray:
        """The ids first..last of the file."""
        parts, last = [np.zeros(0, np.uint32)], min(last, self.ids)
        for k in range(first // SEGMENT, -(-last // SEGMENT) if last > first else 0):
            parts.append(unpack(self._read(*self.segments[k].tolist()), max(0, first - k * SEGMENT), last - k * SEGMENT))
        return np.concatenate(parts)


def _visible(second: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a character with these last two bytes is surely no white space."""
    return (last > 0x20) & (last < 0x7F) | (last >= 0x80) & ~_DOUBT[second]


#: Bytes before the last one of characters beyond ASCII that are white space.
_DOUBT = np.zeros(256, dtype=bool)
_DOUBT[[0xC2, 0x80, 0x81, 0x9A]] = True


def _joined(pieces: pa.LargeBinaryArray) -> np.ndarray:
    """Which pieces begin and end where a text may be cut, whatever stands beside them."""
    if not len(pieces):
        return np.zeros(0, dtype=bool)
    data, offsets = utf8(pieces)
    first, last = data[offsets[:-1]], data[offsets[1:] - 1]
    return SPACE[first] & _visible(data[np.maximum(offsets[1:] - 2, 0)], last) & (np.diff(offsets) > 1)


def _edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without a change of their ids: the starts of texts, and white space after a visible character.

    No piece of a byte-level pattern holds white space after another character, so none
    crosses such a place.  Characters beyond ASCII that are, or could be, white space
    are followed by no cut.
    """
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        cut[1:n] = SPACE[data[1:]] & _visible(np.concatenate([[np.uint8(0)], data[:-2]]), data[:-1])
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts piece by piece; pieces seen before are looked up.

    New pieces are encoded many at a time, as one text in which each begins where a text
    may be cut, and told apart again by the bytes that each id stands for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():  # a byte-level vocabulary spells every byte as one character
            self.bytes[i] = len(token)
        self._keep([], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _keep(self, pieces: list[bytes], flat: np.ndarray, ends: np.ndarray) -> None:
        self.known = dict(zip(pieces, itertools.count()))
        self.flat, self.ends, self.uses = flat, ends, np.zeros(len(pieces), np.int32)

    def _forget(self) -> None:
        """Keeps the pieces that came up again, unless they are too many."""
        again = np.flatnonzero(self.uses > 1)
        if len(again) > KEPT // 2:
            again = again[:0]
        names = list(self.known)
        chosen = pa.LargeListArray.from_arrays(self.ends, self.flat).take(pa.array(again))
        self._keep([names[k] for k in again.tolist()], chosen.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(self.ends)[again])]))

    def _encode(self, pieces: list[bytes], joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and how many each has; joined are those that may follow one another in a text."""
        groups, alone = [], [k for k in range(len(pieces)) if not joined[k]]
        own = np.flatnonzero(joined).tolist()
        texts = [pieces[k].decode("utf-8", "replace") for k in alone]
        for at in range(0, len(own), 1024):
            part = own[at : at + 1024]
            try:
                texts.append(b"".join([pieces[k] for k in part]).decode())
                groups.append(part)
            except UnicodeDecodeError:
                alone += part
                texts[len(alone) - len(part) : len(alone) - len(part)] = [pieces[k].decode("utf-8", "replace") for k in part]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.zeros(len(pieces), np.int64)
        counts[alone] = [len(x) for x in found[: len(alone)]]
        for part, ids in zip(groups, found[len(alone) :], strict=True):
            reached = np.cumsum(self.bytes[ids])
            places = np.searchsorted(reached, ends := np.cumsum([len(pieces[k]) for k in part]))
            if (reached[np.minimum(places, len(reached) - 1)] != ends).any():
                raise ValueError("the vocabulary is not byte-level")
            counts[part] = np.diff(places, prepend=-1)
        order = np.array(alone + [k for part in groups for k in part], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts[order])])
        lists = pa.LargeListArray.from_arrays(starts, np.concatenate([np.zeros(0, np.uint32), *found]))
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        return lists.take(pa.array(place)).flatten().to_numpy(), counts

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, and where each text's begin and the last's end."""
        if len(self.known) > KEPT:
            self._forget()
        edges = _edges(data, offsets)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.array([self.known.get(p, -1) for p in distinct], np.int64)
        self.uses[number[number >= 0]] += 1
        new, kept = np.flatnonzero(number < 0), len(self.known)
        # Long pieces are rare and would fill the memory of a worker: they come last and are forgotten.
        sizes = pa.compute.binary_length(coded.dictionary).to_numpy()
        new = new[np.argsort(sizes[new] > KEPT_BYTES, kind="stable")]
        stay = kept + int((sizes[new] <= KEPT_BYTES).sum())
        flat, counts = self._encode([distinct[k] for k in new.tolist()], _joined(coded.dictionary)[new])
        number[new] = np.arange(kept, kept + len(new))
        self.known.update(zip([distinct[k] for k in new[: stay - kept].tolist()], itertools.count(kept)))
        self.flat, self.ends = np.concatenate([self.flat, flat]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.uses = np.concatenate([self.uses, np.ones(stay - kept, np.int32)])
        found = pa.LargeListArray.from_arrays(self.ends, self.flat).take(pa.array(number)).take(coded.indices)
        whole = found.offsets.to_numpy()[np.searchsorted(edges, offsets)]
        flat = found.flatten().to_numpy()
        self.ends = self.ends[: stay + 1]
        self.flat = self.flat[: self.ends[-1]]
        return flat, whole - whole[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine; executors have the same."""
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every text of docs, each followed by ``end``, under folder; returns path, documents, ids and bytes of each file.

    vocabulary is a file of the tokenizers library whose pattern is byte-level; special
    tokens are not added, but their strings in a text are known, as the library does.
    Null and empty texts are the end id alone; very long texts are encoded whole.
    Documents come in ascending doc_id, a null last; rows with one doc_id are in the
    order of a hash of their texts, repeated rows are written each; other columns,
    whatever their names, are not read; an empty table gives no file.  A file is written
    under a name of the attempt and then moved, so a task that runs again replaces it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = _fs(folder)
        files.create_dir(base, recursive=True)
        coder, out, n = encoder(vocabulary), None, 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b in chunks(offsets, 8 << 20):
                flat, at = coder.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(b - a):
                    if out is None:
                        name = f"{context.partitionId():06d}-{n:04d}"
                        out, n = _Writer(files, f"{base}/.{name}-{context.taskAttemptId()}", f"{base}/ids-{name}.pfor"), n + 1
                    out.add(keys[a + k], np.append(flat[at[k] : at[k + 1]], np.uint32(end)))
                    if out.ids >= file_ids:
                        yield pa.RecordBatch.from_pydict(out.close())
                        out = None
        if out is not None:
            yield pa.RecordBatch.from_pydict(out.close())

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return dealt.mapInArrow(write, "path string, documents long, ids long, bytes long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of every document in the files under folder.

    start counts the ids of all documents before it.  A task reads whole files, segment
    by segment.  File names and their numbers of ids reach the driver, nothing of their
    content; an empty or missing folder gives no row, a damaged file is an error.
    """
    from pyarrow import fs

    files, base = _fs(folder)
    found = sorted(i.path for i in files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if i.is_file and i.base_name.startswith("ids-") and i.extension == "pfor")
    paths = [folder[: folder.rindex(base)] + p for p in found]

    def dealt(rows, schema):
        frame = spark.createDataFrame(rows, schema)
        return frame.repartition(min(len(rows), 100_000)) if rows else frame

    def sizes(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"path": names, "ids": [TokenFile(p).ids for p in names]}, schema=pa.schema([("path", pa.string()), ("ids", pa.int64())]))

    counts = dict(dealt([(p,) for p in paths], "path string").mapInArrow(sizes, "path string, ids long").collect())
    starts = list(itertools.accumulate((counts[p] for p in paths), initial=0))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(path)
                ends = np.concatenate([[0], np.cumsum(file.counts)])
                a = 0
                while a < len(file.docs):  # as many documents as a segment has ids, but one at least
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + SEGMENT, "right")) - 1)
                    raw = file.window(int(ends[a]), int(ends[b])).astype("<u4").tobytes()
                    places = (ends[a : b + 1] - ends[a]) * 4
                    ids = [raw[x:y] for x, y in itertools.pairwise(places.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(file.docs[a:b], pa.int64(), mask=file.null[a:b]), pa.array(first + ends[a:b]), pa.array(file.counts[a:b]), pa.array(ids, pa.binary())], schema=schema)
                    a = b

    return dealt(list(zip(paths, starts, strict=False)), "path string, first long").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(shared: str) -> str:
    return f"{shared.rstrip('/')}/tokens-{uuid.uuid4().hex}"


def token_digests(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_tokens returns."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
