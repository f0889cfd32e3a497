"""Suffix-array dedup by a depth-limited radix sort.

The suffixes of all texts are ordered through ``depth`` bytes only, by passes from the
most significant digit.  A pass keeps only suffixes that are still in a group with a
suffix of another document, and the groups left at the end are exactly the repeated
windows of ``depth`` bytes: their bytes are compared, not their hashes.

1. The first digit deals the suffixes to buckets.  It is the ``gram`` bytes at an anchor
   that each window chooses by its own bytes (the smallest gram hash in it, the leftmost
   of equal ones), so equal windows have equal anchors at equal places, and the windows
   of one anchor, which follow each other, travel as one run of bytes.  Only hashes of
   anchors are shuffled first, packed by block and bucket; anchors that no other document
   has leave the sort.
2. The runs of the anchors left are shuffled once.  In each bucket the suffixes in them
   are sorted by their bytes, digit after digit (``radix``): a pass orders what is left by
   group and next digit, splits the groups, and drops those of one document.

What a block can settle by itself is settled there: of equal runs the one of the smallest
id travels, once, so copies of a passage cost one run for each block, and a stretch of
one repeated letter or rule line one run in all.  Whole copies of a text are settled
first.  An anchor that more than ``hot`` blocks have is taken apart by its last digits at
once: its windows travel on their own, as hashes of 128 bits dealt by themselves, so no
bucket gathers all that surrounds a very common line.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, beside, blocks_of, copies_in, expand, squeeze, steps, unpacked
from .textbatch import Spans, chunks, mix, utf8

DEPTH = 50
GRAM = 28
#: Blocks that may share an anchor before its windows travel on their own.
HOT = 1024
#: Bytes of text for each bucket of anchors and of runs.
BUCKET_BYTES = 48 << 20
_PIECE = 1 << 18
_SLICE = 1 << 16
_LOW, _ANY = np.uint64(63), np.uint64(0xA0761D6478BD642F)
#: A second, independent hash reads the bytes through this table.
_OTHER = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))


def radix(data: np.ndarray, place: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes of data at the places are equal, through depth bytes, to one of a smaller id.

    Each pass sorts the suffixes left by group and by as many next bytes as fit beside
    the group and the row in a 64-bit number.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
    left, group, groups, at = np.arange(len(place)), np.zeros(len(place), np.uint64), 1, 0
    while at < depth and len(left):
        own, held = max(1, (len(left) - 1).bit_length()), (groups - 1).bit_length()
        width = max(1, min(8, depth - at, (64 - own - held) // 8))
        digit = words[place[left] + at].astype(np.uint64) >> np.uint64(64 - 8 * width)
        if held + 8 * width + own > 64:
            raise ValueError("too many suffixes for one slice")
        key = (digit << np.uint64(own)) | np.arange(len(left), dtype=np.uint64)
        if held:
            key |= group << np.uint64(own + 8 * width)
        key.sort()
        order = left[(key & np.uint64((1 << own) - 1)).astype(np.int64)]
        key >>= np.uint64(own)
        head = np.append(True, key[1:] != key[:-1])
        starts, owners = np.flatnonzero(head), ids[order]
        shared = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
        of = np.cumsum(head) - 1
        keep = shared[of]
        left, group, groups, at = order[keep], (np.cumsum(shared) - 1).astype(np.uint64)[of[keep]], int(shared.sum()), at + width
    out = np.zeros(len(place), dtype=bool)
    if len(left):
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.repeat(np.minimum.reduceat(ids[left], starts), np.diff(np.append(starts, len(left))))
        out[left] = ids[left] > least
    return out


def _valid(offsets: np.ndarray, skipped: np.ndarray, depth: int) -> np.ndarray:
    """Places where a window starts that does not cross into the next text, in texts that are not skipped."""
    valid = np.zeros(int(offsets[-1]), dtype=bool)
    some = np.flatnonzero((np.diff(offsets) >= depth) & ~skipped)
    for a, b in zip(offsets[some].tolist(), (offsets[some + 1] - depth + 1).tolist(), strict=True):
        valid[a:b] = True
    return valid


def _runs(data: np.ndarray, valid: np.ndarray, depth: int, gram: int):
    """Hash of the anchor, anchor, first and last window and hash of the bytes of every run of windows with one anchor, piece by piece."""
    width = depth - gram + 1
    for start in range(0, len(data) - depth + 1, _PIECE):
        here = data[start : start + _PIECE + depth - 1]
        at = np.flatnonzero(valid[start : start + min(_PIECE, len(here) - depth + 1)])
        if not len(at):
            continue
        spans = Spans(here)
        g = spans.windows(gram)
        # Smallest hash in width grams, with its distance in the low bits.
        low, have = g & ~_LOW, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:] + np.uint64(step))
            have += step
        anchor = at + (low[at] & _LOW).astype(np.int64)
        head = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
        first = np.flatnonzero(head)
        last = at[np.append(first[1:], len(at)) - 1]
        # The smallest of many hashes is small; mixed once more, it is any.
        yield mix(g[anchor[first]] ^ _ANY), anchor[first] + start, at[first] + start, last + start, spans.hash(at[first], last + depth)


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans one after the other, and their offsets."""
    n = ends - starts
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(offsets[-1], data.dtype)
    for a, b in chunks(offsets, _PIECE):
        x, y = offsets[a], offsets[b]
        out[x:y] = data[np.arange(x, y) + np.repeat(starts[a:b] - offsets[a:b], n[a:b])]
    return out, offsets


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal spans, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    head = np.flatnonzero(np.append(True, start[1:] > reach[:-1])) if len(start) else start
    return start[head], reach[np.append(head[1:], len(start)) - 1] if len(head) else reach


def _leaders(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of key and id, and for each the place in that order of the first of its key."""
    order = np.lexsort((ids, key))
    head = np.append(True, key[order][1:] != key[order][:-1])
    return order, np.flatnonzero(head)[np.cumsum(head) - 1]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """One of n buckets, ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _windows_of(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, depth: int):
    """Run and place in it of the windows of the runs that are equal to one of a smaller id."""
    n = np.diff(offsets) - depth + 1
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    found = radix(data, offsets[of] + at, ids[of], depth)
    return of[found], at[found]


def _settled(data, h, first, last, ids, depth):
    """Rows of runs, and where in the runs, of the windows that a run of a smaller id has; runs come in any order."""
    order = np.argsort(h)
    total = np.cumsum((last - first + 1)[order])
    edges = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    a = 0
    while a < len(order):
        done = total[a - 1] if a else 0
        b = int(edges[np.searchsorted(edges, np.searchsorted(total, done + _SLICE, "right"), "right") - 1]) if total[-1] - done > _SLICE else len(order)
        if b <= a:  # one group of more than a slice
            more = np.searchsorted(edges, a, "right")
            b = int(edges[more]) if more < len(edges) else len(order)
        rows = order[a:b]
        bytes_, offsets = _slices(data, first[rows], last[rows] + depth)
        of, at = _windows_of(bytes_, offsets, ids[rows], depth)
        yield rows[of], at
        a = b


def _spread(rows: np.ndarray, at: np.ndarray, n_places: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the windows at ``at`` in runs, for every place where each run stands."""
    if not len(rows):
        return rows, rows
    # Windows that follow each other are one span of their run.
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    head = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)))
    rows, a, b = rows[head], at[head], at[np.append(head[1:], len(at)) - 1] + depth
    begin = np.cumsum(n_places) - n_places
    n = n_places[rows]
    where = places[np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    return _merged(where + np.repeat(a, n), where + np.repeat(b, n))


def _held(batch: pa.RecordBatch, payload: int = 1, gone: int = 2):
    """Block, bytes, offsets, ids and which texts are settled, of every row of a batch."""
    for i in range(batch.num_rows):
        rows = unpacked(batch.column(payload)[i].as_buffer())
        data, offsets = utf8(rows.column("text"))
        skipped = np.zeros(rows.num_rows, dtype=bool)
        skipped[batch.column(gone)[i].as_py() or []] = True
        yield i, batch.column(0)[i].as_py(), rows, data, offsets, rows.column("id").to_numpy(), skipped


_SHIPPED = "bucket int, block long, kind int, n long, m long, meta binary, places binary, body binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("m", pa.int64()), ("meta", pa.binary()), ("places", pa.binary()), ("body", pa.binary())])
_SPANS, _RUNS, _WINDOWS = 0, 1, 2


def repeated_spans(blocks: DataFrame, *, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(blocks with gone, spans): block, n and spans (starts and ends, packed) that together are all bytes of windows that a smaller id has too."""
    if not 0 < depth - gram < 63:
        raise ValueError("depth - gram must be from 1 to 62")
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bucket_bytes))
    short = np.uint64(64 - min(64, max(33, 10 + int(total).bit_length())))
    held = beside(blocks.select("block", "payload", "here"), copies_in(blocks))
    held = held.select("block", "payload", F.concat("here", F.coalesce("gone", F.array().cast("array<int>"))).alias("gone"))

    def anchors_of(data, offsets, skipped):
        parts = [(h >> short, *rest) for h, *rest in _runs(data, _valid(offsets, skipped, depth), depth, gram)]
        return parts, np.sort(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)

    def different(sorted_):
        return sorted_[np.append(True, sorted_[1:] != sorted_[:-1])] if len(sorted_) else sorted_

    def dealt(sorted_):
        """Bounds of the stretch of sorted hashes of each bucket."""
        return np.searchsorted(_bucket(sorted_ << short, n_buckets), np.arange(n_buckets + 1))

    # First digit: hashes of anchors, to find those that several blocks have.
    def anchors(batches):
        for batch in batches:
            for _, block, _, data, offsets, _, skipped in _held(batch):
                h = different(anchors_of(data, offsets, skipped)[1])
                edges = dealt(h)
                some = np.flatnonzero(np.diff(edges))
                packed = [squeeze(steps(h[edges[k] : edges[k + 1]])) for k in some]
                columns = [pa.array(some, pa.int32()), pa.array(np.full(len(some), block)), pa.array(np.diff(edges)[some]), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "n", "hashes"])

    def shared(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(expand(p.as_py(), n)[0].view(np.uint64)) for p, n in zip(table.column("hashes"), table.column("n").to_numpy(), strict=True)]
        whole = np.sort(np.concatenate(parts))
        edges = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
        n = np.diff(np.append(edges, len(whole)))
        flag = (n > 1).astype(np.uint8) + (n > hot)
        known = whole[edges]
        flags = [pa.compress(flag[np.searchsorted(known, p)].tobytes(), codec="zstd", asbytes=True) for p in parts]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"), "flags": pa.array(flags, pa.binary())})

    first = held.mapInArrow(anchors, "bucket int, block long, n long, hashes binary")
    marks = first.groupBy("bucket").applyInArrow(shared, "block long, bucket int, n long, flags binary")
    marks = marks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "flags"))).alias("marks"))

    # The other digits: the runs left, or the windows of a hot anchor.
    def runs(batches):
        for batch in batches:
            for i, block, _, data, offsets, ids, skipped in _held(batch):
                parts, sorted_ = anchors_of(data, offsets, skipped)
                if not parts:
                    continue
                known = different(sorted_)
                flags = np.frombuffer(b"".join(pa.decompress(m["flags"], decompressed_size=m["n"], codec="zstd", asbytes=True) for m in batch.column(3)[i].as_py()), np.uint8)
                h, anchor, start, last, content = (np.concatenate(p) for p in zip(*parts, strict=True))
                of = np.searchsorted(known, h)
                text = np.searchsorted(offsets, start, "right") - 1
                own = ids[text]
                low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
                np.minimum.at(low, of, own)
                np.maximum.at(high, of, own)
                wanted = (flags[of] > 0) | (low[of] != high[of])
                h, anchor, start, last, own, content, mark = (x[wanted] for x in (h, anchor, start, last, own, content, flags[of]))
                if not len(h):
                    continue
                # Of equal runs the one of the smallest id goes on; bytes decide whether they are equal.
                order, lead = _leaders(mix(h) ^ content, own)
                leader = order[lead]
                n = last[order] + depth - start[order]
                same = n == last[leader] + depth - start[leader]
                rest = np.flatnonzero(same & (order != leader))
                if len(rest):
                    a, ends = _slices(data, start[order[rest]], start[order[rest]] + n[rest])
                    b, _ = _slices(data, start[leader[rest]], start[leader[rest]] + n[rest])
                    same[rest] = np.add.reduceat(a != b, ends[:-1]) == 0
                alone = ~same | (order == leader)
                leader = np.where(alone, order, leader)
                done = own[order] > own[leader]
                spans = [(start[order[done]], last[order[done]] + depth)]
                # Rows of the others, with all places where their run stands in texts of its id.
                order, leader = order[~done], leader[~done]
                by = np.lexsort((start[order], leader))
                order, leader = order[by], leader[by]
                head = np.flatnonzero(np.append(True, leader[1:] != leader[:-1]))
                row, n_places, places = leader[head], np.diff(np.append(head, len(leader))), start[order]
                local = mark[row] == 0
                if local.any():  # no other block has the anchor
                    mine = np.flatnonzero(local)
                    for of, at in _settled(data, h[row[mine]], start[row[mine]], last[row[mine]], own[row[mine]], depth):
                        spans.append(_spread(mine[of], at, n_places, places, depth))
                yield from shipped(block, data, row, h, anchor, start, last, own, mark, n_places, places, spans)

    def shipped(block, data, row, h, anchor, start, last, own, mark, n_places, places, spans):
        out = []
        begin = np.cumsum(n_places) - n_places
        spread = lambda rows: places[np.repeat(begin[rows] - np.cumsum(n_places[rows]) + n_places[rows], n_places[rows]) + np.arange(n_places[rows].sum())]
        go = np.flatnonzero(mark[row] == 1)
        bucket = _bucket(h[row[go]] << short, n_buckets)
        go = go[np.lexsort((start[row[go]], bucket))]
        bucket = np.sort(bucket)
        edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            g = go[edges[k] : edges[k + 1]]
            r = row[g]
            body, ends = _slices(data, start[r], last[r] + depth)
            meta = squeeze(np.diff(ends), anchor[r] - start[r], steps(own[r]), n_places[g])
            where = spread(g)
            out.append((int(k), block, _RUNS, len(g), len(where), meta, squeeze(steps(where)), pa.compress(body.tobytes(), codec="zstd", asbytes=True)))
        go = np.flatnonzero(mark[row] == 2)
        if len(go):
            r = row[go]
            body, ends = _slices(data, start[r], last[r] + depth)
            n = last[r] - start[r] + 1
            of = np.repeat(np.arange(len(r)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            w, v = Spans(body).hash(ends[of] + at, ends[of] + at + depth), Spans(_OTHER[body]).hash(ends[of] + at, ends[of] + at + depth)
            times = n_places[go][of]
            where = spread(go)
            begun = np.cumsum(n_places[go]) - n_places[go]
            where = where[np.repeat(begun[of] - np.cumsum(times) + times, times) + np.arange(times.sum())] + np.repeat(at, times)
            w, v, who = (np.repeat(x, times) for x in (w, v, own[r][of]))
            order, lead = _leaders(w ^ mix(v), who)
            late = who[order] > who[order[lead]]
            spans.append((where[order[late]], where[order[late]] + depth))
            w, v, who, where, lead = (x[~late] for x in (w[order], v[order], who[order], where[order], lead))
            head = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
            times = np.diff(np.append(head, len(lead)))
            bucket = _bucket(w[head], n_buckets)
            for k in np.unique(bucket):
                g = np.flatnonzero(bucket == k)
                own_places = np.repeat(head[g] - np.cumsum(times[g]) + times[g], times[g]) + np.arange(times[g].sum())
                out.append((int(k), block, _WINDOWS, len(g), len(own_places), squeeze(w[head[g]], v[head[g]], who[head[g]], times[g]), squeeze(where[own_places]), None))
        a, b = _merged(np.concatenate([x for x, _ in spans]), np.concatenate([y for _, y in spans]))
        if len(a):
            out.append((int(block) % n_buckets, block, _SPANS, len(a), 0, squeeze(steps(a), b - a), None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def settle(table: pa.Table) -> pa.Table:
        """Spans, by block, of one bucket."""
        rows = [dict(zip(table.column_names, r, strict=True)) for r in zip(*(c.to_pylist() for c in table.columns), strict=True)]
        out = [(r["block"], r["n"], r["meta"]) for r in rows if r["kind"] == _SPANS]
        data, h, n, own, times, places, of, kinds = [], [], [], [], [], [], [], []
        for k, r in enumerate(rows):
            if r["kind"] == _RUNS:
                length, offset, ids, count = expand(r["meta"], r["n"], 4)
                body = np.frombuffer(pa.decompress(r["body"], decompressed_size=int(length.sum()), codec="zstd", asbytes=True), np.uint8)
                at = np.cumsum(length) - length + offset
                data.append(body)
                h.append(Spans(body).hash(at, at + gram))
                n.append(length)
                own.append(np.cumsum(ids))
                places.append(np.cumsum(expand(r["places"], r["m"])[0]))
                times.append(count)
                of.append(np.full(r["n"], k))
        if data:
            data, h, n, own, times, places, of = (np.concatenate(x) for x in (data, h, n, own, times, places, of))
            first = np.cumsum(n) - n
            found = [*_settled(data, h, first, first + n - depth, own, depth)]
            run, at = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            begin = np.searchsorted(of, np.arange(len(rows) + 1))
            begun = np.concatenate([[0], np.cumsum(times)])
            order = np.argsort(run, kind="stable")
            run, at = run[order], at[order]
            cuts = np.searchsorted(run, begin)
            for k in np.flatnonzero(np.diff(cuts)):
                r = slice(begin[k], begin[k + 1])
                a, b = _spread(run[cuts[k] : cuts[k + 1]] - begin[k], at[cuts[k] : cuts[k + 1]], times[r], places[begun[begin[k]] : begun[begin[k + 1]]], depth)
                out.append((rows[k]["block"], len(a), squeeze(steps(a), b - a)))
        kinds = [r for r in rows if r["kind"] == _WINDOWS]
        if kinds:
            w, v, own, times = np.concatenate([expand(r["meta"], r["n"], 4) for r in kinds], axis=1)
            order = np.lexsort((own, v, w))
            head = np.append(True, (w[order][1:] != w[order][:-1]) | (v[order][1:] != v[order][:-1]))
            least = own[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
            late = np.zeros(len(w), dtype=bool)
            late[order] = own[order] > least
            ends = np.cumsum([r["n"] for r in kinds])
            for r, end in zip(kinds, ends, strict=True):
                part = slice(end - r["n"], end)
                where = expand(r["places"], r["m"])[0][np.repeat(late[part], times[part])]
                a, b = _merged(where, where + depth)
                out.append((r["block"], len(a), squeeze(steps(a), b - a)))
        return pa.table({"block": pa.array([x for x, *_ in out], pa.int64()), "n": pa.array([x for _, x, _ in out], pa.int64()), "spans": pa.array([x for *_, x in out], pa.binary())})

    second = beside(held, marks).mapInArrow(runs, _SHIPPED)
    return held, second.groupBy("bucket").applyInArrow(settle, "block long, n long, spans binary")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(flags.view(np.uint8), offsets[full], dtype=np.int64)
    return out


def _left(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """How many bytes of each text go, and what is left of it."""
    removed = _sums(gone, offsets)
    at = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
    left = data[~gone].tobytes()
    return removed, [left[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _cut(blocks: DataFrame, schema, make, **options) -> DataFrame:
    """make(rows, data, offsets, gone) for every block, gone being the bytes to remove."""
    held, spans = repeated_spans(blocks, **options)
    lists = spans.groupBy("block").agg(F.collect_list(F.struct("n", "spans")).alias("spans"))

    def apply(batches):
        for batch in batches:
            for i, _, rows, data, offsets, _, skipped in _held(batch):
                parts = [(offsets[:-1][skipped], offsets[1:][skipped])]
                for s in batch.column(3)[i].as_py() or []:
                    a, n = expand(s["spans"], s["n"], 2)
                    parts.append((np.cumsum(a), np.cumsum(a) + n))
                gone = np.zeros(len(data), dtype=bool)
                a, b = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    gone[x:y] = True
                yield make(rows, data, offsets, gone)

    return beside(held, lists).mapInArrow(apply, schema)


def dedup_suffixes(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM, texts: bool = False, hot: int = HOT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Every document without the bytes of windows of depth bytes that also start in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept: the
    remaining bytes, of which any that no longer make a character are left out.  Windows
    are judged on the input and never cross documents.  Null and empty texts, and texts
    under depth bytes, come back whole; a very long text is a block of its own, whose
    windows are taken in pieces; a null doc_id is larger than all others; rows with the
    same doc_id don't count against each other, and each get their row; other columns,
    whatever their names, are not read; an empty table gives an empty result.
    """
    blocks = blocks_of(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", ["doc_id"], least=depth, block_bytes=block_bytes)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts

    def make(rows, data, offsets, gone):
        edge = np.append(True, ~gone[:-1]) if len(gone) else gone
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        removed, kept = _left(data, offsets, gone)
        columns = [rows.column("row"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(_sums(gone & edge, offsets)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.RecordBatch.from_arrays(columns + ([pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())] if texts else []), names=["row", *names])

    schema = "row struct<doc_id: bigint>, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts
    return _cut(blocks, schema, make, depth=depth, gram=gram, hot=hot).select("row.doc_id", *names)


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with what dedup_suffixes removes cut out of the text; all columns and rows stay, whatever their names; null texts stay null."""
    carry = [c for c in docs.columns if c != text]
    blocks = blocks_of(docs, doc_id, text, carry, least=depth, block_bytes=block_bytes)
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text).cast("string").alias("text")).schema

    def make(rows, data, offsets, gone):
        null = rows.column("text").is_null().to_pylist()
        texts = [None if x else k.decode("utf-8", "ignore") for x, k in zip(null, _left(data, offsets, gone)[1], strict=True)]
        return pa.RecordBatch.from_arrays([rows.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    cleaned = _cut(blocks, schema, make, depth=depth, gram=gram, hot=hot)
    return cleaned.select(*(F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
