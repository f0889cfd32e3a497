"""Benchmark decontamination by spaced-seed hashing.

Both sides are cut into words (runs of ASCII letters, digits and non-ASCII bytes,
A-Z lower-cased, so punctuation and case do not matter).  Each fixed mask keeps some
of the positions of a short window of words and ignores the rest; its seed is the hash
of the kept words.  A seed shared by a text and a benchmark item puts the two on a
diagonal; the words on that diagonal are then compared one by one, and the item is
reported where a window of ``window`` words around the hit agrees in at least
``identity`` of its positions.  Substituted words therefore cost positions, not hits.

The masks follow from a rule (``masks_for``): for the length of the window, as many as it
takes that every set of substitutions that the identity allows leaves a seed whole.  So
no overlap is lost for want of a seed: the result is that of comparing all windows.

The benchmark is the stated query set: it is dealt in blocks of at most ``block_bytes``
of text, each block broadcast and held against all documents, so what is broadcast is
bounded however large the benchmark grows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import by_place
from .textbatch import LOWER, Spans, bounds, chunks, mix, utf8

WINDOW = 13
IDENTITY = 0.8
#: Items of fewer words are no evidence and match nothing.
MIN_WORDS = 3
BLOCK_BYTES = 16 << 20
#: Words that a mask may span, and how many masks a window length may take before they keep fewer words.
_SPAN, _MASKS = 13, 4
#: Hits that are held at once.
_HITS = 1 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_FILTER_BITS = 22

SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_matched long"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the word index at which each text starts."""
    starts, ends = bounds(_WORD[data], offsets)
    return Spans(LOWER[data]).hash(starts, ends), np.searchsorted(starts, offsets)


@lru_cache(maxsize=None)
def masks_for(size: int, substitutions: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which some placement in a window of ``size`` words misses any so many substituted words.

    Of the masks that keep most words those are taken, greedily, that miss most of the
    patterns still open; if more than four would be needed, the masks keep a word less.
    """
    patterns = [sum(1 << p for p in c) for c in combinations(range(size), substitutions)]
    for weight in range(size - substitutions, 0, -1):
        cover = {}
        for mask in ((0, *c) for c in combinations(range(1, size), weight - 1)):
            missed = 0
            for at in range(size - mask[-1]):
                bits = sum(1 << p + at for p in mask)
                missed |= sum(1 << k for k, p in enumerate(patterns) if not p & bits)
            cover[mask] = missed
        chosen, open_ = [], (1 << len(patterns)) - 1
        while open_ and len(chosen) < _MASKS:
            chosen.append(max(cover, key=lambda m: ((cover[m] & open_).bit_count(), -m[-1])))
            open_ &= ~cover[chosen[-1]]
        if not open_:
            return tuple(chosen)
    raise ValueError("a window must have more words than substitutions")


def _rule(words: int, window: int, identity: float) -> tuple[int, int]:
    """Length of the windows whose seeds find an item of so many words, and the substitutions in one."""
    size = min(window, words)
    most = size - int(np.ceil(identity * size - 1e-9))
    parts = max(1, size // _SPAN)  # of as many stretches of a long window, one has its share at most
    return min(size, _SPAN), most // parts


def _seeds(words: np.ndarray, mask: tuple[int, ...], k: int) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k + 1, np.uint64)
    for at in mask:
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[at : at + n]
    return mix(total)


class Block:
    """Seeds and words of some benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, identity: float, min_words: int):
        texts = pa.array([t for _, t in items], pa.string())
        self.ids = np.array([i for i, _ in items], np.int64)
        data, offsets = utf8(texts)
        self.words, self.first = _words(data, offsets)
        # Each item has the seeds of the masks for its length.
        lengths, wanted = np.diff(self.first), {}
        for n in np.unique(lengths[lengths >= min_words]).tolist():
            for mask in masks_for(*_rule(n, window, identity)):
                wanted.setdefault(mask, []).append(n)
        self.masks = sorted(wanted)
        seeds, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, mask in enumerate(self.masks):
            s = _seeds(self.words, mask, k)
            item = np.searchsorted(self.first, np.arange(len(s)), "right") - 1
            inside = (np.arange(len(s)) + mask[-1] < self.first[item + 1]) & np.isin(lengths[item], wanted[mask])
            seeds.append(s[inside])
            where.append(np.flatnonzero(inside))
        self.seeds, self.where = np.concatenate(seeds), np.concatenate(where)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.where = self.seeds[order], self.where[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, words: np.ndarray):
        """(position in words, position in self.words) of all equal seeds, in portions of bounded size."""
        for k, mask in enumerate(self.masks):
            s = _seeds(words, mask, k)
            likely = np.flatnonzero(self.filter[s >> np.uint64(64 - _FILTER_BITS)])
            low = np.searchsorted(self.seeds, s[likely], "left")
            count = np.searchsorted(self.seeds, s[likely], "right") - low
            likely, low, count = (x[count > 0] for x in (likely, low, count))
            for a, b in chunks(np.concatenate([[0], np.cumsum(count)]), _HITS):
                n = count[a:b]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(likely[a:b], n), self.where[np.repeat(low[a:b], n) + step]

    def overlaps(self, words: np.ndarray, first: np.ndarray, window: int, identity: float):
        """Rows (text, item, word in text, word in item, words, matched), the best for each text and item."""
        diagonals: set[tuple[int, int, int]] = set()
        for at, of in self.hits(words):
            text = np.searchsorted(first, at, "right") - 1
            item = np.searchsorted(self.first, of, "right") - 1
            order = np.lexsort((at - of, item, text))
            rows = np.stack([text, item, at - of], axis=1)[order]
            head = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
            diagonals.update(map(tuple, rows[head].tolist()))
        best: dict[tuple[int, int], tuple] = {}
        for t, i, shift in sorted(diagonals):
            low = max(int(self.first[i]), int(first[t]) - shift)
            high = min(int(self.first[i + 1]), int(first[t + 1]) - shift)
            size = min(window, int(self.first[i + 1] - self.first[i]))
            if high - low < size:
                continue
            same = np.concatenate([[0], np.cumsum(self.words[low:high] == words[low + shift : high + shift])])
            good = same[size:] - same[:-size] >= identity * size - 1e-9
            if not good.any():
                continue
            a, b = int(np.argmax(good)), len(good) - 1 - int(np.argmax(good[::-1])) + size
            row = (int(same[b] - same[a]), b - a, low + shift + a - int(first[t]), low + a - int(self.first[i]))
            if (t, i) not in best or (row[0], -row[2], -row[3]) > (best[t, i][0], -best[t, i][2], -best[t, i][3]):
                best[t, i] = row
        return [(t, i, r[2], r[3], r[1], r[0]) for (t, i), r in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int, unnamed: bool):
    """The items in blocks of about block_bytes; each is brought to the driver on its own."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    items = items.withColumn("i", F.coalesce("i", F.lit(-1))) if unnamed else items.where("i is not null")
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = -(-int(total) // block_bytes)
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in block.orderBy("i", "t").collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, identity: float = IDENTITY, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap, the best overlap of each.

    Returns doc_id, item_id, doc_word and item_word (where the overlap starts, in words
    of either side), n_words and n_matched.  A pair counts if some window of ``window``
    words (the whole item, if it is shorter) agrees in ``identity`` of its words, up to
    the last such window of the overlap.  Items of fewer than min_words words and items
    with a null id are left out; null and empty texts match nothing; very long texts are
    read whole; an item that occurs several times in a text is reported once; repeated
    rows of either table give one row for each pair of ids; other columns, whatever
    their names, are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for items in _blocks(benchmark, item_id, item_text, block_bytes, False):
        shared = spark.sparkContext.broadcast(Block(items, window, identity, min_words))

        def scan(batches, shared=shared):
            block = shared.value
            for batch in batches:
                ids = batch.column(0)
                data, offsets = utf8(batch.column(1))
                out = []
                for a, b in chunks(offsets):
                    words, first = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    out += [(ids[a + t].as_py(), int(block.ids[i]), *rest) for t, i, *rest in block.overlaps(words, first, window, identity)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = rows.mapInArrow(scan, SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    best = F.max(F.struct("n_matched", -F.col("doc_word"), -F.col("item_word"), -F.col("n_words"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.col2")).alias("doc_word"), (-F.col("b.col3")).alias("item_word"), (-F.col("b.col4")).alias("n_words"), F.col("b.n_matched").alias("n_matched")
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, identity: float = IDENTITY, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs that overlap no benchmark item; all columns stay.

    Each row is judged by its own text in the pass that returns it, once for each block
    of the benchmark, so no join is needed and null or repeated ids, of documents and of
    items, do not matter.  Null, empty and short texts stay; very long ones are read
    whole; columns of any name stay as they are; empty tables are fine.
    """
    at, kept = docs.columns.index(text), docs
    for items in _blocks(benchmark, item_id, item_text, block_bytes, True):
        shared = docs.sparkSession.sparkContext.broadcast(Block(items, window, identity, min_words))

        def keep(batches, shared=shared):
            for batch in batches:
                data, offsets = utf8(batch.column(at))
                clean = np.ones(batch.num_rows, dtype=bool)
                for a, b in chunks(offsets):
                    words, first = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    clean[[a + t for t, *_ in shared.value.overlaps(words, first, window, identity)]] = False
                yield batch.filter(pa.array(clean))

        kept = by_place(kept, keep)
    return kept
