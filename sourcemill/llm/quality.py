"""Quality rules with repetition measured on suffix arrays.

For each text the suffixes of its word sequence are sorted by prefix doubling (many
texts share one NumPy pass; suffixes of different texts never compare equal).  The
longest common prefix of each pair of neighbours in that order follows from the ranks
of the doubling steps.  A stretch of neighbours that share a prefix, longer than either
outsider shares with them, is an interval: the occurrences of one repeated substring
that cannot be made longer to the right.  Where the words before them differ, it cannot
be made longer to the left either and is a maximal repeat.  The union of the spans of
all maximal repeats of at least ``min_repeat`` words gives the covered fraction of the
text, the largest gives its longest repeat, and texts beyond either limit are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import by_place
from .textbatch import SPACE, Spans, bounds, chunks, cover, mix, per_text, utf8

MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, n_repeats long, base_failed boolean, kept boolean"
)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def suffix_array(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of all texts in order, the prefix that each shares with the next, and a number for each word.

    tokens: one uint64 for each of one or more words; first: where each text starts, and
    the end.  Suffixes of different texts share nothing; equal words of a text have one number.
    """
    n = len(tokens)
    text = np.searchsorted(first, np.arange(n), "right") - 1
    end = first[text + 1]
    # Ranks by one word: equal exactly for equal words of one text.
    rank = np.empty(n, np.int64)
    key = mix(tokens + mix(text.astype(np.uint64)))
    active = np.argsort(key)
    head = np.ones(n, dtype=bool)
    head[1:] = key[active][1:] != key[active][:-1]
    slots = np.arange(n)
    rank[active] = np.maximum.accumulate(np.where(head, slots, 0))
    order, levels, width = active.copy(), [rank.copy()], 1
    alone = head & np.append(head[1:], True)
    active, slots = active[~alone], slots[~alone]
    while len(active):
        follow = active + width
        inside = follow < end[active]
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        head = np.ones(len(active), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        # A suffix that ends with its text has no longer prefix to share.
        ends = ~inside[by]
        head |= ends
        head[1:] |= ends[:-1]
        order[slots] = active
        rank[active] = np.maximum.accumulate(np.where(head, slots, 0))
        levels.append(rank.copy())
        width *= 2
        alone = head & np.append(head[1:], True)
        active, slots = active[~alone], slots[~alone]
    # Longest common prefixes of neighbours, from the coarsest level down.
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    where = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[where], b[where]
    stop_a, stop_b, got = end[a], end[b], np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < stop_a) & (b < stop_b)
        ok &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        step = np.where(ok, 1 << k, 0)
        got += step
        a = a + step
        b = b + step
    lcp[where] = got
    return order, lcp, levels[0]


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, first and last suffix of each interval of at least ``least`` shared words, and each entry's interval or -1.

    An entry of lcp belongs to the interval with its value.  Intervals nest: those open
    stand on a stack and close where the shared prefix gets shorter.
    """
    value, low, high, held = [], [], [], []
    starts, ends = bounds(lcp >= least, np.array([0, len(lcp)]))
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        open_: list[int] = []
        for at, v in enumerate(lcp[start:end].tolist(), start):
            lowest = at
            while open_ and value[open_[-1]] > v:
                lowest = low[open_[-1]]
                high[open_.pop()] = at
            if not open_ or value[open_[-1]] < v:
                open_.append(len(value))
                value.append(v)
                low.append(lowest)
                high.append(end)
            held.append(open_[-1])
    owner = np.full(len(lcp), -1, np.int64)
    owner[lcp >= least] = held
    return np.array(value, np.int64), np.array(low, np.int64), np.array(high, np.int64), owner


def maximal_repeats(tokens: np.ndarray, first: np.ndarray, least: int):
    """Maximal repeats of at least ``least`` words: (text, length) of each, and (start, length) of spans with the same union as theirs.

    Of the intervals that a suffix lies in, the innermost has the longest span; if it is
    not maximal, a span that begins further left covers it.
    """
    none = np.zeros(0, np.int64)
    if len(tokens) == 0:
        return none, none, none, none
    order, lcp, word = suffix_array(tokens, first)
    value, low, high, owner = intervals(lcp, least)
    if not len(value):
        return none, none, none, none
    text = np.searchsorted(first, np.arange(len(tokens)), "right") - 1
    before = -1 - np.arange(len(tokens))  # nothing comes before the first word of a text
    before[1:] = np.where(text[1:] == text[:-1], word[:-1], before[1:])
    before = before[order]
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    maximal = changes[high] > changes[low]
    inner = np.where(np.append(lcp, 0) >= np.append(0, lcp), np.append(owner, -1), np.append(-1, owner))
    spans = np.flatnonzero((inner >= 0) & maximal[inner])
    return text[order[low[maximal]]], value[maximal], order[spans], value[inner[spans]]


def measures(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each text of one chunk."""
    inside = ~SPACE[data]
    starts, ends = bounds(inside, offsets)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    spans = Spans(data)
    words = spans.hash(starts, ends)
    out = {
        "n_words": n_words,
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
    }
    # Lines with a word, by text and hash.
    line_s, line_e = bounds(data != 0x0A, offsets)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    used = total[line_e] > total[line_s]
    line_s, line_e = line_s[used], line_e[used]
    line_text = np.searchsorted(offsets, line_s, "right") - 1
    keys = np.unique(np.stack([line_text.astype(np.uint64), spans.hash(line_s, line_e)]), axis=1) if len(line_s) else np.zeros((2, 0), np.uint64)
    n_texts = len(offsets) - 1
    out["n_dup_lines"] = np.bincount(line_text, minlength=n_texts) - np.bincount(keys[0].astype(np.int64), minlength=n_texts)
    # Words of three-word windows that occur again.
    n = len(words)
    text = np.searchsorted(first, np.arange(n), "right") - 1
    hit = np.zeros(n, dtype=bool)
    if n >= 3:
        whole = np.flatnonzero(text[2:] == text[:-2])
        three = mix(mix(words[whole] + text[whole].astype(np.uint64)) + words[whole + 1])
        again = whole[_repeated(mix(three + words[whole + 2]))]
        for k in range(3):
            hit[again + k] = True
    out["n_repeat_words"] = per_text(hit, first)
    of, length, at, span = maximal_repeats(words, first, min_repeat)
    out["n_repeats"] = np.bincount(of, minlength=n_texts)
    out["covered_words"] = per_text(cover(at, at + span, n), first)
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, of, length)
    out["longest_repeat"] = longest
    return out


def quality(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Counts and verdict of every document, one row for each row of docs, without a shuffle.

    Words are runs of anything but the six ASCII separators; null counts as an empty
    text, which has no word and fails the base rule; very long texts are handled whole;
    repeated rows each get their row; an empty table gives an empty one; other columns
    are not read.  ``kept`` is false where ``base_failed``, where repeats of at least
    min_repeat words cover more than max_covered of the words, or where the longest
    repeat has more than max_longest words.
    """

    def judge(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts = [measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_repeat) for a, b in chunks(offsets)]
            if not parts:
                continue
            m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            m["base_failed"] = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
            m["kept"] = ~m["base_failed"] & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in names[1:])], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The rows of docs whose text the rules keep; all columns stay, in the same pass.

    The text itself is judged in the pass that returns it, so no join is needed and
    rows with null or repeated ids are judged like any other.  Null and empty texts have
    no words and go; very long ones are judged whole; columns of any name stay as they
    are; an empty table stays empty.
    """
    how = {"min_words": MIN_WORDS, "max_repeat_percent": MAX_REPEAT_PERCENT, "min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST} | how
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            kept = []
            for a, b in chunks(offsets):
                m = measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], how["min_repeat"])
                good = (m["n_words"] >= how["min_words"]) & (100 * m["n_repeat_words"] <= how["max_repeat_percent"] * m["n_words"])
                kept.append(good & (m["covered_words"] <= how["max_covered"] * m["n_words"]) & (m["longest_repeat"] <= how["max_longest"]))
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return by_place(docs, keep)
