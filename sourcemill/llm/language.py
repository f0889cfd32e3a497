"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``order`` is counted on labelled
texts and then frozen.  The code length of a byte after its context follows escape
method C: a symbol seen n times in a context of N counts and d different symbols costs
-log2(n / (N + d)) bits; otherwise the escape costs -log2(d / (N + d)) bits and the
next shorter context is asked, down to a uniform 8 bits.  A context that was never seen
costs nothing to leave.  There is no exclusion.  The language whose tree codes a text
in the fewest bits is the prediction.

A code length depends on the last ``order`` + 1 bytes only, so the trees of all
languages become one table from byte strings to a row of costs; texts are scored by
looking up every byte of the whole text, in NumPy, without a shuffle.

Training takes a bounded sample: at most ``max_docs`` different labelled texts of each
language, chosen by the hash of their text.  The sample is what the driver gathers and
the tables made from it are what is broadcast; both are bounded by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed
from .textbatch import chunks, mix, utf8

ORDER = 4
MAX_DOCS = 300
#: Bytes of training text of each language that the driver gathers.
MAX_BYTES = 4 << 20
MAX_LANGUAGES = 64
UNKNOWN = "und"
#: What stands before the first byte of a text, as context.
_START = b"\n"


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, the order bytes before it and itself as one number; texts start after line ends."""
    ends = offsets[:-1] + order * np.arange(1, len(offsets))
    padded = np.full(len(data) + order * (len(offsets) - 1), _START[0], np.uint64)
    real = np.ones(len(padded), dtype=bool)
    for k in range(1, order + 1):
        real[ends - k] = False
    padded[real] = data
    out = padded.copy()
    for k in range(1, order + 1):
        out[k:] |= padded[:-k] << np.uint64(8 * k)
    return out[real]


class _Table:
    """Open-addressed map from numbers to row indices, looked up in bulk."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.tries = 0
        left = np.arange(len(keys))
        while len(left):
            at = self._slot(keys[left], self.tries)
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, lead = np.unique(at, return_index=True)
            first = np.zeros(len(left), dtype=bool)
            first[lead] = True
            put = free & first
            self.keys[at[put]] = keys[left[put]]
            self.rows[at[put]] = left[put]
            left = left[~put]
            self.tries += 1

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64) + k) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not in the table."""
        at = self._slot(keys, 0)
        found = np.where(self.keys[at] == keys, self.rows[at], -1)
        missing = np.flatnonzero((found < 0) & (self.keys[at] != np.iinfo(np.uint64).max))
        for k in range(1, self.tries):
            at = self._slot(keys[missing], k)
            hit = self.keys[at] == keys[missing]
            found[missing[hit]] = self.rows[at[hit]]
            missing = missing[~hit & (self.keys[at] != np.iinfo(np.uint64).max)]
            if not len(missing):
                break
        return found


class Trees:
    """Frozen context trees of several languages."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        n = len(self.languages)
        counted = []  # for each order: language -> (grams, counts)
        packed = [utf8(pa.array(samples[lang], pa.string())) for lang in self.languages]
        whole = [_grams(data, offsets, order) for data, offsets in packed]
        for k in range(order + 1):
            keep = np.uint64((1 << (8 * (k + 1))) - 1)
            counted.append([np.unique(g & keep, return_counts=True) for g in whole])
        self.costs, self.escapes, self.found, self.contexts = [], [], [], []
        for k in range(order + 1 if n else 0):
            grams = np.unique(np.concatenate([g for g, _ in counted[k]]))
            contexts = np.unique(grams >> np.uint64(8))
            escape = np.zeros((len(contexts), n), np.float32)
            totals, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            for i, (g, c) in enumerate(counted[k]):
                # The symbol is the lowest byte, its context the bytes above it.
                at = np.searchsorted(contexts, g >> np.uint64(8))
                totals[:, i] = np.bincount(at, c, len(contexts))
                kinds[:, i] = np.bincount(at, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[:] = np.where(totals > 0, -np.log2(kinds / (totals + kinds)), 0)
            shorter = self._backoff(grams, k)
            at = np.searchsorted(contexts, grams >> np.uint64(8))
            cost = escape[at] + shorter
            for i, (g, c) in enumerate(counted[k]):
                row = np.searchsorted(grams, g)
                cost[row, i] = -np.log2(c / (totals[at[row], i] + kinds[at[row], i]))
            self.costs.append(cost.astype(np.float32))
            self.escapes.append(escape)
            self.found.append(_Table(grams))
            self.contexts.append(_Table(contexts))

    def _backoff(self, grams: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full((len(grams), len(self.languages)), 8.0, np.float32)
        return self.cost(grams & np.uint64((1 << (8 * k)) - 1), k - 1)

    def cost(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each gram of k + 1 bytes, by language."""
        row = self.found[k].find(grams)
        out = self.costs[k][np.maximum(row, 0)]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            rest = grams[missing]
            context = self.contexts[k].find(rest >> np.uint64(8))
            escape = np.where((context >= 0)[:, None], self.escapes[k][np.maximum(context, 0)], np.float32(0))
            out[missing] = escape + self._backoff(rest, k)
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            cost = self.cost(_grams(data, offsets, self.order), self.order)
            out[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
        return out


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", order: int = ORDER, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, max_languages: int = MAX_LANGUAGES) -> Trees:
    """Context trees from at most max_docs different texts of each language.

    Rows with null text or language, and texts of more than max_bytes, are not used;
    copies of a text count once in each language.  The hashes of the different texts of
    a language are thinned to about twice the number wanted before the smallest are
    taken, up to max_docs texts and max_bytes of them, so no task gathers a whole language
    and the sample has a bound in bytes.  More than max_languages languages are an error;
    with none, every text is ``und``.
    """
    rows = labelled.select(F.col(lang).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & (F.octet_length("t") <= max_bytes))
    hashed = rows.withColumn("h", F.xxhash64("t"))
    different = checkpointed(hashed.groupBy("l", "h").agg(F.min(F.octet_length("t")).alias("n")))
    counts = different.groupBy("l").count().orderBy("l").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Trees({}, order)
    share = F.create_map(*[x for r in counts for x in (F.lit(r.l), F.lit(min(1.0, (2 * max_docs + 50) / r["count"])))])
    thin = different.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("l")] * 1_000_003)
    turn = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1_000_003)), "h")
    whole = thin.withColumns({"k": F.row_number().over(turn), "sum": F.sum("n").over(turn)}).where((F.col("k") <= max_docs) & (F.col("sum") <= max_bytes)).select("l", "h")
    samples: dict[str, list[str]] = {r.l: [] for r in counts}
    # At most max_docs hashes of each language, so the chosen side is bounded.
    for r in hashed.join(F.broadcast(whole), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t")).collect():
        samples[r.l].append(r.t)
    return Trees({k: sorted(v) for k, v in samples.items()}, order)


def identify(docs: DataFrame, trees: Trees, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of every row of docs, from its text alone.

    score is the posterior of the predicted language under equal priors, from the code
    lengths, and lies between 0 and 1.  A text that is null or has no letter is ``und``
    with score 0; so is every text if no language was learned.  Ties go to the first
    language by name.  Whole texts are scored, however long; repeated rows each get
    their row; other columns, whatever their names, are not read; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = "doc_id long, lang_pred string, score double, bits_per_byte double"

    def scan(batches):
        trees = shared.value
        names = np.array([*trees.languages, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            known = np.array(batch.column(2).fill_null(False).to_pylist(), dtype=bool) & bool(trees.languages)
            best, score, rate = np.full(len(known), len(names) - 1), np.zeros(len(known)), np.zeros(len(known))
            for a, b in chunks(offsets, 1 << 18):
                if not trees.languages:
                    break
                own = offsets[a : b + 1] - offsets[a]
                bits = trees.bits(data[offsets[a] : offsets[b]], own)
                pick = bits.argmin(axis=1)
                least = bits[np.arange(b - a), pick]
                best[a:b] = np.where(known[a:b], pick, len(names) - 1)
                score[a:b] = np.where(known[a:b], 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0)
                rate[a:b] = least / np.maximum(1, np.diff(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(text).rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(scan, schema)
