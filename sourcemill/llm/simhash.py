"""SimHash near-duplicates by deletion-variant signatures.

The fingerprint of a text has one bit for each bit position of the hashes of its word
shingles: 1 if it is set in more than half of them.  Two fingerprints that differ in
at most d bits, cut into m segments with 2 m > d, have a segment in which they differ in
at most one bit.  Each segment is therefore indexed once for each of its bits with that
bit left out (its one-wildcard variants), and fingerprints that share a variant are
compared.  Equal fingerprints are merged first, so copies never meet as pairs.

``near_duplicates`` links fingerprints of 64 bits at a small distance, completely.  A
similarity of 0.8 lies far beyond what two or three segments of 64 bits can find, so
``representatives`` makes a wide fingerprint of 384 bits of the different shingles and
leaves out all but a few bits at a time: ``cuts`` are as many as it takes for 99 in 100
pairs of that similarity to agree in one, and all that share a cut are compared on all
bits.  Cuts that have most of their bits in common form a bundle, so a text is sent once
for several cuts.  Fingerprints only propose: a link counts if the sets of shingles
themselves reach the similarity.

A variant shared by more than ``BUCKET`` different fingerprints is not compared pair by
pair.  Its fingerprints get the variants of the whole fingerprint with any d bits left
out; those that share one differ in at most d bits and are linked in a chain, without a
comparison, and no such variant is shared by more than 2^d fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components
from .session import checkpointed
from .spans import keyed, written
from .textbatch import LOWER, SPACE, Spans, bounds, chunks, mix, utf8

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
BUCKET = 32
_BLOCK = 1 << 16


def shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """Normalised bytes, start and end of every shingle in them, and where each text's shingles begin.

    Texts are lower-cased (A-Z) and their words joined by one space.  A text with fewer
    than k words has one shingle, the whole sequence; one without words has none.
    """
    inside = ~SPACE[data]
    starts, ends = bounds(inside, offsets)
    first = np.searchsorted(starts, offsets)
    keep = inside.copy()
    last = np.zeros(len(starts) + 1, dtype=bool)
    last[first[1:] - 1] = True  # for a text without words this marks the last word before it, which is one already
    if len(starts):
        keep[ends[~last[:-1]]] = True
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    plain = np.where(inside, LOWER[data], 0x20).astype(np.uint8)[keep]
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    step = np.arange(begin[-1]) - np.repeat(begin[:-1], count)
    head = np.repeat(first[:-1], count) + step
    tail = head + np.repeat(np.minimum(n, k), count) - 1
    return plain, before[starts[head]] if len(head) else head, before[ends[tail]] if len(tail) else tail, begin


def majority(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from the hashes of its shingles."""
    counts = np.zeros((len(begin) - 1, 64), np.int64)
    for a in range(0, len(hashes), _BLOCK):
        b = min(a + _BLOCK, len(hashes))
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        texts = np.arange(np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, b, "left"))
        texts = texts[begin[texts] < begin[texts + 1]]
        counts[texts] += np.add.reduceat(bits, np.maximum(begin[texts] - a, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * counts > np.diff(begin)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _hashes(plain: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    text, digest = plain.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row of docs; null and wordless texts have 0."""

    def scan(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = [np.zeros(0, np.uint64)]
            for a, b in chunks(offsets):
                plain, starts, ends, begin = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                out.append(majority(_hashes(plain, starts, ends, seed), begin))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, "doc_id long, fp long")


def links(nodes: DataFrame, *, max_distance: int = MAX_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b) for enough pairs of the distinct fingerprints nodes(fp) at max_distance or less to connect all of them.

    Every pair within the distance is joined by a path of the links returned, and every
    link is within it.  max_distance may be 1 or 2 (two segments of 32 bits).
    """
    if max_distance not in (1, 2):
        raise ValueError("max_distance must be 1 or 2")
    variant = "shiftleft(cast(i as bigint), 32) | (shiftrightunsigned(fp, if(i < 32, 0, 32)) & 4294967295L & ~shiftleft(1L, i % 32))"
    index = nodes.select("fp", F.explode(F.expr(f"transform(sequence(0, 63), i -> {variant})")).alias("key"))
    index = index.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    near = f"x -> transform(filter(f, y -> y > x and bit_count(x ^ y) <= {max_distance}), y -> struct(x as a, y as b))"
    small = index.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("f"))
    small = small.select(F.explode(F.expr(f"flatten(transform(f, {near}))")).alias("p")).select("p.a", "p.b")
    masks = [~sum(1 << i for i in bits) for bits in combinations(range(64), max_distance)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m + (1 << 64) if m < -(1 << 63) else m for m in masks]
    left = index.where(F.col("n") > bucket).select("fp").distinct()
    left = left.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    turn = Window.partitionBy("mask", F.col("fp").bitwiseAND(F.col("mask"))).orderBy("fp")
    chain = left.select(F.lag("fp").over(turn).alias("a"), F.col("fp").alias("b")).where("a is not null")
    return small.unionByName(chain).distinct()


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE, seed: int = SEED
) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs.

    Fingerprints at max_distance or less are linked; component_id is the smallest doc_id
    that links reach, itself included.  Texts without words have the fingerprint zero and
    link like any other; repeated rows each get their row; a null doc_id takes part in
    links but is never a component_id unless the component has no other, which is then
    null; very long texts are hashed whole; other columns, whatever their names, are not
    read; an empty table gives an empty result.
    """
    found = checkpointed(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, seed=seed))
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(nodes.select("fp"), max_distance=max_distance))
    rooted = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # A component may be large: its smallest id is summed up first, and joined back.
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    rooted = rooted.join(least, "root").select(F.col("fp").alias("node"), "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.join(rooted, F.col("fp") == F.col("node")).select("doc_id", hexed, "component_id")


#: The wide fingerprint: words of 64 bits.
WORDS = 6
#: Of the sets of different shingles: what two texts share, as part of what either has (Jaccard).
SIMILARITY = 0.8
#: Bits of a cut, and how many texts may meet in one by chance before cuts get wider.
WIDTH, CHANCE = 14, 1024
#: Cuts of a bundle, and the bits that each has for itself.
BUNDLE, OWN = 4, 7
#: The share of pairs at the similarity asked for that the cuts must bring together.
RECALL = 0.99
#: Texts that share a cut are compared pair by pair in one pass up to FEW; a text with more than MANY links is followed at once.
FEW, MANY, _TILE = 32, 64, 4096


def differing(similarity: float) -> tuple[int, int]:
    """How many bits differ between fingerprints of two sets at that Jaccard similarity: the number that the cuts are made for, and the most that is looked at.

    One and three standard deviations above the mean.  Of sets at one similarity, those
    of equal size have the smallest cosine, 2 s / (1 + s).
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    deviation = np.sqrt(64 * WORDS * p * (1 - p))
    return round(64 * WORDS * p + deviation), round(64 * WORDS * p + 3 * deviation)


def _distinct(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, ascending, and where each text's begin."""
    plain, starts, ends, begin = shingles(data, offsets, k)
    h, text = Spans(plain).hash(starts, ends), np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(begin)))


def signatures(rows: DataFrame, *, shingle: int) -> DataFrame:
    """nid, id and s0, s1, ... (the wide fingerprint of the different shingles) of rows(nid, id, text)."""

    def scan(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            out = [np.zeros((0, WORDS), np.uint64)]
            for a, b in chunks(offsets, 1 << 19):
                h, begin = _distinct(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                out.append(np.stack([majority(mix(h + np.uint64(k)), begin) for k in range(WORDS)], axis=1))
            flat = np.concatenate(out).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(flat[:, k]) for k in range(WORDS))], names=["nid", "id", *(f"s{k}" for k in range(WORDS))])

    return rows.select("nid", "id", "text").mapInArrow(scan, "nid long, id long, " + ", ".join(f"s{k} long" for k in range(WORDS)))


def shingle_sets(rows: DataFrame, *, shingle: int) -> DataFrame:
    """nid and shingles (32 bits of the hash of each different one) of rows(nid, text)."""

    def scan(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, 1 << 20):
                h, begin = _distinct(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                values = pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), values)], names=["nid", "shingles"])

    return rows.select("nid", "text").mapInArrow(scan, "nid long, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets(nid, shingles) have a Jaccard similarity of at least that."""
    x, y = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def cuts(n: int, most: int, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """Bit positions that the cuts of a bundle have in common (bundle x bits), and those of each (bundle x cut x bits).

    A cut is a choice of bits; two fingerprints meet where they agree in all bits of one.
    The cuts of a bundle differ in OWN bits only.  Bundles are added until their cuts
    catch the share recall of random patterns of ``most`` differing bits, which are the
    hardest pairs that the check accepts.  The width of a cut grows with the number n of
    fingerprints, so that few meet by chance.
    """
    rng, bits = np.random.default_rng(SEED), 64 * WORDS
    common = max(WIDTH, int(np.ceil(np.log2(max(n, 1) / CHANCE)))) - OWN
    size = common + BUNDLE * OWN
    differ = rng.permuted(np.tile(np.arange(bits) < most, (20000, 1)), axis=1)
    out, caught = [], np.zeros(len(differ), dtype=bool)
    while caught.mean() < recall:
        order = rng.permutation(bits)
        for at in range(0, bits - size + 1, size):
            out.append(order[at : at + size])
            own = differ[:, out[-1][common:]].reshape(-1, BUNDLE, OWN).any(axis=2)
            caught |= ~differ[:, out[-1][:common]].any(axis=1) & ~own.all(axis=1)
            if caught.mean() >= recall:
                break
    chosen = np.array(out)
    return chosen[:, :common], chosen[:, common:].reshape(-1, BUNDLE, OWN)


def _near(x: np.ndarray, y: np.ndarray, most: int):
    """Indices of the pairs of the fingerprints x and y that differ in at most ``most`` bits."""
    found = []
    for at in range(0, len(y), _TILE):
        part, half = y[at : at + _TILE], WORDS // 2
        some = np.zeros((len(x), len(part)), np.uint8)
        for k in range(half):
            some += np.bitwise_count(x[:, None, k] ^ part[None, :, k])
        i, j = np.nonzero(some <= most)
        if len(i):
            ok = np.bitwise_count(x[i] ^ part[j]).sum(axis=1, dtype=np.int64) <= most
            found.append((i[ok], j[ok] + at))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links i, j, taken in their order, join what those before leave apart."""
    root: dict[int, int] = {}

    def top(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    keep = np.zeros(len(i), dtype=bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if (a := top(a)) != (b := top(b)):
            root[max(a, b)], keep[k] = min(a, b), True
    return keep


def _crowd(words: np.ndarray, most: int):
    """Links that connect what links within one large cut connect, as arrays of indices.

    Every pair is compared unless a path of links joins it already: a text with many
    links is followed to the end and all it reaches leaves the others, which are
    compared in blocks.
    """
    rest = np.arange(len(words))
    while len(rest) > 1:
        block = rest[:FEW]
        i, j = _near(words[block], words[rest], most)
        i, j = i[j > i], j[j > i]
        many = np.flatnonzero(np.bincount(i, minlength=len(block)) > MANY)
        if not len(many):
            yield block[i], rest[j]
            rest = rest[FEW:]
            continue
        front, rest, step = rest[many[:1]], np.delete(rest, many[0]), 1
        while len(front) and len(rest):
            reached, at = [], 0
            while at < len(front) and len(rest):
                own, at, step = front[at : at + step], at + step, min(2 * step, FEW)
                i, j = _near(words[own], words[rest], most)
                j, first = np.unique(j, return_index=True)
                yield own[i[first]], rest[j]
                reached.append(rest[j])
                rest = np.delete(rest, j)
            front = np.concatenate(reached)


def _linked(keys: np.ndarray, words: np.ndarray, most: int):
    """Links between rows with the same key, which are sorted by it: indices of their ends."""
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    sizes = np.diff(starts)
    after = np.repeat(starts[1:], sizes) - np.arange(len(keys)) - 1
    after[np.repeat(sizes > FEW, sizes)] = 0
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, d = np.flatnonzero(after > 0), 1
    while len(i):
        some = np.bitwise_count(words[i, : WORDS // 2] ^ words[i + d, : WORDS // 2]).sum(axis=1, dtype=np.uint8)
        x = i[some <= most]
        x = x[np.bitwise_count(words[x] ^ words[x + d]).sum(axis=1, dtype=np.int64) <= most]
        left.append(x)
        right.append(x + d)
        d += 1
        i = i[after[i] >= d]
    for k in np.flatnonzero(sizes > FEW):
        for x, y in _crowd(words[starts[k] : starts[k + 1]], most):
            left.append(x + starts[k])
            right.append(y + starts[k])
    return _closest(np.concatenate(left), np.concatenate(right), words)


def _closest(left: np.ndarray, right: np.ndarray, words: np.ndarray):
    """A forest of the links: of those that would close a circle the most distant are left out."""
    far = np.bitwise_count(words[left] ^ words[right]).sum(axis=1, dtype=np.int64)
    order = np.lexsort((np.maximum(left, right), np.minimum(left, right), far))
    left, right = left[order], right[order]
    keep = _forest(left, right)
    return left[keep], right[keep]


def _bundled(keys: np.ndarray, words: np.ndarray, bundle: np.ndarray, own: np.ndarray, most: int):
    """Links between rows with the same key that agree in a cut of their bundle: indices of their ends.

    keys are sorted; bundle is the number of each row's bundle, and own the bit positions
    of each bundle's cuts beyond those that the key stands for.
    """
    left, right = [], []
    for c in range(BUNDLE):
        full = np.empty(len(keys), np.int64)
        for at in range(0, len(keys), _BLOCK):
            where, some = own[bundle[at : at + _BLOCK], c], words[at : at + _BLOCK]
            bits = np.take_along_axis(some, where >> 6, axis=1) >> (where & 63).astype(np.uint64) & np.uint64(1)
            full[at : at + _BLOCK] = bits.astype(np.int64) @ (1 << np.arange(OWN, dtype=np.int64))
        full += keys << OWN
        order = np.argsort(full, kind="stable")
        i, j = _linked(full[order], words[order], most)
        left.append(order[i])
        right.append(order[j])
    left, right = np.concatenate(left), np.concatenate(right)
    return _closest(left, right, words)


def similar_links(found: DataFrame, *, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes of found(nid, s0, ...), no two of them with equal fingerprints, that may have the similarity.

    All nodes that share a cut are compared, however many they are.  Of the pairs that
    differ in no more bits than the similarity allows, those are returned that connect
    all that they connect, the closest first.
    """
    hard, most = differing(similarity)
    names = [f"s{k}" for k in range(WORDS)]
    common, own = cuts(found.count(), hard)
    n, width = common.shape
    schema = "key long, nid long, " + ", ".join(f"{c} long" for c in names)

    def cut(batches):
        powers, base = 1 << np.arange(width, dtype=np.int64), np.arange(n, dtype=np.int64) << width
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                words = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                keys = bits[:, common.ravel()].reshape(len(batch), n, width) @ powers + base
                spread = [np.repeat(c, n) for c in (batch.column(0).to_numpy(zero_copy_only=False), *words.T)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *map(pa.array, spread)], names=["key", "nid", *names])

    def compare(batches):
        def links_of(parts):
            key, nid, words = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = _bundled(key, words, key >> width, own, most)
            return pa.RecordBatch.from_arrays([pa.array(nid[a]), pa.array(nid[b])], names=["a", "b"])

        held = []
        for batch in batches:
            if not len(batch):
                continue
            key, nid, *words = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            words = np.stack(words, axis=1).view(np.uint64)
            last = np.searchsorted(key, key[-1])
            if last or (held and held[-1][0][-1] != key[0]):
                yield links_of([*held, (key[:last], nid[:last], words[:last])])
                held = []
            held.append((key[last:], nid[last:], words[last:]))
        if held:
            yield links_of(held)

    index = found.select("nid", *names).mapInArrow(cut, schema)
    return index.repartition("key").sortWithinPartitions("key", "nid").mapInArrow(compare, "a long, b long").distinct()


#: Shingles of a block of a crowd; two blocks are compared in one task.
CROWD_SHINGLES = 4 << 20


def _between(left: np.ndarray, right: np.ndarray, part: np.ndarray, values: np.ndarray, offsets: np.ndarray, similarity: float):
    """Links between the sets left and right of different parts that connect all parts that links connect: indices of their ends.

    Common shingles are counted along an inverted index of the right sets.
    """
    size = np.diff(offsets)
    places = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in right.tolist()]) if len(right) else np.zeros(0, np.int64)
    order = np.argsort(values[places], kind="stable")
    posted, owner = values[places][order], np.repeat(np.arange(len(right)), size[right])[order]
    found_left, found_right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in left.tolist():
        own = values[offsets[k] : offsets[k + 1]]
        a, b = np.searchsorted(posted, own, "left"), np.searchsorted(posted, own, "right")
        n = b - a
        hits = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        common = np.bincount(owner[hits], minlength=len(right))
        near = (common >= similarity * (size[k] + size[right] - common)) & (part[right] != part[k])
        found_right.append(right[near])
        found_left.append(np.full(int(near.sum()), k))
    i, j = np.concatenate(found_left), np.concatenate(found_right)
    keep = _forest(part[i], part[j])
    return i[keep], j[keep]


def crowd_links(nodes: DataFrame, *, similarity: float, block: int = CROWD_SHINGLES) -> DataFrame:
    """(a, b): links between different parts of the crowds of nodes(root, nid, part, shingles) that connect all parts that links connect.

    Every set outside the largest part of a crowd is compared with all sets of other
    parts, in tasks of two blocks of sets each; no pair becomes a row but the links kept.
    """
    parts = nodes.groupBy("root", "part").agg(F.sum(F.size("shingles")).alias("n"))
    crowd = parts.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    crowd = crowd.where("all > most").select("root", "main", F.ceil((F.col("all") - F.col("most")) / block).alias("r"), F.ceil(F.col("most") / block).alias("m"))
    rows = nodes.join(crowd, "root").withColumn("rare", F.col("part") != F.col("main"))
    own = F.when(F.col("rare"), F.expr("pmod(xxhash64(nid), r)")).otherwise(F.expr("r + pmod(xxhash64(nid), m)"))
    rows = rows.withColumn("own", own).withColumn("j", F.explode(F.expr("sequence(0L, if(rare, r + m, r) - 1)")))
    rows = rows.select("root", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "own", "nid", "part", "shingles")

    def compare(batches):
        def links_of(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            i, j, own, nid, part = (table.column(k).to_numpy() for k in range(1, 6))
            lists = table.column(6).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            a, b = _between(np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0]), part, lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64), similarity)
            return pa.RecordBatch.from_arrays([pa.array(nid[a]), pa.array(nid[b])], names=["a", "b"])

        held, now = [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                if held and tuple(keys[x]) != now:
                    yield links_of(held)
                    held = []
                now = tuple(keys[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield links_of(held)

    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(compare, "a long, b long")


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near-duplicates: of each group that links connect, the smallest doc_id stays.

    Two texts are linked if their sets of shingles have a Jaccard similarity of at least
    ``similarity``.  Fingerprints propose pairs; of a crowd that they connect only the
    closest are looked at first.  Where one of those falls short of the similarity, all
    sets of the crowd that are not linked yet are compared, so no link is lost behind it.

    All columns stay.  Texts with equal sets are one group from the start; all texts
    without words are one group; rows repeated with the same doc_id and text leave one
    row; a null doc_id comes after all others; very long texts are hashed whole; columns
    of any name stay as they are; an empty table stays empty.
    """
    rows = keyed(docs, doc_id, text).select("text", "id", "th")
    unique = rows.where("th <> 0").limit(1).count() == 0
    nid = F.col("id") if unique else F.xxhash64("id", "th")
    rows = rows.select(nid.alias("nid"), "id", "text")
    found = checkpointed(signatures(rows, shingle=shingle))
    same = [f"s{k}" for k in range(WORDS)]
    first = checkpointed(found.groupBy(*same).agg(F.min(F.struct("id", "nid")).alias("f")).select(*same, "f.id", "f.nid"))
    proposed = checkpointed(similar_links(first, similarity=similarity))
    ends = proposed.select(F.col("a").alias("nid")).unionByName(proposed.select(F.col("b").alias("nid"))).distinct()
    needed = rows.join(ends.hint("shuffle_hash"), "nid", "left_semi")
    sets = written(shingle_sets(needed if unique else needed.dropDuplicates(["nid"]), shingle=shingle))
    good = checkpointed(verified(proposed, sets, similarity))
    short = checkpointed(proposed.join(good, ["a", "b"], "left_anti"))
    if not short.isEmpty():
        crowds, parts = components(proposed), components(good)
        open_ = short.select(F.col("a").alias("node")).distinct().join(crowds, "node").select("root").distinct()
        again = crowds.join(open_, "root", "left_semi").join(parts.withColumnRenamed("root", "part"), "node", "left").select("root", F.col("node").alias("nid"), F.coalesce("part", "node").alias("part"))
        good = good.unionByName(checkpointed(crowd_links(again.join(sets, "nid"), similarity=similarity)))
    linked = components(good)
    groups = first.select("id", "nid").join(linked, F.col("nid") == F.col("node"), "left")
    stay = groups.groupBy(F.coalesce("root", "nid").alias("root")).agg(F.min(F.struct("id", "nid")).alias("f")).select("f.nid")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1))
    key = key if unique else F.xxhash64(key, F.xxhash64(F.col(f"`{text}`").cast("string")))
    name = "nid"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    kept = docs.join(stay.select(F.col("nid").alias(name)).hint("shuffle_hash"), key == F.col(name), "left_semi")
    return kept if unique else kept.dropDuplicates([doc_id, text])
