"""Suffix, chunk and SimHash deduplication against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sourcemill.llm import chunking, simhash, suffixes
from sourcemill.llm.graphs import components

INF = float("inf")
VOCABULARY = ["alpha", "be", "gamma", "dé", "eps", "zeta zeta", "Ω", "theta", "io", "kappa\n"]


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    base = [words(rng.randrange(5, 60)) for _ in range(10)]
    texts = []
    for _ in range(60):
        k = rng.random()
        if k < 0.1:
            texts.append(rng.choice(["", None, " ", "short", "a" * 200, "ab" * 70]))
        elif k < 0.3:
            texts.append(rng.choice(base))
        elif k < 0.7:
            t = rng.choice(base)
            p = rng.randrange(len(t))
            texts.append(words(rng.randrange(12)) + t[p : rng.randrange(p, len(t))] + words(rng.randrange(12)))
        else:
            texts.append(words(rng.randrange(1, 50)))
    ids = list(range(60))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (ids[0], texts[0]), (None, base[0])]


def brute_suffixes(rows, depth=50):
    first = {}
    for d, t in rows:
        b, d = (t or "").encode(), INF if d is None else d
        for i in range(len(b) - depth + 1):
            first[b[i : i + depth]] = min(first.get(b[i : i + depth], INF), d)
    out = []
    for d, t in rows:
        b, own = (t or "").encode(), INF if d is None else d
        gone = [False] * len(b)
        for i in range(len(b) - depth + 1):
            if first[b[i : i + depth]] < own:
                gone[i : i + depth] = [True] * depth
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "hot", "block"), [(1, 1024, 1 << 20), (2, 1, 900), (3, 2, 500)])
def test_suffixes(spark, seed, hot, block):
    rows = corpus(seed) + [(7, "another text under an id that occurs twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "block": F.lit("x"), "row": F.lit(2)}).repartition(3)
    assert sorted([tuple(r) for r in suffixes.dedup_suffixes(df, hot=hot, block_bytes=block).collect()], key=str) == brute_suffixes(rows)
    assert suffixes.dedup_suffixes(df.limit(0)).count() == 0


def test_suffixes_of_long_periodic_texts(spark):
    letters, rules = "a" * 1_000_000, ("-" * 70 + "\n") * 14_000
    rows = [(1, letters), (2, letters + "b"), (3, "x" + rules), (4, rules + "y"), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.dedup_suffixes(df).collect()}
    n = len(rules)
    assert got == {1: (1_000_000, 0, 0), 2: (1_000_001, 1_000_000, 1), 3: (n + 1, 0, 0), 4: (n + 1, n, 1), 5: (5, 0, 0)}


def test_suffixes_are_sorted_by_all_their_bytes():
    rng = np.random.default_rng(5)
    data = np.frombuffer(bytes(rng.integers(97, 99, 4000).astype(np.uint8)) + b"ab" * 300, np.uint8)
    place, ids = rng.permutation(len(data) - 20)[:2000], rng.integers(0, 9, 2000)
    for depth in (1, 7, 8, 20):
        first = {}
        for p, i in zip(place, ids, strict=True):
            first[bytes(data[p : p + depth])] = min(first.get(bytes(data[p : p + depth]), 99), i)
        assert suffixes.radix(data, place, ids, depth).tolist() == [i > first[bytes(data[p : p + depth])] for p, i in zip(place, ids, strict=True)]


def test_a_hot_anchor_is_dealt_by_its_windows(spark):
    line = "a line that very many documents share, in other surroundings each time it is found"
    rows = [(i, f"{i * 7919:09d} {line} {i * 104729:09d} and some more of it") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    assert sorted([tuple(r) for r in suffixes.dedup_suffixes(df, hot=3).collect()], key=str) == brute_suffixes(rows)


def test_without_repeats_keeps_columns(spark):
    base = "this passage is long enough to be found again, more than fifty bytes of it"
    df = spark.createDataFrame([(1, f"x {base}", "a"), (2, f"{base} y", "b"), (3, None, "c")], "doc_id long, text string, th string")
    assert {tuple(r) for r in suffixes.without_repeats(df).collect()} == {(1, f"x {base}", "a"), (2, " y", "b"), (3, None, "c")}


def brute_chunks(rows, min_run):
    data = [(INF if d is None else d, (t or "").encode(), d) for d, t in rows]

    def ends(b):
        """The gear rule, byte by byte."""
        out, last, h = [], 0, 0
        for at, x in enumerate(b, 1):
            h = ((h << 1) + int(chunking._GEAR[x])) & 0xFFFFFFFF
            if (at - last >= chunking.MIN and h >> 32 - chunking.BITS == 0) or at - last == chunking.MAX:
                out.append(at)
                last = at
        return out + [len(b)] * (last < len(b))

    first = {}
    for d, b, _ in data:
        p = 0
        for e in ends(b):
            first[b[p:e]] = min(first.get(b[p:e], (INF, INF)), (d, p))
            p = e
    out = []
    for d, b, own in data:
        p, runs, n = 0, [], 0
        for e in ends(b):
            if first[b[p:e]] != (d, p):
                n += 1
                if runs and runs[-1][1] == p:
                    runs[-1][1] = e
                else:
                    runs.append([p, e])
            p = e
        runs = [r for r in runs if r[1] - r[0] >= min_run]
        kept = b
        for x, y in reversed(runs):
            kept = kept[:x] + kept[y:]
        out.append((own, len(b), sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept).hexdigest(), n))
    return sorted(out, key=str)


def test_chunks(spark):
    rng = random.Random(9)
    long = "".join(chr(rng.randrange(97, 123)) for _ in range(60_000))
    rows = [*corpus(3), (70, long), (71, "x" + long[:50_000]), (72, "a" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "row": F.lit("x"), "start": F.lit(2)}).repartition(3)
    assert sorted([tuple(r) for r in chunking.dedup_substrings(df).collect()], key=str) == brute_chunks(rows, chunking.MIN_RUN)
    assert chunking.dedup_substrings(df.limit(0)).count() == 0


def test_chunk_cuts_resist_insertions():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate([data[:5000], np.frombuffer(b"inserted", np.uint8), data[5000:]])
    pieces = lambda x: {bytes(x[a:b]) for a, b in zip([0, *chunking.cuts(x)], chunking.cuts(x), strict=False)}
    a, b = pieces(data), pieces(moved)
    assert len(a - b) < 12 and len(a) > 300
    assert all(len(p) <= chunking.MAX for p in a)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, distance):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize(("distance", "bucket"), [(2, 2), (2, 32), (1, 2)])
def test_links_connect_all(spark, distance, bucket):
    rng = random.Random(bucket + distance)
    values = []
    for _ in range(4):
        values.append(rng.getrandbits(64))
        for _ in range(rng.choice([3, 40, 120])):
            x = rng.choice(values[-5:])
            for _ in range(rng.randrange(3)):
                x ^= 1 << rng.randrange(64)
            values.append(x)
    values = list(dict.fromkeys(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), max_distance=distance, bucket=bucket)
    groups = {}
    for r in components(found).collect():
        groups.setdefault(r.root, set()).add(r.node % (1 << 64))
    alone = {frozenset([v]) for v in values if not any(v in g for g in groups.values())}
    assert {frozenset(g) for g in groups.values()} | alone == brute_components(values, distance)


def test_near_duplicates(spark):
    rows = [(d, t) for d, t in corpus(4) if d is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    prints = {d: fingerprint(t) for d, t in rows}
    groups = brute_components(list(dict.fromkeys(prints.values())), 2)
    least = {v: min(d for d, p in prints.items() if p in g) for g in groups for v in g}
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(d, f"{p:016x}", least[p]) for d, p in prints.items()}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_representatives(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(12)]
    rows, group = [], {}
    for g, words in enumerate(base):
        for c in range(4):
            copy = list(words)
            for k in rng.sample(range(300), c * 2):
                copy[k] = word()
            rows.append((g * 10 + c, " ".join(copy)))
            group[g * 10 + c] = g
    rows += [(999, rows[0][1]), (0, rows[0][1]), (None, "lonely " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("nid", F.lit(1))
    got = simhash.representatives(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([*(g * 10 for g in range(12)), None], key=str)
    assert simhash.representatives(df.limit(0)).count() == 0


def wide(spark, prints):
    """Random fingerprints, numbered in their order, as similar_links takes them."""
    schema = "nid long, " + ", ".join(f"s{k} long" for k in range(7))
    return spark.createDataFrame([(i, *map(int, w.view(np.int64))) for i, w in enumerate(prints)], schema)


def flipped(rng, prints, n):
    """The fingerprints with n of their first 384 bits changed."""
    flips = rng.permuted(np.tile(np.arange(384) < n, (len(prints), 1)), axis=1)
    out = prints.copy()
    out[:, :6] ^= np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    return out


def test_similar_links_in_crowds(spark):
    rng = np.random.default_rng(4)
    random = lambda n: rng.integers(0, 1 << 64, (n, 7), dtype=np.uint64)
    x = random(1)
    y = flipped(rng, x, 30)
    # Unrelated texts before and between the two in every variant of 22 bits.
    crowd = []
    for end in (x, y):
        own = np.unpackbits(end.view(np.uint8), bitorder="little")
        for at in range(0, 374, 22):
            bits = rng.integers(0, 2, (40, 448), dtype=np.uint8)
            bits[:, at : at + 22] = own[at : at + 22]
            crowd.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    crowd = np.concatenate(crowd)
    got = simhash.similar_links(wide(spark, np.concatenate([crowd, x, crowd[:, ::-1] ^ np.uint64(5), crowd ^ flipped(rng, crowd * np.uint64(0), 2), y])), similarity=0.8)
    ends = {(r.a, r.b) for r in got.collect()}
    assert (len(crowd), 3 * len(crowd) + 1) in ends
    assert {(i, 2 * len(crowd) + 1 + i) for i in range(len(crowd))} <= ends


@pytest.mark.parametrize("size", [20, 90, 1500])
def test_linked_compares_all_with_one_key(size):
    rng = np.random.default_rng(size)
    words = rng.integers(0, 1 << 64, (size, 7), dtype=np.uint64)
    words[size // 3 : size // 2] = flipped(rng, np.repeat(words[:1], size // 2 - size // 3, axis=0), 20)
    words[-3:] = flipped(rng, words[1:4], 78)
    words[-6:-3] = flipped(rng, words[4:7], 79)
    words = np.ascontiguousarray(words[rng.permutation(size), :6])
    near = np.stack([np.bitwise_count(words ^ w).sum(axis=1) <= 78 for w in words])
    want, left = [], set(range(size))
    while left:
        group, front = set(), {min(left)}
        while front:
            group |= front
            front = {int(v) for u in front for v in np.flatnonzero(near[u])} - group
        left -= group
        want.append(group)
    i, j = simhash._linked(np.zeros(size, np.int64), words, 78)
    assert near[i, j].all() and len(i) == size - len(want)
    assert all(any({a, b} <= g for g in want) for a, b in zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("differ", [65, 58, 50])
def test_similar_links_recall(spark, differ):
    rng = np.random.default_rng(differ)
    x = rng.integers(0, 1 << 64, (2000, 7), dtype=np.uint64)
    got = {(r.a, r.b) for r in simhash.similar_links(wide(spark, np.concatenate([x, flipped(rng, x, differ)])), similarity=0.8).collect()}
    assert got <= {(i, i + 2000) for i in range(2000)}
    assert len(got) >= 0.98 * 2000


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed(rng, words, similarity):
    """words with single words changed until the sets of shingles are just at or above, or just below, the similarity."""
    other, before = list(words), list(words)
    while jaccard(shingle_set(words), shingle_set(other)) >= similarity:
        before = list(other)
        other[rng.randrange(len(other))] = f"v{rng.randrange(10**6)}"
    return before, other


@pytest.mark.parametrize("similarity", [0.70, 0.75, 0.80, 0.85])
def test_representatives_precision_and_recall(spark, similarity):
    """Isolated pairs just above and just below each similarity: none under 0.8 goes, nearly all others do."""
    rng, rows, same = random.Random(8), [], []
    for _ in range(250):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 260))]
        for other in changed(rng, words, similarity):
            base = [f"{w}x{len(rows)}" for w in words], [f"{w}x{len(rows)}" for w in other]
            same.append(jaccard(*map(shingle_set, base)))
            rows += [(len(rows), " ".join(base[0])), (len(rows) + 1, " ".join(base[1]))]
    stay = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, len(rows), 2)) <= stay
    far = [2 * i + 1 for i, s in enumerate(same) if s < 0.8]
    near = [2 * i + 1 for i, s in enumerate(same) if s >= 0.8]
    assert set(far) <= stay
    assert sum(d in stay for d in near) <= 1 + 0.02 * len(near)


def test_representatives_equal_to_links_by_brute_force(spark):
    """Crowds around one text, chains that drift away, texts that share a passage, and short ones."""
    rng, rows = random.Random(21), []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows += [base] + [changed(rng, base, 0.8)[rng.randrange(2)] for _ in range(60)]
        link = base
        for _ in range(12):
            link = changed(rng, link, 0.83)[0]
            rows.append(link)
        rows += [base[:40] + [f"u{rng.randrange(10**6)}" for _ in range(50)] for _ in range(40)]
    line = "again and again and again".split()
    rows += [line * 30 + [f"z{k}"] * 5 for k in range(3)] + [["only"], ["only", "two"], ["only"], [], [], line * 30]
    sets = [shingle_set(r) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    stay = {r.doc_id for r in simhash.representatives(df).collect()}
    assert stay == {i for i in range(len(rows)) if top(i) == i}


def test_crowds_in_blocks_equal_brute_force(spark):
    """Crowds cut into many blocks: links join the parts that any pair of sets at the similarity joins."""
    rng, rows, sets = random.Random(31), [], {}
    for root in (1, 2, 3):
        base = set(rng.sample(range(10**6), 60))
        for k in range(80):
            own = set(rng.sample(sorted(base), 60 - rng.randrange(12))) | set(rng.sample(range(10**6), rng.randrange(8)))
            nid = root * 1000 + k
            sets[nid] = own
            rows.append((root, nid, root * 1000 + (k % 3 if k < 40 else k), sorted(own)))
    part = {r[1]: r[2] for r in rows}
    df = spark.createDataFrame(rows, "root long, nid long, part long, shingles array<int>").repartition(5)

    def groups(links):
        up = {p: p for p in part.values()}

        def top(p):
            while up[p] != p:
                p = up[p]
            return p

        for a, b in links:
            up[top(part[a])] = top(part[b])
        return {frozenset(p for p in up if top(p) == t) for t in {top(p) for p in up}}

    want = [(a, b) for a in sets for b in sets if a < b and a // 1000 == b // 1000 and jaccard(sets[a], sets[b]) >= 0.8]
    for block in (1 << 20, 700):
        found = [tuple(r) for r in simhash.crowd_links(df, similarity=0.8, block=block).collect()]
        assert all(jaccard(sets[a], sets[b]) >= 0.8 and part[a] != part[b] for a, b in found)
        assert groups(found) == groups(want)
        if block == 1 << 20:  # two tasks for each crowd, each with a forest of its own
            assert len(found) <= 2 * (len(set(part.values())) - len(groups(want)))
