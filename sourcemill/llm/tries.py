"""The trie of conversation prefixes, by hashing blocks of turns.

The turns of a conversation are cut into blocks of a fixed number of turns.  Blocks of
one conversation are elements of larger blocks, and so on, until one block is left; a
prefix that ends with a block has the digest of the larger block's prefix, so no task
follows a conversation from end to end and none is held whole.

Conversations are grouped by the digests at the ends of their blocks first: a group of
equal blocks after equal prefixes is one row from then on.  Where a prefix is followed
by one block only, all turns of the block have its members and nothing is compared;
turn boundaries are refined only inside blocks where siblings diverge.  Sums over
subtrees climb within blocks, then from block to block on the level above.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed
from .spans import written

BLOCK_TURNS = 8
FAMILY, HEADS = 20, 4
#: The digest of no turns, as SQL.
_ROOT = "unhex(repeat('00', 16))"
#: Conversations whose ids a piece of an ending list has at most, where the list is cut by a partition.
PIECE = 1 << 16


def _digest(data: Column) -> Column:
    """128 bits of the SHA-256 of binary data."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def ordered_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 0), digest and words of every turn of conversations, as a written table.

    Turns come in order of turn, nulls first; ties in order of role, the first 64
    characters of the text, and a digest of both.  Null roles and texts are empty; rows
    with a null conv_id belong to no conversation and are left out.  The order is that of
    a range partitioning, so a conversation with very many turns is shared by tasks; one
    row for each partition reaches the driver and says where the numbers go on.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    words = F.expr(r"regexp_count(body, '[^\\x20\\x09-\\x0D]+')").cast("long")
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), said[0].alias("role"), said[1].alias("body")).where("conv is not null")
    framed = F.concat(F.octet_length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"), F.col("body").cast("binary"))
    rows = rows.select("conv", "turn", "role", F.substring("body", 1, 64).alias("head"), _digest(framed).alias("digest"), words.alias("words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]
    schema = pa.schema([("part", pa.int64()), ("conv", pa.int64()), ("local", pa.int64()), ("digest", pa.binary()), ("words", pa.int64())])

    def count(batches):
        import numpy as np
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            local = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if conv[0] == last:
                local[: starts[1] if len(starts) > 1 else len(conv)] += n
            last, n = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), batch.column(0), pa.array(local), batch.column(1), batch.column(2)], schema=schema)

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")
    table = written(dealt.mapInArrow(count, "part long, conv long, local long, digest binary, words long"))
    edges = table.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "local")).alias("last")).orderBy("part").collect()
    carried, before = [], (None, 0)
    for e in edges:
        here = before[1] if before[0] == e["first"] else 0
        if here:
            carried.append((e["part"], e["first"], here))
        own = e["last"]["local"] + 1 + (here if e["last"]["conv"] == e["first"] else 0)
        before = (e["last"]["conv"], own)
    carry = F.broadcast(table.sparkSession.createDataFrame(carried, "part long, conv long, more long"))  # one row for each partition at most
    return table.join(carry, ["part", "conv"], "left").select("conv", (F.col("local") + F.coalesce("more", F.lit(0))).alias("place"), "digest", "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): conv, place, digest and words of the rebuilt conversations, and every conv.

    Each conversation c begins with the first h turns of conversation c - c % FAMILY, h being
    crc32(c) % HEADS, in place of its own first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    base = F.col("conv") - F.col("conv") % FAMILY
    convs = checkpointed(turns.groupBy("conv").agg(F.count("*").alias("n"))).select("conv", h.alias("h"), base.alias("base"), "n")
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv", "base")
    first = convs.join(heads, "base").where("place < h").select("conv", "place", "digest", "words")
    given = convs.where(F.col("conv") == F.col("base")).select("base", F.col("n").alias("given"))
    moved = convs.join(given, "base", "left").select("conv", (F.least("h", F.coalesce("given", F.lit(0))) - F.col("h")).alias("by"))
    # A turn is moved only where the other conversation is too short; hot conversations are split by the engine's skewed join.
    own = turns.where(F.col("place") >= h).join(moved.where("by < 0"), "conv", "left")
    own = own.select("conv", (F.col("place") + F.coalesce("by", F.lit(0))).alias("place"), "digest", "words")
    return first.unionByName(own), convs.select("conv")


def _blocks(elements: DataFrame, size: int, *carry: str) -> DataFrame:
    """conv, at (the number of the block) and e: the elements of every block in order."""
    own = F.array_sort(F.collect_list(F.struct("place", "digest", *carry)))
    return elements.groupBy("conv", F.floor(F.col("place") / size).alias("at")).agg(own.alias("e"))


def _prefixes(blocks: DataFrame) -> DataFrame:
    """blocks(before, end, e, ...) with path: the digest of the prefix up to each element; the last one is end."""
    hashed = "unhex(substring(sha2(concat(if(size(p) = 0, before, element_at(p, -1)), x.digest), 256), 1, 32))"
    step = f"aggregate(e, cast(array() as array<binary>), (p, x) -> array_append(p, {hashed}))"
    return blocks.withColumn("path", F.expr(step)).withColumn("end", F.coalesce("end", F.element_at("path", -1))).withColumn("path", F.expr("transform(path, (x, i) -> if(i = size(path) - 1, end, x))"))


def block_levels(turns: DataFrame, size: int = BLOCK_TURNS) -> list[DataFrame]:
    """Of each level, from single turns up: conv, at, e, before, end and path of every block.

    before is the digest of all turns before the block, end that of all up to its end.  The
    last level has one block of each conversation.
    """
    blocks, stack = checkpointed(_blocks(turns, size, "words")), []
    while True:
        stack.append(blocks)
        if (blocks.agg(F.max("at")).first()[0] or 0) == 0:
            break
        whole = blocks.where(F.size("e") == size).select("conv", F.col("at").alias("place"), _digest(F.expr("aggregate(e, cast('' as binary), (a, x) -> concat(a, x.digest))")).alias("digest"))
        blocks = checkpointed(_blocks(whole, size))
    out: list[DataFrame] = []
    for blocks in reversed(stack):
        if out:
            known = out[-1].select("conv", F.explode(F.arrays_zip(F.col("e.place").alias("place"), F.col("path").alias("path"))).alias("x")).select("conv", "x.place", "x.path")
            here = known.select("conv", F.col("place").alias("at"), F.lit(None).cast("binary").alias("before"), F.col("path").alias("end"))
            after = known.select("conv", (F.col("place") + 1).alias("at"), F.col("path").alias("before"), F.lit(None).cast("binary").alias("end"))
            said = here.unionByName(after).groupBy("conv", "at").agg(F.max("before").alias("before"), F.max("end").alias("end"))
            blocks = blocks.join(said, ["conv", "at"], "left").withColumn("before", F.expr(f"coalesce(before, {_ROOT})"))
        else:
            blocks = blocks.withColumns({"before": F.expr(_ROOT), "end": F.lit(None).cast("binary")})
        out.append(checkpointed(_prefixes(blocks)))
    return out[::-1]


def _nodes(blocks: DataFrame, size: int) -> DataFrame:
    """key, parent, before, path, depth, n_convs, conv_id and words of every prefix that blocks of one level end or hold."""
    words = F.transform("e", lambda x: x["words"]) if "words" in blocks.schema["e"].dataType.elementType.fieldNames() else F.array_repeat(F.lit(0).cast("long"), F.size("e"))
    rows = blocks.select("conv", "at", "before", "end", "path", words.alias("words"))
    distinct = checkpointed(rows.groupBy("end").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), *(F.any_value(c).alias(c) for c in ("at", "before", "path", "words"))))
    lone = distinct.groupBy("before").agg(F.count("*").alias("m"), F.min("end").alias("end")).where("m = 1").select("end")
    each = [
        "conv", "n", "before", F.posexplode("path").alias("i", "key"), (F.col("at") * size).alias("depth"), "words", "path",
    ]

    def opened(some: DataFrame) -> DataFrame:
        return some.select(*each).select(
            "key", F.expr("if(i = 0, before, element_at(path, i))").alias("parent"), "before", F.expr("slice(path, 1, i + 1)").alias("path"),
            (F.col("depth") + F.col("i") + 1).alias("depth"), F.col("n").alias("n_convs"), F.col("conv").alias("conv_id"), F.expr("element_at(words, i + 1)").alias("words"),
        )

    alone = opened(distinct.join(lone, "end", "left_semi"))
    apart = opened(distinct.join(lone, "end", "left_anti"))
    same = [F.any_value(c).alias(c) for c in ("parent", "before", "path", "depth", "words")]
    refined = apart.groupBy("key").agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return alone.unionByName(refined)


def _subtrees(levels: list[DataFrame], values: DataFrame, names: list[str]) -> DataFrame:
    """key and the sums of the named columns over each subtree; levels: key, before, path of the prefixes of each level.

    values has key, before, path and the columns for the prefixes of the first level.
    """
    sums = [F.sum(c).alias(c) for c in names]
    below = values.groupBy(F.col("before").alias("key")).agg(*sums)
    if len(levels) > 1:
        up = levels[1].join(below, "key", "left").na.fill(0, names)
        root = below.where(F.expr(f"key = {_ROOT}"))
        below = _subtrees(levels[1:], up, names).unionByName(root.select("key", *names)).groupBy("key").agg(*sums)
    own = values.join(below.select("key", *(F.col(c).alias(f"_{c}") for c in names)), "key", "left")
    own = own.select(F.explode("path").alias("key"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names))
    return own.groupBy("key").agg(*sums).unionByName(below.where(F.expr(f"key = {_ROOT}")).select("key", *names))


def ending_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of the conv ids of ends(key, conv) in ascending order, joined by commas.

    ends is dealt by ranges of key and conv, so a key with very many conversations is cut
    up.  A list inside one partition is hashed there; those at the edges of partitions
    go on as pieces, one row for some 65,000 ids, and are hashed piece by piece.
    """
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("digest", pa.string()), ("piece", pa.binary())])

    def runs(batches):
        held: list = [None, []]
        first = True

        def out(last):
            nonlocal first
            key, ids = held
            edge, first = first or last, False
            if not edge:
                return pa.RecordBatch.from_pydict({"key": [key], "first": [ids[0]], "digest": [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()], "piece": [None]}, schema=schema)
            cut = [ids[k : k + PIECE] for k in range(0, len(ids), PIECE)]
            return pa.RecordBatch.from_pydict({"key": [key] * len(cut), "first": [c[0] for c in cut], "digest": [None] * len(cut), "piece": [",".join(map(str, c)).encode() for c in cut]}, schema=schema)

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != held[0]:
                    if held[0] is not None:
                        yield out(False)
                    held = [key, []]
                elif len(held[1]) >= 16 * PIECE:  # a long run leaves in pieces, whatever comes
                    first = True
                    yield out(True)
                    first, held[1] = True, []
                held[1].append(conv)
        if held[0] is not None:
            yield out(True)

    def whole(batches):
        key, digest = None, None
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]}, schema=pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))
                    key, digest = k, hashlib.sha256(piece)
                else:
                    digest.update(b"," + piece)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]}, schema=pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))

    found = written(ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(runs, "key binary, first long, digest string, piece binary"))
    edges = found.where("digest is null").select("key", "first", "piece").repartition("key").sortWithinPartitions("key", "first").select("key", "piece")
    return found.where("digest is not null").select("key", F.col("digest").alias("ends_sha256")).unionByName(edges.mapInArrow(whole, "key binary, ends_sha256 string"))


#: A parent with more than one in so many of all nodes as children is looked up by broadcast; there are at most as many.
HOT_SHARE = 1000


def prefix_trie(turns: DataFrame, convs: DataFrame, *, block: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of turns(conv, place, digest, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A node is a distinct sequence of first turns; conv_id is its smallest member of
    convs(conv), the root (depth 0) has all of them as members, also those without a
    turn.  No conversation gives no node.
    """
    levels = block_levels(turns, block)
    nodes = checkpointed(_nodes(levels[0], block))
    uppers = [_nodes(b, block).select("key", "before", "path") for b in levels[1:]]
    convs = convs.distinct()
    last = levels[0].groupBy("conv").agg(F.max_by("end", "at").alias("end"))
    ends = checkpointed(convs.join(last, "conv", "left").select(F.expr(f"coalesce(end, {_ROOT})").alias("key"), "conv"))
    root = ends.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.expr(_ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id")
    kids = checkpointed(nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")))
    # Sums over subtrees: childless nodes, and words that a shared prefix saves.
    leaf = nodes.join(kids, "key", "left").select("key", "before", "path", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = _subtrees([nodes, *uppers], leaf, ["n_leaves", "saved_tokens"])
    whole = nodes.select("key", "parent", "depth", "n_convs", "conv_id").unionByName(root)
    whole = whole.join(kids, "key", "left").join(sums, "key", "left").join(ending_digests(ends), "key", "left")
    whole = checkpointed(
        whole.select(
            "key", "parent", F.col("depth").cast("long").alias("depth"), F.col("n_convs").cast("long").alias("n_convs"), "conv_id", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
    up = whole.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") * HOT_SHARE > whole.count()
    some = F.broadcast(checkpointed(up.where(hot).drop("n_children")))  # at most HOT_SHARE rows
    near = whole.join(some, "parent")
    far = whole.where("parent is not null").join(some, "parent", "left_anti").join(up.where(~hot).drop("n_children"), "parent")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = whole.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return near.select(out).unionByName(far.select(out)).unionByName(top.select(out))


def conversation_trie(conversations: DataFrame, *, block: int = BLOCK_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations (rebuilt_turns) of conversations(conv_id, turn, role, text)."""
    turns, convs = rebuilt_turns(ordered_turns(conversations))
    return prefix_trie(turns, convs, block=block)


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(s)), lambda i: ascii(substr(s, i::INT + 1, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"

ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, c - c % 20 AS base, CAST(c AS VARCHAR) AS s FROM (SELECT DISTINCT c FROM t)),
hs AS (SELECT c, base, {_CRC} % 4 AS h FROM cs),
r AS (
  SELECT hs.c, 0 AS own, t.i, t.role, t.text FROM hs JOIN t ON t.c = hs.base AND t.i < hs.h
  UNION ALL SELECT hs.c, 1, t.i, t.role, t.text FROM hs JOIN t ON t.c = hs.c AND t.i >= hs.h),
p AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d FROM r),
k AS (
  SELECT c, d, text, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM p
  UNION ALL SELECT c, 0, '', [] FROM hs),
w AS (SELECT *, max(d) OVER (PARTITION BY c) = d AS last FROM k),
n AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words,
    sha256(coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM w GROUP BY path, d),
kids AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.path = kids.path),
up AS (SELECT path[:a] AS path, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM v, LATERAL (SELECT unnest(range(d + 1)) AS a)),
sums AS (SELECT path, CAST(sum(CAST(leaf AS INT)) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, m.conv_id AS parent_conv_id, v.n_convs, v.n_children, sums.n_leaves, sums.saved_tokens, v.ends_sha256
FROM v JOIN sums ON v.path = sums.path LEFT JOIN n AS m ON v.d > 0 AND m.path = v.path[:v.d - 1]
"""
