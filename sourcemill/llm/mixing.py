"""Mixing sources to target weights by temperature, on DataFrame functions alone.

The weight of a source is its share of all tokens to the power of an exponent,
normalised.  The exponent is bisected: the largest that still reaches a target entropy,
or the smallest-changing one that keeps the most repeated source within a limit.  The
weights then share out a token budget, and each source realises its quota as passes
over a permutation of its blocks: whole passes first, then the blocks of one more pass
until the rest of the quota is used up.

Documents fall into blocks by hash, and a source gets blocks in proportion to its
tokens.  Running sums over the blocks of a pass are made on two levels, so no window holds
more than about one block of documents, one row for each shelf of a pass, or one in 4096
of its blocks.  To find the exponent, one element for each different size of a source is
gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ENTROPY = 0.97
BLOCK_TOKENS = 100_000
STEPS = 60
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _mass(shares: Column, a: Column, term) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda acc, s: acc + s["n"] * term(s["p"], a))


def _entropy(shares: Column, a: Column) -> Column:
    z = _mass(shares, a, lambda p, a: F.pow(p, a))
    return F.log(z) - _mass(shares, a, lambda p, a: F.pow(p, a) * a * F.log(p)) / z


def _bisect(shares: Column, above) -> Column:
    """The largest exponent in 0..1 for which ``above`` holds, if it holds from 0 up to it."""

    def step(b: Column, _: Column) -> Column:
        mid = (b["lo"] + b["hi"]) / 2
        ok = above(shares, mid)
        return F.struct(F.when(ok, mid).otherwise(b["lo"]).alias("lo"), F.when(ok, b["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step, lambda b: b["lo"])
    return F.when(above(shares, F.lit(1.0)), F.lit(1.0)).otherwise(found)


def source_weights(tokens: DataFrame, *, budget: int | None = None, target_entropy: float | None = None, max_repeats: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """source, tokens, share, exponent, weight, quota, passes, rest and blocks, one row for each source with tokens.

    tokens: one row for each document with columns source and tokens.  Exactly one of
    target_entropy (a share of the largest possible entropy, 0 to 1) and max_repeats
    must be given.  With max_repeats, the exponent is the smallest in 0..1 for which no
    source is repeated more often; if even the natural shares exceed it, it is 1.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    sums = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    # Sources of one size count together: the array has one element for each different size, not for each source.
    sizes = sums.groupBy("tokens").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sort_array(F.collect_list(F.struct("tokens", "n"))).alias("all"), F.sum(F.col("tokens") * F.col("n")).alias("total"), F.sum("n").alias("sources")).where("total > 0")
    whole = whole.withColumn("shares", F.transform("all", lambda t: F.struct((t["tokens"] / F.col("total")).alias("p"), t["n"].alias("n")))).withColumn("budget", F.col("total") if budget is None else F.lit(budget).cast("long"))
    if target_entropy is not None:
        goal = F.log(F.col("sources")) * target_entropy
        exponent = _bisect(F.col("shares"), lambda s, a: _entropy(s, a) >= goal)
    else:
        # Repeats fall as the exponent grows, so the bisection runs on 1 - exponent.
        def within(s: Column, b: Column) -> Column:
            a = 1 - b
            most = F.array_max(F.transform(s, lambda x: F.pow(x["p"], a - 1)))
            return most * F.col("budget") / F.col("total") / _mass(s, a, lambda p, a: F.pow(p, a)) <= max_repeats

        exponent = 1 - _bisect(F.col("shares"), within)
    whole = whole.withColumn("exponent", exponent)
    whole = whole.withColumn("mass", _mass(F.col("shares"), F.col("exponent"), lambda p, a: F.pow(p, a)))
    weight = F.pow(F.col("share"), F.col("exponent")) / F.col("mass")
    rows = sums.crossJoin(F.broadcast(whole.select("total", "budget", "exponent", "mass")))  # one row
    rows = rows.withColumn("share", F.col("tokens") / F.col("total")).withColumn("weight", weight)
    rows = rows.withColumn("quota", F.floor(F.col("weight") * F.col("budget") + 0.5))
    rows = rows.withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("long"))
    rows = rows.withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    blocks = F.ceil(F.col("tokens") / block_tokens).cast("long")
    return rows.select("source", "tokens", "share", "exponent", "weight", "quota", "passes", "rest", blocks.alias("blocks"))


def _order(*parts) -> Column:
    """A fixed pseudo-random order of what is named."""
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None,
    target_entropy: float | None = None, max_repeats: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED,
) -> DataFrame:
    """The mixture, one row for each use of a document.

    Returns doc_id, source, n_tokens, pass (from 0), block, block_rank and doc_rank
    (from 1): within a pass a source is read in the order of block_rank and doc_rank.
    ``budget`` is in tokens, by default all tokens of docs.  In the last, partial pass a
    document is used while what came before it is below the rest of the quota, so each
    source exceeds its quota by less than one document.  A null source is a source of
    its own; sources without a token take no part; documents without a token (null,
    empty) cost nothing and are used along with their block; repeated rows are used
    like different documents; very long texts are counted whole; other columns, whatever
    their names, are not read; an empty table gives an empty mixture.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_tokens(F.col(text)).alias("tokens"))
    plan = source_weights(rows, budget=budget, target_entropy=target_entropy, max_repeats=max_repeats, block_tokens=block_tokens)
    plan = plan.select(F.col("source").alias("s"), "passes", "rest", "blocks")
    name = F.coalesce("source", F.lit("\x00"))
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = F.conv(F.substring(_order(F.lit(seed), F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % F.col("blocks")
    dealt = dealt.withColumn("block", block)
    # Blocks of every pass in their order, with the tokens that come before each.
    blocks = dealt.groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("block_tokens"))
    blocks = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1), F.lit(1).cast("long"))))
    blocks = blocks.where("pass >= 0 and (pass < passes or rest > 0)")
    # Running sums on two levels: the order of a pass is cut into 4096 shelves, which are summed first.
    blocks = blocks.withColumn("turn", _order(F.lit(seed), F.col("pass").cast("string"), name, F.col("block").cast("string")))
    blocks = blocks.withColumn("shelf", F.substring("turn", 1, 3))
    shelves = blocks.groupBy(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("shelf").alias("h")).agg(F.count("*").alias("n"), F.sum("block_tokens").alias("tokens"))
    above = Window.partitionBy("s", "p").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    shelves = shelves.select("s", "p", "h", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("rank_before"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_before"))
    blocks = blocks.join(shelves, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("shelf") == F.col("h"))).drop("s", "p", "h")
    turn = Window.partitionBy("source", "pass", "shelf").orderBy("turn", "block")
    blocks = blocks.withColumn("block_rank", (F.col("rank_before") + F.row_number().over(turn)).cast("long"))
    blocks = blocks.withColumn("before", F.col("tokens_before") + F.coalesce(F.sum("block_tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("left", F.when(F.col("pass") < F.col("passes"), F.lit(None).cast("long")).otherwise(F.col("rest") - F.col("before")))
    blocks = blocks.where("left is null or left > 0").select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "block_rank", "left")
    used = dealt.select("doc_id", "source", "tokens", "block").join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    turn = Window.partitionBy("source", "pass", "block").orderBy(_order(F.lit(seed), F.col("pass").cast("string"), F.col("doc_id").cast("string")), "doc_id", "tokens")
    used = used.withColumn("doc_rank", F.row_number().over(turn).cast("long"))
    used = used.withColumn("before", F.coalesce(F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return used.where("left is null or before < left").select("doc_id", "source", F.col("tokens").alias("n_tokens"), "pass", "block", "block_rank", "doc_rank")


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
s AS (SELECT source, sum(tokens) AS tokens FROM d GROUP BY source HAVING sum(tokens) > 0),
shares AS (SELECT tokens / (SELECT sum(tokens) FROM s) AS p FROM s),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= goal THEN mid ELSE lo END, CASE WHEN h >= goal THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, ln(count(*)) * {TARGET_ENTROPY} AS goal, ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * (lo + hi) / 2 * ln(p)) / sum(pow(p, (lo + hi) / 2)) AS h
    FROM bis, shares WHERE i < {STEPS} GROUP BY i, lo, hi)
),
e AS (SELECT CASE WHEN -sum(p * ln(p)) >= ln(count(*)) * {TARGET_ENTROPY} THEN 1.0 ELSE (SELECT lo FROM bis WHERE i = {STEPS}) END AS a FROM shares),
q AS (SELECT source, tokens, CAST(floor(pow(tokens / (SELECT sum(tokens) FROM s), a) / (SELECT sum(pow(p, (SELECT a FROM e))) FROM shares) * (SELECT sum(tokens) FROM s) + 0.5) AS BIGINT) AS quota FROM s, e),
plan AS (SELECT source, tokens, CAST(quota // tokens AS BIGINT) AS passes, CAST(quota - (quota // tokens) * tokens AS BIGINT) AS rest, CAST(ceil(tokens / {BLOCK_TOKENS}) AS BIGINT) AS blocks FROM q),
dealt AS (SELECT d.*, passes, rest, ('0x' || substr(md5('{SEED}|' || doc_id), 1, 8))::BIGINT % blocks AS block FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
b0 AS (SELECT source, block, passes, rest, sum(tokens) AS bt FROM dealt GROUP BY ALL),
b1 AS (SELECT *, unnest(generate_series(0::BIGINT, CASE WHEN rest > 0 THEN passes ELSE passes - 1 END)) AS pass FROM b0),
b2 AS (SELECT *, row_number() OVER w AS block_rank, coalesce(sum(bt) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b1
  WINDOW w AS (PARTITION BY source, pass ORDER BY md5('{SEED}|' || pass || '|' || coalesce(source, chr(0)) || '|' || block), block)),
b3 AS (SELECT *, CASE WHEN pass < passes THEN NULL ELSE rest - before END AS lft FROM b2),
u AS (SELECT d.doc_id, d.source, d.tokens, b.pass, b.block, b.block_rank, b.lft, row_number() OVER w AS doc_rank,
    coalesce(sum(d.tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dealt d JOIN b3 b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block WHERE b.lft IS NULL OR b.lft > 0
  WINDOW w AS (PARTITION BY d.source, b.pass, b.block ORDER BY md5('{SEED}|' || b.pass || '|' || d.doc_id), d.doc_id, d.tokens))
SELECT doc_id, source, tokens AS n_tokens, pass, block, block_rank, doc_rank FROM u WHERE lft IS NULL OR before < lft
"""
