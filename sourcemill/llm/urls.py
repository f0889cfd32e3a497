"""URL filters by a sort-merge range join of reversed hosts.

The canonical key of a host is its labels in reverse order, each ended by a character
below all host characters, so ``net`` and all its subdomains are the keys that begin
with ``net\\x01``: one interval of the sorted keys, and the intervals of two rules are
either nested or disjoint.  URLs and rules are range-partitioned by that key (the cut
points come from a bounded sample and affect only the balance), every rule goes to the
partitions that its interval meets, each partition is sorted, and one sweep keeps a
stack of the rules whose interval is open.  The rules on the stack are those whose host
fits; the longest whose path fits decides.  Nothing is broadcast but the cut points,
and a sweep holds one stack with the rules of the hosts that are open.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR, AFTER = "\x01", "\x02"
#: Sampled keys from which the cut points are taken.
SAMPLE_KEYS = 20_000

# The rules of the registered query, as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    """Labels in reverse order, each followed by the separator."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEPARATOR), F.lit(SEPARATOR))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(urls: DataFrame, rules: DataFrame, *, row_id: str = "page_id", url: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of urls.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path
    starts with the rule's.  Of the rules that fit, the one with the longest host wins,
    then that with the longest path, then the smaller verdict; rules with null or empty
    host are ignored, a null path is ``/``.  Without a fitting rule, ``rule`` is null and
    ``verdict`` the default.  Null urls and urls without ``://`` have an empty host and
    path, which no rule fits.  Repeated rows each get their row; very long urls are judged
    whole; other columns, whatever their names, are not read; empty tables are fine.
    """
    spark = urls.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = urls.select(F.col(row_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("key", F.when(F.col("host") == "", "").otherwise(reversed_key("host")))
    # The path and the row take part in the cuts, so that one host may span many partitions.
    rows = rows.withColumn("place", F.concat_ws(SEPARATOR, "key", "path", F.lpad(F.hex(F.xxhash64("page_id")), 16, "0")))
    held = rules.where("host is not null and host <> ''").select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"), F.coalesce("path", F.lit("/")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).dropDuplicates().withColumn("key", reversed_key("rule_host"))
    # A sample of bounded size; the count reads no column.
    thin = max(1, urls.count() // SAMPLE_KEYS)
    sample = sorted(r.place for r in rows.where(F.pmod(F.xxhash64("place"), F.lit(thin)) == 0).select("place").limit(2 * SAMPLE_KEYS).collect())
    cuts = sorted({sample[len(sample) * k // n] for k in range(1, n)} if sample else ())
    table = np.array(cuts, dtype=object)

    @F.pandas_udf("int")
    def part_of(place):
        return pd.Series(np.searchsorted(table, place.to_numpy(dtype=object), "right").astype(np.int32), place.index)

    def spread(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                # The keys that begin with this one end before the same key with the character after the separator.
                first, last = bisect_left(cuts, r["key"]), bisect_left(cuts, r["key"][:-1] + AFTER)
                out += [(p, r["key"], r["key"], r["rule_host"], r["rule_path"], r["rule_verdict"]) for p in range(first, last + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.string()] * 5], strict=True)], names=["part", "key", "place", "host", "path", "rule_verdict"])

    text = "key string, place string, host string, path string, rule_verdict string"
    spread_rules = held.select("key", "rule_host", "rule_path", "rule_verdict").mapInArrow(spread, f"part int, {text}")
    both = spread_rules.withColumn("page_id", F.lit(None).cast("long")).withColumn("kind", F.lit(0)).unionByName(
        rows.select(part_of("place").alias("part"), "key", "place", "host", "path", F.lit(None).cast("string").alias("rule_verdict"), "page_id", F.lit(1).alias("kind"))
    )
    swept = both.repartitionById(n, F.col("part")).sortWithinPartitions("part", "key", "kind", "place")
    schema = "page_id long, host string, path string, rule string, verdict string"

    def best(stack, host, path):
        """Rule and verdict: paths are looked up by their length, the longest first, so a host may have very many rules."""
        for _, by_host, lengths in reversed(stack):
            # The host is checked as well, since a host may hold the separator itself.
            fits = {h: p for h, p in by_host.items() if host == h or host.endswith("." + h)}
            for length in lengths if fits else ():
                if -length <= len(path):
                    for h, paths in fits.items():
                        if path[:-length] in paths:
                            return h + path[:-length], paths[path[:-length]]
        return None

    def sweep(batches):
        part, stack = None, []
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("part", "key", "kind", "host", "path", "rule_verdict", "page_id")}
            out = []
            for p, key, kind, host, path, verdict, page in zip(*c.values(), strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    by_host, lengths = stack[-1][1:]
                    paths = by_host.setdefault(host, {})
                    if path not in paths or (verdict or "") < (paths[path] or ""):
                        paths[path] = verdict
                    if (at := bisect_left(lengths, -len(path))) == len(lengths) or lengths[at] != -len(path):
                        lengths.insert(at, -len(path))
                    continue
                out.append((page, host, path, *(best(stack, host, path) or (None, default))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 4], strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return swept.select("part", "key", "kind", "host", "path", "rule_verdict", "page_id").mapInArrow(sweep, schema)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (
  SELECT p.*, r.h || r.q AS rule, r.v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h) DESC NULLS LAST, length(r.q) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""
