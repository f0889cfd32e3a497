"""Line diffs of pairs of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a middle up to which the whole table of common subsequences is held.
MIDDLE = 512


def _suffixes(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The longest common subsequence of xs with each suffix of ys, in the memory of one row."""
    best = np.zeros(len(ys) + 1, np.int32)
    for x in xs[::-1]:
        # A row from the right: a match adds one to the diagonal, then the best so far carries on.
        took = np.maximum(best[:-1], np.where(ys == x, best[1:] + 1, 0))
        best[:-1] = np.maximum.accumulate(took[::-1])[::-1]
    return best


def _walked(xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, by the whole table."""
    best = np.zeros((len(xs) + 1, len(ys) + 1), np.int32)
    for i in range(len(xs) - 1, -1, -1):
        took = np.maximum(best[i + 1, :-1], np.where(ys == xs[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(took[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(xs) and j < len(ys):
        if xs[i] == ys[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _common(xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of any length.

    Lines that the other side does not have, and a common head and tail, are set aside; what
    is left is halved where both halves together have the most in common, until the table
    of a part is small.
    """
    out, parts = [], [(np.arange(len(xs)), np.arange(len(ys)))]
    while parts:
        p, q = parts.pop()
        p, q = p[np.isin(xs[p], ys[q])], q[np.isin(ys[q], xs[p])]
        n = min(len(p), len(q))
        off = np.flatnonzero(xs[p[:n]] != ys[q[:n]])
        head = int(off[0]) if len(off) else n
        off = np.flatnonzero(xs[p[::-1][: n - head]] != ys[q[::-1][: n - head]])
        tail = int(off[0]) if len(off) else n - head
        ends = [slice(0, head), slice(-tail, None) if tail else slice(0, 0)]
        out += [pair for e in ends for pair in zip(p[e].tolist(), q[e].tolist(), strict=True)]
        p, q = p[head : len(p) - tail], q[head : len(q) - tail]
        if not len(p) or not len(q):
            continue
        if max(len(p), len(q)) <= MIDDLE or len(p) == 1:
            out += [(int(p[i]), int(q[j])) for i, j in _walked(xs[p], ys[q])]
            continue
        half = len(p) // 2
        below, above = _suffixes(xs[p[half:]], ys[q]), _suffixes(xs[p[:half]][::-1], ys[q][::-1])[::-1]
        cut = int(np.argmax(below + above))
        parts += [(p[:half], q[:cut]), (p[half:], q[cut:])]
    return sorted(out)


def _steps(before: list[str], after: list[str], exact: bool) -> list[str]:
    """delete, equal and insert steps; common head and tail first, the longest common subsequence between."""
    key = (lambda s: s) if exact else (lambda s: s.rstrip())
    a, b = [key(x) for x in before], [key(x) for x in after]
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    words = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    xs, ys = np.array([words[w] for w in x], np.int64), np.array([words[w] for w in y], np.int64)
    found = _walked(xs, ys) if max(len(x), len(y)) <= MIDDLE else _common(xs, ys)
    middle, i, j = [], 0, 0
    for p, q in [*found, (len(x), len(y))]:
        middle += ["delete"] * (p - i) + ["insert"] * (q - j) + ["equal"] * (p < len(x))
        i, j = p + 1, q + 1
    return ["equal"] * head + middle + ["equal"] * tail


def _unified(path: str, before: list[str], after: list[str], steps: list[str], context: int) -> str:
    if all(s == "equal" for s in steps):
        return ""
    rows, i, j = [], 0, 0
    for s in steps:
        rows.append((s, i, j))
        i, j = i + (s != "insert"), j + (s != "delete")
    changed = [k for k, s in enumerate(steps) if s != "equal"]
    hunks: list[list[int]] = []
    for k in changed:
        if hunks and k - hunks[-1][1] <= 2 * context + 1:
            hunks[-1][1] = k
        else:
            hunks.append([k, k])
    out = [f"--- {path}", f"+++ {path}"]
    for first, last in hunks:
        part = rows[max(0, first - context) : last + context + 1]
        a, b = sum(s != "insert" for s, *_ in part), sum(s != "delete" for s, *_ in part)
        out.append(f"@@ -{part[0][1] + 1},{a} +{part[0][2] + 1},{b} @@")
        out += [{"equal": " ", "delete": "-", "insert": "+"}[s] + (after[j] if s == "insert" else before[i]) for s, i, j in part]
    return "\n".join(out) + "\n"


def _lines(text: str | None) -> list[str]:
    lines = (text or "").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def line_diff(pairs: DataFrame, exact: bool = False, context: int = 3) -> DataFrame:
    """path, deleted, inserted, equal and unified of every pair(path, before, after) of texts that differ.

    Lines are compared without blanks at their ends unless ``exact``.  Equal texts are
    filtered out before Python sees them.
    """

    @F.pandas_udf("deleted int, inserted int, equal int, unified string")
    def run(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
        out = []
        for p, x, y in zip(path, before, after, strict=True):
            a, b = _lines(x), _lines(y)
            s = _steps(a, b, exact)
            out.append((s.count("delete"), s.count("insert"), s.count("equal"), _unified(p, a, b, s, context)))
        return pd.DataFrame(out, columns=["deleted", "inserted", "equal", "unified"])

    differ = pairs.where(~F.col("before").eqNullSafe(F.col("after")))
    return differ.withColumn("d", run("path", "before", "after")).select("path", "d.deleted", "d.inserted", "d.equal", "d.unified")


def drift(pairs: DataFrame) -> DataFrame:
    """path, same, added and removed: how many lines, as a multiset, each text gained and lost.  Built-in functions alone."""
    lines = lambda c, s: pairs.select("path", F.explode(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n\z", ""), "\n")).alias("line"), F.lit(s).alias("d"))
    n = lines("before", -1).unionByName(lines("after", 1)).groupBy("path", "line").agg(F.sum("d").alias("d"))
    return n.groupBy("path").agg(
        (F.max(F.abs("d")) == 0).alias("same"), F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed")
    )


def drift_tally(drifts: DataFrame, by: str) -> DataFrame:
    """For each value of ``by``: files, changed, added and removed."""
    return drifts.groupBy(by).agg(F.count("*").alias("files"), F.sum((~F.col("same")).cast("int")).alias("changed"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
