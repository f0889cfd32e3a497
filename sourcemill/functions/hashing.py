"""FNV-1a hashes of 64 bits, which wrap, as vectorized helpers over byte matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a 64.
OFFSET_BASIS = 14695981039346656037
PRIME = 1099511628211

# The white space that is trimmed from a line before it is hashed.
TRIMMED = " \t\n\r\x0b\x0c"


def fnv1a64_array(values: list[bytes], start: np.ndarray | None = None) -> np.ndarray:
    """FNV-1a of each value; texts are taken a column of bytes at a time, longest first."""
    n = len(values)
    out = np.full(n, OFFSET_BASIS, np.uint64) if start is None else start.copy()
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes[order])])[:-1]
    left = sizes[order]
    for k in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-left, -k, "left"))
        who = order[:live]
        out[who] = (out[who] ^ data[at[:live] + k]) * np.uint64(PRIME)
    return out


def _bytes(s: pd.Series) -> list[bytes]:
    return [b"" if v is None else v.encode() for v in s]


def _decimal(h: np.ndarray) -> pd.Series:
    return pd.Series([str(x) for x in h.tolist()])


def fnv1a64(col: Column) -> Column:
    """The hash of the UTF-8 bytes as decimal(20,0); a null counts as empty."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _decimal(fnv1a64_array(_bytes(s)))

    return run(col).cast("decimal(20,0)")


def baseline_key(path: Column, code: Column, line: Column) -> Column:
    """Key of a finding that does not change when its line moves: decimal(20,0)."""

    @F.pandas_udf("string")
    def run(p: pd.Series, c: pd.Series, t: pd.Series) -> pd.Series:
        trimmed = [b"" if v is None else v.strip(TRIMMED).encode() for v in t]
        h = (fnv1a64_array(_bytes(p)) ^ fnv1a64_array(_bytes(c))) * np.uint64(PRIME)
        return _decimal((h ^ fnv1a64_array(trimmed)) * np.uint64(PRIME))

    return run(path, code, line).cast("decimal(20,0)")


def fingerprint(path: Column, code: Column, text: Column) -> Column:
    """Hash of path, code and text, each ended by 0xff, as 16 hex digits."""

    @F.pandas_udf("string")
    def run(p: pd.Series, c: pd.Series, t: pd.Series) -> pd.Series:
        whole = [a + b"\xff" + b + b"\xff" + d + b"\xff" for a, b, d in zip(_bytes(p), _bytes(c), _bytes(t), strict=True)]
        return pd.Series([f"{x:016x}" for x in fnv1a64_array(whole).tolist()])

    return run(path, code, text)
