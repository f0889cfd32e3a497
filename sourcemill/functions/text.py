"""Column functions over text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"


def line_ending(col: Column) -> Column:
    """LF, CRLF or CR, as the first line break of the text decides; LF where there is none."""
    first = F.regexp_extract(col, "(\r\n|\r|\n)", 1)
    return F.when(first == "\r\n", "CRLF").when(first == "\r", "CR").otherwise("LF")


def indent_width(col: Column, tab: int = 4) -> Column:
    """Columns of the leading blanks, with a tab stop every ``tab`` columns."""
    lead = F.regexp_extract(col, "^([ \t]*)", 1)
    step = lambda w, c: F.when(c == "\t", (F.floor(w / tab) + 1) * tab).otherwise(w + 1)
    return F.aggregate(F.filter(F.split(lead, ""), lambda c: c != ""), F.lit(0).cast("bigint"), step)


def _width(text: str | None, tab: int) -> int | None:
    if text is None:
        return None
    at = 0
    for c in text:
        if c == "\t":
            at = (at // tab + 1) * tab
        elif unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Mn", "Me", "Cc"):
            continue
        else:
            at += 2 if unicodedata.east_asian_width(c) in ("W", "F") else 1
    return at


def display_width(col: Column, tab: int = 4) -> Column:
    """Terminal columns: wide characters take two, combining and control characters none."""

    @F.pandas_udf("long")
    def width(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _width(t, tab)).astype("Int64")

    return width(col)


def contains_word(col: Column, word: str) -> Column:
    """Whether word occurs between characters that are no letters, digits, ``_`` or beyond ASCII."""
    import re

    inside = r"[0-9A-Za-z_\x{80}-\x{10ffff}]"
    quoted = re.sub(r"([^0-9A-Za-z_])", r"\\\1", word)
    return col.rlike(f"(?<!{inside}){quoted}(?!{inside})")


def fold(col: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_folded(col: Column, needle: str) -> Column:
    return F.contains(fold(col), F.lit(needle.lower()))


def _depth(col: Column, opening: str, closing: str) -> Column:
    """(depth, low) after running over the brackets of the text."""
    only = F.filter(F.split(col, ""), lambda c: (c == opening) | (c == closing))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == opening, 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"))

    return F.aggregate(only, start, step)


def balanced(col: Column) -> Column:
    """Whether each of ``{}``, ``[]`` and ``()`` never closes what is not open and ends closed."""
    out = F.lit(True)
    for pair in ("{}", "[]", "()"):
        d = _depth(col, *pair)
        out = out & (d["depth"] == 0) & (d["low"] == 0)
    return out


def strip_group(col: Column, most: int = 4) -> Column:
    """The text without up to ``most`` outer pairs of parentheses that enclose all of it."""

    def peel(out: Column, _: Column) -> Column:
        inner = F.substring(out, F.lit(2), F.length(out) - 2)
        d = _depth(inner, "(", ")")
        ok = F.startswith(out, F.lit("(")) & F.endswith(out, F.lit(")")) & (F.length(out) > 1) & (d["depth"] == 0) & (d["low"] == 0)
        return F.when(ok, F.trim(inner)).otherwise(out)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.trim(col), peel)


def dedent(col: Column) -> Column:
    """Without blank first and last lines, the smallest indent and blanks at line ends."""
    # Each step is bound as the one element of an array, so that it is done once for all its uses.
    once = lambda value, then: F.transform(F.array(value), then)[0]
    rows = lambda lines: F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("i"), (F.length(s) - F.length(F.ltrim(s))).alias("w"), (s != "").alias("f"))), lambda x: x["f"])

    def cut(lines: Column, full: Column) -> Column:
        first, last = full[0]["i"], F.element_at(full, -1)["i"]
        kept = lambda least: F.transform(F.slice(lines, first + 1, last - first + 1), lambda s: F.substring(s, least + 1, F.lit(1 << 30)))
        return F.when(F.size(full) > 0, once(F.array_min(F.transform(full, lambda x: x["w"])), lambda least: F.array_join(kept(least), "\n"))).otherwise("")

    bare = F.split(F.regexp_replace(col, r"[ \t\r]++(?=\n|\z)", ""), "\n")
    return F.when(col.isNotNull(), once(bare, lambda lines: once(rows(lines), lambda full: cut(lines, full))))


def _wrap(text: str | None, width: int) -> str | None:
    if text is None:
        return None
    out: list[str] = []
    line, hang, fenced = "", "", False

    def flush() -> None:
        nonlocal line
        if line:
            out.append(line)
        line = ""

    for raw in text.split("\n"):
        bare = raw.strip()
        if bare.startswith("```"):
            flush()
            fenced = not fenced
            out.append(raw)
            continue
        if fenced or not bare or bare.startswith("#"):
            flush()
            out.append(raw)
            continue
        if bare[:2] in ("- ", "* "):
            flush()
            hang = "  "
        elif not line:
            hang = ""
        for word in bare.split():
            if line and len(line) + 1 + len(word) > width:
                out.append(line)
                line = hang + word
            else:
                line = f"{line} {word}" if line else word
    flush()
    return "\n".join(out)


def wrap(col: Column, width: int) -> Column:
    """Words folded to ``width`` characters; fences, ``#`` lines and blank lines stay, bullets hang by two."""

    @F.pandas_udf("string")
    def wrapped(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _wrap(t, width))

    return wrapped(col)


def member_class(col: Column) -> Column:
    """constant (upper case, longer than one), class (first letter upper) or variable."""
    constant = (F.length(col) > 1) & col.rlike("[A-Z]") & ~col.rlike("[a-z]")
    return F.when(constant, "constant").when(col.rlike("^[A-Z]"), "class").otherwise("variable")


def natural_key(col: Column) -> Column:
    """A text whose order is natural: runs of digits compare by value, unless they lead with zero."""
    # A run without a leading zero is preceded by its length, as one character above '0'.
    runs = F.regexp_extract_all(col, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    longer = lambda r: r.rlike("^[1-9]")
    return F.array_join(F.transform(runs, lambda r: F.when(longer(r), F.concat(F.lit("1"), F.lpad(F.length(r).cast("string"), 4, "0"), r)).otherwise(r)), "")


def kebab(col: Column) -> Column:
    """snake_case or camelCase to kebab-case."""
    return F.lower(F.regexp_replace(F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1-$2"), "_", "-"))


def camel(col: Column) -> Column:
    """snake_case or kebab-case to CamelCase."""
    return F.array_join(F.transform(F.split(col, "[_-]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


# Words that are literals in an expression.
LITERAL_WORDS = ("True", "False", "None", "true", "false", "null", "undefined", "nil")

CLASSIFIED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.StringType()))])


def _split_items(body: str) -> list[str] | None:
    items, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            if c == quote and body[i - 1] != "\\":
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return None
        elif c == "," and not depth:
            items.append(body[start:i].strip())
            start = i + 1
    if quote or depth:
        return None
    last = body[start:].strip()
    return items + ([last] if last else [])


def _classify(text: str | None):
    import re

    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"[rRbBuU]{0,2}(\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*')|[+-]?(\d[\d_]*\.?[\d_]*([eE][+-]?\d+)?|0[xX][0-9a-fA-F_]+)", t, re.S) or t in LITERAL_WORDS:
        return {"kind": "literal", "parts": [t]}
    name = r"[^\W\d]\w*(?:\s*\.\s*[^\W\d]\w*)*"
    if re.fullmatch(name, t):
        return {"kind": "dotted_name", "parts": [p.strip() for p in t.split(".")]}
    if m := re.fullmatch(rf"({name})\s*\((.*)\)", t, re.S):
        if _split_items(m[2]) is not None:
            return {"kind": "call", "parts": [p.strip() for p in m[1].split(".")]}
    if len(t) > 1 and t[0] + t[-1] in ("[]", "()"):
        items = _split_items(t[1:-1])
        if items is not None and "" not in items and all((x := _classify(i)) and x["kind"] in ("literal", "dotted_name", "call") for i in items):
            return {"kind": "sequence", "parts": items}
    return {"kind": "dynamic", "parts": []}


def classify_expr(col: Column) -> Column:
    """kind and parts of an expression: literal, dotted_name, call (of the callee), sequence (of its items) or dynamic."""

    @F.pandas_udf(CLASSIFIED)
    def classified(s: pd.Series) -> pd.DataFrame:
        found = [_classify(t) or {"kind": None, "parts": None} for t in s]
        return pd.DataFrame({"kind": [f["kind"] for f in found], "parts": [f["parts"] for f in found]})

    return classified(col)
