"""Regions, comments, attributes and identifiers of markup pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Script types that hold JavaScript.
SCRIPT_TYPES = ("", "application/ecmascript", "application/javascript", "module", "text/ecmascript", "text/javascript")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=`]+))", re.S)
_HOLE = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.S)


def _tag_of(name: str, tags: dict[str, str]) -> str | None:
    """The tag of an attribute: by its whole name, or by a key that ends with ``*`` and begins it."""
    return tags.get(name) or next((t for k, t in tags.items() if k.endswith("*") and name.startswith(k[:-1])), None)


def _regions(text: str | None, tags: dict[str, str] | None = None) -> list[tuple[str, int, int, str | None]]:
    """kind, start, end and tag of the embedded code, in order of start and end; none is empty."""
    text, out, at = text or "", [], 0
    while m := _TAG.search(text, at):
        at = m.end()
        if not m[1]:
            continue
        element, script = m[1].lower(), True
        for x in _ATTRIBUTE.finditer(text, m.start(2), m.end(2)):
            g = next(k for k in (2, 3, 4) if x[k] is not None)
            if x[1].lower() == "type" and x[g].strip().lower() not in SCRIPT_TYPES:
                script = False
            tag = "style" if x[1].lower() == "style" else _tag_of(x[1], tags or {})
            if tag and x[g]:
                out.append(("attribute", x.start(g), x.end(g), tag))
        if element in ("script", "style"):
            close = re.compile(rf"</{element}\s*>", re.I).search(text, at)
            end = close.start() if close else len(text)
            if end > at and (script or element == "style"):
                out.append((element, at, end, None))
            at = end
    return sorted(out, key=lambda r: (r[1], r[2]))


def _comments(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = [("html", m.start(), m.end()) for m in re.finditer(r"<!--.*?(?:-->|\Z)", text, re.S)]
    out += [("template", m.start(), m.end()) for m in re.finditer(r"\{#.*?#\}|\{%-?\s*comment\b.*?%\}.*?\{%-?\s*endcomment\s*-?%\}", text, re.S)]
    for kind, a, b, _ in _regions(text):
        if kind == "script":
            out += [("script", a + m.start(), a + m.end()) for m in re.finditer(r"/\*.*?\*/|//[^\n]*", text[a:b], re.S)]
        elif kind == "style":
            out += [("style", a + m.start(), a + m.end()) for m in re.finditer(r"/\*.*?\*/", text[a:b], re.S)]
    return sorted(out, key=lambda x: (x[1], x[2]))


def _exploded(pages: DataFrame, find, page: str, html: str) -> DataFrame:
    @F.pandas_udf("array<struct<kind:string,offset:int,length:int,tag:string,holes:array<struct<offset:int,length:int>>>>")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            out = []
            for kind, a, b, *tag in find(text):
                at = len(text[:a].encode())
                holes = [{"offset": at + len(text[a : a + m.start()].encode()), "length": len(m.group().encode())} for m in _HOLE.finditer(text[a:b])] if tag else []
                out.append({"kind": kind, "offset": at, "length": len(text[a:b].encode()), "tag": tag[0] if tag else None, "holes": holes})
            return out

        return s.map(one)

    rows = pages.select(F.col(page).alias("page_id"), F.posexplode(run(F.coalesce(F.col(html), F.lit("")))).alias("ordinal", "r"))
    return rows.select("page_id", "ordinal", "r.kind", "r.offset", "r.length", "r.tag", "r.holes")


def markup_regions(pages: DataFrame, page: str = "page_id", html: str = "html", tags: dict[str, str] | None = None) -> DataFrame:
    """page_id, ordinal, kind, offset and length in bytes, tag and holes of the embedded code, in order of offset and end.

    kind is script (only types that hold JavaScript), style or attribute; the tag of an
    attribute is style, or what ``tags`` names it by: attribute names, or their beginning
    before a ``*``.  holes are the offsets and lengths of template marks inside.  Empty
    regions are none; comments hold none.
    """
    return _exploded(pages, lambda text: _regions(text, tags), page, html)


def comment_spans(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, ordinal, kind (html, template, script or style), offset and length in bytes of the comments."""
    return _exploded(pages, _comments, page, html).drop("tag", "holes")


_ISLANDS = r"(?is)<!--.*?(?:-->|$)|(<(script|style)\b[^>]*>).*?</\2\s*>"
_VALUE = r"(?s)([^\s=\"'<>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+)"


def attributes(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, element, tag (its number in the page), attribute and value, lower-cased names, outside comments, scripts and styles."""
    plain = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), _ISLANDS, "$1")
    tags = pages.select(F.col(page).alias("page_id"), F.posexplode(F.regexp_extract_all(plain, F.lit(r"(?s)<([A-Za-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"), 1)).alias("tag", "body"))
    pairs = tags.select("page_id", "tag", F.lower(F.regexp_extract("body", r"^([^\s/>]+)", 1)).alias("element"), F.explode(F.regexp_extract_all("body", F.lit(_VALUE), 0)).alias("pair"))
    name = F.lower(F.regexp_extract("pair", _VALUE, 1))
    value = F.regexp_extract("pair", _VALUE, 2)
    bare = F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return pairs.select("page_id", "tag", "element", name.alias("attribute"), bare.alias("value"))


# Attributes that refer to identifiers, by how.
LISTS = ("aria-activedescendant", "aria-controls", "aria-describedby", "aria-details", "aria-errormessage", "aria-flowto", "aria-labelledby", "aria-owns", "headers")
SINGLE = ("for", "form", "list")
LINKS = ("href", "usemap", "xlink:href")


def markup_ids(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defs, uses): page_id, kind and name, from rows of attributes().

    ``id`` defines; list attributes use one name for each word, single ones their one
    word, links the name after ``#``.  Repeated attributes of a tag and values with
    template marks are skipped.
    """
    name = F.col("attribute")
    ok = found.where(~F.col("value").rlike(r"\{\{|\{%")).dropDuplicates(["page_id", "tag", "attribute"])
    defs = ok.where((name == "id") & (F.trim("value") != "")).select("page_id", "tag", F.lit("id").alias("kind"), F.trim("value").alias("name"))
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    names: Column = F.when(name.isin(*LISTS), words).when(name.isin(*SINGLE) & (F.size(words) == 1), words)
    names = names.when(name.isin(*LINKS) & F.col("value").rlike("^#."), F.array(F.substring("value", 2, 1 << 30)))
    uses = ok.where(names.isNotNull()).select("page_id", "tag", F.lit("id").alias("kind"), F.explode(names).alias("name"))
    return defs, uses
