"""Stateful streams of file changes and edits, and stateless findings on streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lint import line_findings
from ..sources.files import numbered

UPSERT = "path string, content_hash string, language string, flavor string, generation int, rebuilds int, touched int, version long, placed long, outcome string"
_UPSERT_STATE = "content_hash string, language string, flavor string, generation int, rebuilds int, touched int, version long, placed long"


def _in_order(batches, by: list[str]) -> pd.DataFrame:
    parts = [p for p in batches if len(p)]
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def _sorted(batches, *columns: str) -> list[tuple]:
    """The rows of a group as tuples of columns in order of the first, those of equal rank as they came; cheap for groups of a few rows."""
    rows = [r for p in batches for r in zip(*(p[c].array for c in columns), strict=True)]
    return sorted(rows, key=lambda r: (r[0] != r[0], r[0]))  # a missing rank comes last


def _one(schema: str, row: tuple) -> pd.DataFrame:
    """A frame of one row; longs may be null."""
    fields = [c.split() for c in schema.split(", ")]
    return pd.DataFrame({name: pd.array([x], "Int64") if kind == "long" else [x] for (name, kind), x in zip(fields, row, strict=True)}, copy=False)


def upsert_stream(changes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The store's entry after each micro-batch of changes(path, version, content_hash, language, flavor, removed), by path.

    Equal content, language and flavor only count as touched; others make a new
    generation and a rebuild; a removal bumps the generation.  Versions order the changes
    of a path within and across micro-batches: one that is not newer than the entry's is
    stale and changes nothing, however late it comes.  placed is the version that first
    placed the path since it was last absent; with_sequence numbers entries by it.
    outcome says what the last change of the batch did.  The state holds a hash, never
    the text; with ttl_ms it is dropped when a path had no change for so long.
    """

    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        digest, language, flavor, generation, rebuilds, touched, version, placed = state.get if state.exists else (None, None, None, 0, 0, 0, None, None)
        outcome = None
        for at, removed, *kind in _sorted(batches, "version", "removed", "content_hash", "language", "flavor"):
            kind = tuple(x if isinstance(x, str) else None for x in kind)
            if version is not None and at <= version:
                outcome = "stale"
                continue
            version = int(at)
            if removed:
                digest, language, flavor, placed, generation, outcome = None, None, None, None, generation + 1, "removed"
            elif placed is not None and kind == (digest, language, flavor):
                touched, outcome = touched + 1, "touched"
            else:
                rebuilds += generation > 0
                outcome = "replaced" if generation else "added"
                placed = version if placed is None else placed
                (digest, language, flavor), generation = kind, generation + 1
        entry = (digest, language, flavor, int(generation), int(rebuilds), int(touched), version, placed)
        state.update(entry)
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield _one(UPSERT, (*key, *entry, outcome))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return changes.groupBy("path").applyInPandasWithState(update, UPSERT, _UPSERT_STATE, "update", timeout)


def with_sequence(entries: DataFrame) -> DataFrame:
    """entries(path, placed, ...) of present paths with sequence: their number in the order in which they were placed, numbered by partition."""
    return numbered(entries.where("placed is not null"), "placed", "path", name="sequence")


WATCH = "path string, stamp string, state string"


def watch_stream(stamps: DataFrame) -> DataFrame:
    """path, stamp and state (changed or unchanged) of each path's last stamp in a micro-batch against the one before; a missing file has a null stamp, which is a value."""

    def update(key, batches, state: GroupState):
        seen, before = (True, state.get[0]) if state.exists else (False, None)
        now = _sorted(batches, "version", "stamp")[-1][1]
        now = now if isinstance(now, str) else None
        state.update((now,))
        yield _one(WATCH, (*key, now, "unchanged" if seen and now == before else "changed"))

    return stamps.groupBy("path").applyInPandasWithState(update, WATCH, "stamp string", "update", GroupStateTimeout.NoTimeout)


def apply_changes(text: str | None, changes: list[tuple]) -> str | None:
    """text after one list of (start, end, replacement) in characters, start None for a full replacement; None if any item is malformed."""
    for start, end, replacement in changes:
        if replacement is None:
            return None
        if start is None:
            text = replacement
            continue
        if text is None or end is None or not 0 <= start <= end <= len(text):
            return None
        text = text[:start] + replacement + text[end:]
    return text


EDITED = "uri string, version long, text string, rejected long"


def _edited(text, version, rejected, rows: pd.DataFrame):
    """Change lists in order of version; one bad item rejects its list."""
    for v, part in rows.groupby("version", sort=True):
        items = [(None if pd.isna(r.start) else int(r.start), None if pd.isna(r.end) else int(r.end), r.text) for r in part.sort_values("ordinal").itertuples()]
        new = apply_changes(text, items) if version is None or v > version else None
        if new is None:
            rejected += 1
        else:
            text, version = new, int(v)
    return text, version, rejected


def edit_stream(changes: DataFrame) -> DataFrame:
    """uri, version, text and rejected of every document that a micro-batch of changes(uri, version, ordinal, start, end, text) touched."""

    def update(key, batches, state: GroupState):
        text, version, rejected = state.get if state.exists else (None, None, 0)
        text, version, rejected = _edited(text, version, rejected, _in_order(batches, ["version", "ordinal"]))
        state.update((text, version, int(rejected)))
        yield pd.DataFrame({"uri": [key[0]], "version": pd.array([version], "Int64"), "text": [text], "rejected": [rejected]})

    return changes.groupBy("uri").applyInPandasWithState(update, EDITED, "text string, version long, rejected long", "update", GroupStateTimeout.NoTimeout)


def edit_batch(changes: DataFrame) -> DataFrame:
    """The documents after all changes: the batch form of edit_stream, one group for each document."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        text, version, rejected = _edited(None, None, 0, pdf)
        return pd.DataFrame({"uri": [key[0]], "version": pd.array([version], "Int64"), "text": [text], "rejected": [rejected]})

    return changes.groupBy("uri").applyInPandas(run, EDITED)


class Lines:
    """A document as its lines, each with what ends it, into which edits are spliced."""

    def __init__(self, lines: list[str]):
        self.lines = lines

    @staticmethod
    def cut(text: str) -> list[str]:
        """Lines with their ``\\n``; the last has none and may be empty."""
        parts = text.split("\n")
        return [p + "\n" for p in parts[:-1]] + parts[-1:]

    def column(self, line: int, character: int, unit: str) -> int | None:
        """The place in a line of a position in utf8, utf16 or utf32 units; None outside the line or inside a character."""
        if not 0 <= line < len(self.lines) or character < 0:
            return None
        text = self.lines[line]
        if text.endswith("\n"):
            text = text[:-2] if text.endswith("\r\n") else text[:-1]
        if unit == "utf32" or text.isascii():
            return character if character <= len(text) else None
        width = (lambda c: len(c.encode())) if unit == "utf8" else (lambda c: 1 + (c > "\uffff"))
        at = 0
        for n, c in enumerate(text):
            if at >= character:
                return n if at == character else None
            at += width(c)
        return len(text) if at == character else None

    def splice(self, first: int, last: int, new: list[str]) -> list[str]:
        """Puts new in the place of the lines first..last and returns those."""
        old = self.lines[first:last]
        self.lines[first:last] = new
        return old

    def apply(self, changes: list[tuple], unit: str) -> bool:
        """One list of (line, character, end line, end character, text), all of it or, if an item is malformed, nothing."""
        undo = []
        for line, character, last, end, text in changes:
            if text is None:
                break
            if line is None:
                new = self.cut(text)
                undo.append((0, len(new), self.splice(0, len(self.lines), new)))
                continue
            if None in (character, last, end):
                break
            a, b = self.column(line, character, unit), self.column(last, end, unit)
            if a is None or b is None or (last, b) < (line, a):
                break
            new = self.cut(self.lines[line][:a] + text + self.lines[last][b:])
            if last + 1 < len(self.lines):  # the end of the last line stays one
                new.pop()
            undo.append((line, line + len(new), self.splice(line, last + 1, new)))
        else:
            return True
        for first, last, old in reversed(undo):
            self.splice(first, last, old)
        return False


RANGED = "uri string, version long, text string, rejected long"
_RANGE = ["line", "character", "end_line", "end_character"]


def _ranged(lines: list[str] | None, version, rejected, rows: pd.DataFrame, unit: str):
    """Change lists in order of version, each whole or not at all; one that is not newer than the document is rejected."""
    document = Lines(list(lines) if lines is not None else [])
    for v, part in rows.groupby("version", sort=True):
        part = part.sort_values("ordinal")
        numbers = [[None if pd.isna(x) else int(x) for x in part[c]] for c in _RANGE]
        items = list(zip(*numbers, [None if t is None or (isinstance(t, float) and pd.isna(t)) else t for t in part["text"]], strict=True))
        if (version is None or v > version) and document.apply(items, unit):
            version = int(v)
        else:
            rejected += 1
    return document.lines, version, rejected


def range_edit_stream(changes: DataFrame, unit: str = "utf16") -> DataFrame:
    """uri, version, text and rejected of every document that a micro-batch of changes touched.

    changes: uri, version, ordinal, line, character, end_line, end_character (from 0, in
    units of utf8, utf16 or utf32; line null: the whole document), text.  A range that is
    outside the document, ends inside a character or runs backward rejects its whole list,
    and so does a null text.  The state is the lines of the document; an edit touches the
    lines of its range only.  A document begins with a change of the whole.
    """

    def update(key, batches, state: GroupState):
        lines, version, rejected = state.get if state.exists else (None, None, 0)
        rows = _in_order(batches, ["version", "ordinal"])
        lines, version, rejected = _ranged(lines, version, rejected, rows, unit)
        state.update((lines, version, int(rejected)))
        yield pd.DataFrame({"uri": [key[0]], "version": pd.array([version], "Int64"), "text": ["".join(lines) if version is not None else None], "rejected": [int(rejected)]})

    return changes.groupBy("uri").applyInPandasWithState(update, RANGED, "lines array<string>, version long, rejected long", "update", GroupStateTimeout.NoTimeout)


def range_edit_batch(changes: DataFrame, unit: str = "utf16") -> DataFrame:
    """The documents after all changes: the batch form of range_edit_stream, one group for each document."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lines, version, rejected = _ranged(None, None, 0, pdf, unit)
        return pd.DataFrame({"uri": [key[0]], "version": pd.array([version], "Int64"), "text": ["".join(lines) if version is not None else None], "rejected": [int(rejected)]})

    return changes.groupBy("uri").applyInPandas(run, RANGED)


def stream_findings(files: DataFrame, width: int = 100) -> DataFrame:
    """Findings of the line rules, file by file; stateless, so equal to those of a whole run."""
    return line_findings(files, width)


def stream_tally(files: DataFrame, width: int = 100) -> DataFrame:
    """code and n so far, for complete or update mode."""
    return stream_findings(files, width).groupBy("code").agg(F.count("*").alias("n"))
