"""Repair of the turn structure of conversations at least cost.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  Edits keep, rerole,
delete or insert turns; states are what the last turn left was: nothing, s, u or a.  Costs
are settled backwards over the rows, and of each node (row, state) the arcs that lie on
a cheapest path stay.  Nodes are then ranked by the labels of their least path over
1, 2, 4, ... arcs: the rank for twice the length is that of the pair (own rank, rank at
the doubled pointer).  The pointers lead along the least path; its labels are the audit.
Of one node no two arcs have the same label, so a rank never has to choose between ends.

Rows are dealt by ranges of conversation and turn.  A conversation inside one partition
is repaired there, many at once.  Those at the edges of partitions, and long ones, go
on as pieces: costs through a piece are a small matrix, matrices are chained backwards
over the pieces of a conversation, each piece then finds its paths by itself, and the
state at its start follows from the pieces before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import written

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows and bytes of text of a piece, and rows that are repaired together.
PIECE_ROWS, PIECE_BYTES, BLOCK_ROWS = 4096, 8 << 20, 8192
_INITIALS = {"s": 0, "u": 1, "a": 2}
_ROLES = {2: "user", 3: "assistant"}
#: States 0 nothing, 1 s, 2 u, 3 a: where keeping a row (by initial) leads, and where reroling or inserting does.
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_TURN = np.array([2, 2, 3, 2])
#: Costs and labels of the inserts that end a conversation in each state.
_END, _TAIL = np.array([0, 2 * INSERT, INSERT, 0]), ["", "II", "I", ""]
_LABELS = np.frombuffer(b" DIKR", np.uint8)
_FAR = 1 << 40


def damage(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and gone of conversations after damage chosen by crc32(conv_id:turn) % 20.

    Nulls are one space.  0 drops the row (it stays as a mark with gone), 1 empties its
    text, 2 removes .!? from it, 3 repeats the row, 4 makes its role user.
    """
    space = F.lit(" ")
    said = [F.coalesce(F.col(c).cast("string"), space) for c in (conv_id, turn, role, text)]
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), said[2].alias("role"), said[3].alias("text"), (F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text_ = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), "kind", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    gone = kind == 0
    return rows.select("conv", "turn", F.when(~gone, F.col("role")).alias("role"), F.when(~gone, F.col("text")).alias("text"), gone.alias("gone"))


def _costs(keep: np.ndarray, loose: np.ndarray, extra: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least cost from each (row, state) to the end of its piece, and from each piece's start.

    keep is the initial of each row, loose whether it may stay, extra what staying costs;
    ends are the costs at the end of each piece by state.
    """
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    g, out = ends.astype(np.int64).copy(), np.zeros((len(keep), 4), np.int64)
    for t in range(1, int(size.max(initial=0)) + 1):
        own = order[: np.searchsorted(-size[order], -t, "right")]
        row, now = offsets[own + 1] - t, g[own]
        free, more = loose[row], extra[row]
        least = now + DELETE
        least = np.minimum(least, np.where(free[:, None], now[:, _TURN] + (REROLE + more)[:, None], _FAR))
        to = _KEEP[:, keep[row]].T
        least = np.minimum(least, np.where(free[:, None] & (to >= 0), np.take_along_axis(now, np.maximum(to, 0), axis=1) + more[:, None], _FAR))
        u, a = np.minimum(least[:, 2], INSERT + least[:, 3]), np.minimum(least[:, 3], INSERT + least[:, 2])
        g[own] = out[row] = np.stack([np.minimum(least[:, 0], INSERT + u), np.minimum(least[:, 1], INSERT + u), u, a], axis=1)
    return out, g


class Paths:
    """The least cheapest paths through pieces of rows, from any state at their starts."""

    def __init__(self, keep, loose, extra, offsets, ends):
        n, pieces = len(keep), len(offsets) - 1
        self.offsets, self.exits = offsets, 4 * n
        cost, self.starts = _costs(keep, loose, extra, offsets, ends)
        row, state = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
        piece = np.repeat(np.arange(pieces), 4 * np.diff(offsets))
        last = row + 1 == offsets[piece + 1]
        after = np.where(last, self.exits + 4 * piece, 4 * (row + 1))  # the node of state 0 after the row
        value = np.concatenate([cost.ravel(), ends.ravel().astype(np.int64)])
        own, free, more, to = value[: self.exits], loose[row], extra[row], _KEEP[state, keep[row]]
        arcs = [
            (own == DELETE + value[after + state], after + state),
            (own == INSERT + value[4 * row + _TURN[state]], 4 * row + _TURN[state]),
            (free & (to >= 0) & (own == more + value[after + np.maximum(to, 0)]), after + np.maximum(to, 0)),
            (free & (own == REROLE + more + value[after + _TURN[state]]), after + _TURN[state]),
        ]
        label, pointer = np.zeros(len(value), np.int64), np.arange(len(value))
        for k in range(3, -1, -1):
            here = np.flatnonzero(arcs[k][0])
            label[here], pointer[here] = k + 1, arcs[k][1][here]
        self.label, self.pointers, self.length = label, [pointer], (label > 0).astype(np.int64)
        self.rank = label
        while (self.pointers[-1] < self.exits).any():
            pointer = self.pointers[-1]
            self.rank = np.unique(self.rank * (int(self.rank.max()) + 1) + self.rank[pointer], return_inverse=True)[1]
            self.length = self.length + self.length[pointer]
            self.pointers.append(pointer[pointer])

    def start(self, piece: np.ndarray, state: np.ndarray) -> np.ndarray:
        empty = self.offsets[piece] == self.offsets[piece + 1]
        return np.where(empty, self.exits + 4 * piece + state, 4 * self.offsets[piece] + state)

    def follow(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of the paths from the given ones, where each path's begin and the last's end, and the state each reaches."""
        count = self.length[nodes]
        bounds = np.concatenate([[0], np.cumsum(count)])
        at, step = np.repeat(nodes, count), np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
        end = self.pointers[-1][nodes]
        for k, pointer in enumerate(self.pointers):
            more = step >> k & 1 == 1
            at[more] = pointer[at[more]]
        return at, bounds, (end - self.exits) % 4


def _tallies(initial: np.ndarray, fault: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """blank, duplicate, truncated and illegal of each piece."""
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    a, b, same = initial[:-1], initial[1:], piece[:-1] == piece[1:]
    bad = same & ~_legal(a, b)
    return np.stack([np.bincount(piece[fault == k], minlength=len(offsets) - 1) for k in (1, 2, 3)] + [np.bincount(piece[:-1][bad], minlength=len(offsets) - 1)], axis=1)


def _legal(a, b):
    return ((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2)


def _faults(code: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """initial, fault (1 blank, 2 duplicate, 3 truncated), loose and extra of rows by their code."""
    fault = np.where(code & 4, 1, np.where(again, 2, np.where(code & 8, 0, 3)))
    return (code & 3).astype(np.int64), fault, (fault != 1) & (fault != 2), np.where(fault == 3, TRUNCATED, 0)


def _lines(paths: Paths, at: np.ndarray, roles: list, texts: list) -> list[tuple[str, str]]:
    """The turns that a path leaves."""
    out = []
    for node, label in zip(at.tolist(), paths.label[at].tolist(), strict=True):
        if label == 3:
            out.append((roles[node >> 2], texts[node >> 2]))
        elif label != 1:
            out.append((_ROLES[int(_TURN[node & 3])], texts[node >> 2] if label == 4 else ""))
    return out


def _tail(state: int) -> list[tuple[str, str]]:
    return [("user", ""), ("assistant", "")][2 - len(_TAIL[state]) :]


class _Piece:
    """Rows of one conversation in a partition, in order."""

    def __init__(self, conv, seq: int):
        self.conv, self.seq = conv, seq
        self.codes, self.digests, self.roles, self.texts, self.bytes = bytearray(), [], [], [], 0
        self.low, self.high, self.turns = None, None, 0

    def add(self, turn, role, text, code, digest) -> None:
        self.codes.append(code)
        self.digests.append(digest)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(role) + len(text)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


_FINAL = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_OPEN = [("codes", pa.binary()), ("digests", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())]
_FIRST = pa.schema([("conv", pa.int64()), ("cid", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("closed", pa.bool_()), *_FINAL, ("repaired", _TURNS), *_OPEN])
_FIRST_SQL = (
    "conv long, cid string, part long, seq long, closed boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "repaired array<struct<role:string,text:string>>, codes binary, digests array<binary>, roles array<string>, texts array<string>, low long, high long, turns long"
)


def _sha(lines: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join([f"{r}:{t}" for r, t in lines]).encode("utf-8", "surrogatepass")).hexdigest()


def _close(pieces: list[_Piece], part: int, keep_turns: bool) -> list[dict]:
    """Final rows of conversations that are one piece each."""
    offsets = np.concatenate([[0], np.cumsum([len(p.codes) for p in pieces])]).astype(np.int64)
    code = np.frombuffer(b"".join([bytes(p.codes) for p in pieces]), np.uint8)
    again = np.zeros(len(code), dtype=bool)
    for k, p in enumerate(pieces):
        seen: set = set()
        for i, d in enumerate(p.digests):
            again[offsets[k] + i] = d in seen
            seen.add(d)
    initial, fault, loose, extra = _faults(code, again)
    paths = Paths(initial, loose, extra, offsets, np.tile(_END, (len(pieces), 1)))
    at, bounds, state = paths.follow(paths.start(np.arange(len(pieces)), np.zeros(len(pieces), np.int64)))
    labels, tallies = _LABELS[paths.label[at]].tobytes().decode(), _tallies(initial, fault, offsets)
    roles, texts = [r for p in pieces for r in p.roles], [t for p in pieces for t in p.texts]
    out = []
    for k, p in enumerate(pieces):
        lines = _lines(paths, at[bounds[k] : bounds[k + 1]], roles, texts) + _tail(state[k])
        blank, duplicate, truncated, illegal = tallies[k].tolist()
        out.append({
            "conv": p.conv, "cid": _cid(p.conv), "part": part, "seq": p.seq, "closed": True, "gaps": p.gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
            "cost": int(paths.starts[k, 0]), "audit": labels[bounds[k] : bounds[k + 1]] + _TAIL[state[k]], "repaired_sha256": _sha(lines), "repaired": [{"role": r, "text": t} for r, t in lines] if keep_turns else None,
        })
    return out


def _cid(conv) -> str:
    return "" if conv is None else str(conv)


def _opened(p: _Piece, part: int) -> dict:
    return {"conv": p.conv, "cid": _cid(p.conv), "part": part, "seq": p.seq, "closed": False, "codes": bytes(p.codes), "digests": p.digests, "roles": p.roles, "texts": p.texts, "low": p.low, "high": p.high, "turns": p.turns}


def _first_pass(rows: DataFrame, keep_turns: bool) -> DataFrame:
    """The final row of every conversation inside a partition, and the pieces of the others."""

    def scan(batches):
        from pyspark import TaskContext

        part, piece, first, long, block, ready, n = TaskContext.get().partitionId(), None, True, False, [], [], 0

        def out():
            nonlocal block, ready, n
            found = ready + (_close(block, part, keep_turns) if block else [])
            block, ready, n = [], [], 0
            return pa.RecordBatch.from_pylist(found, schema=_FIRST)

        for batch in batches:
            for conv, turn, role, text, gone, code, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        if first or long:
                            ready.append(_opened(piece, part))
                        else:
                            block.append(piece)
                        first = False
                        n += len(piece.codes) + 1
                        if n >= BLOCK_ROWS or sum(p.bytes for p in block[-64:]) > PIECE_BYTES or len(ready) > 1:
                            yield out()
                    piece, long = _Piece(conv, 0), False
                elif len(piece.codes) >= PIECE_ROWS or piece.bytes >= PIECE_BYTES:
                    ready.append(_opened(piece, part))
                    yield out()
                    piece, long = _Piece(conv, piece.seq + 1), True
                if not gone:
                    piece.add(turn, role, text, code, digest)
        if piece is not None:
            ready.append(_opened(piece, part))
        if ready or block:
            yield out()

    # A row's code: its initial (s, u, a, other), and whether its text is blank, and ends a sentence.
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(4) + F.when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 8).otherwise(0)
    framed = F.concat(F.octet_length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    rows = rows.select("conv", "turn", "role", "text", "gone", code.cast("int").alias("code"), F.unhex(F.substring(F.sha2(framed, 256), 1, 32)).alias("digest"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("digest")]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, _FIRST_SQL))


def _joined_pieces(pieces: DataFrame, keep_turns: bool) -> DataFrame:
    """The final rows of conversations that lie in several pieces."""
    key = ["cid", "part", "seq"]
    rows = pieces.select("cid", F.struct("part", "seq").alias("p"), F.posexplode("digests").alias("pos", "digest"))
    fresh = rows.groupBy("cid", "digest").agg(F.min(F.struct("p", "pos")).alias("f")).select("cid", "f.p.part", "f.p.seq", "f.pos").groupBy(*key).agg(F.collect_list("pos").alias("fresh"))
    coded = written(pieces.select(*key, "conv", "codes", "low", "high", "turns").join(fresh, key, "left"))

    def faults(codes, fresh):
        code = np.frombuffer(codes, np.uint8)
        again = np.ones(len(code), dtype=bool)
        again[np.array(fresh or [], np.int64)] = False
        return _faults(code, again)

    def through(batches):
        for batch in batches:
            for cid, part, seq, codes, fresh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                initial, _, loose, extra = faults(codes, fresh)
                n = len(initial)
                ends = np.where(np.eye(4, dtype=bool), 0, _FAR)
                _, starts = _costs(np.tile(initial, 4), np.tile(loose, 4), np.tile(extra, 4), np.arange(5) * n, ends)
                yield pa.RecordBatch.from_pydict({"cid": [cid], "part": [part], "seq": [seq], "matrix": [starts.ravel().tolist()]})

    def backwards(batches):
        now, ends = None, _END
        for batch in batches:
            for cid, part, seq, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cid != now:
                    now, ends = cid, _END
                yield pa.RecordBatch.from_pydict({"cid": [cid], "part": [part], "seq": [seq], "ends": [ends.tolist()]})
                ends = (np.array(matrix, np.int64).reshape(4, 4) + ends[:, None]).min(axis=0)  # rows of the matrix: states at the end

    matrices = coded.select(*key, "codes", "fresh").mapInArrow(through, "cid string, part long, seq long, matrix array<long>")
    ends = matrices.repartition("cid").sortWithinPartitions("cid", F.desc("part"), F.desc("seq")).mapInArrow(backwards, "cid string, part long, seq long, ends array<long>")
    schema = pa.schema([("cid", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("exits", pa.list_(pa.int64())), ("cost", pa.int64()), ("tally", pa.list_(pa.int64())), ("initials", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])

    def settle(batches):
        for batch in batches:
            for cid, part, seq, codes, fresh, low, high, turns, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                initial, fault, loose, extra = faults(codes, fresh)
                offsets = np.array([0, len(initial)])
                paths = Paths(initial, loose, extra, offsets, np.array([ends]))
                _, _, exits = paths.follow(paths.start(np.zeros(4, np.int64), np.arange(4)))
                edge = [int(initial[0]), int(initial[-1])] if len(initial) else []
                yield pa.RecordBatch.from_pylist([{"cid": cid, "part": part, "seq": seq, "exits": exits.tolist(), "cost": int(paths.starts[0, 0]), "tally": _tallies(initial, fault, offsets)[0].tolist(), "initials": edge, "low": low, "high": high, "turns": turns}], schema=schema)

    def forwards(batches):
        now, state = None, 0
        for batch in batches:
            for cid, part, seq, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cid != now:
                    now, state = cid, 0
                yield pa.RecordBatch.from_pydict({"cid": [cid], "part": [part], "seq": [seq], "state": [state]})
                state = exits[state]

    coded = written(coded.join(ends, key))
    settled = written(coded.select(*key, "codes", "fresh", "low", "high", "turns", "ends").mapInArrow(settle, "cid string, part long, seq long, exits array<long>, cost long, tally array<long>, initials array<long>, low long, high long, turns long"))
    entered = settled.select(*key, "exits").repartition("cid").sortWithinPartitions(*key).mapInArrow(forwards, "cid string, part long, seq long, state long")
    whole = pieces.select(*key, "conv", "roles", "texts").join(coded.select(*key, "codes", "fresh", "ends"), key).join(entered, key).join(settled.drop("exits"), key)
    final = pa.schema([("conv", pa.int64()), *_FINAL, ("repaired", _TURNS)])

    def render(batches):
        now = None

        def out():
            low, high, turns = span
            found = {"conv": conv, "gaps": high - low + 1 - turns if turns else 0, "blank": tally[0], "duplicate": tally[1], "truncated": tally[2], "illegal": tally[3], "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest(), "repaired": kept if keep_turns else None}
            return pa.RecordBatch.from_pylist([found], schema=final)

        def say(lines):
            nonlocal spoken
            if lines:
                digest.update(("\n" * spoken + "\n".join([f"{r}:{t}" for r, t in lines])).encode("utf-8", "surrogatepass"))
                spoken = True
                if keep_turns:
                    kept.extend({"role": r, "text": t} for r, t in lines)

        for batch in batches:
            for cid, conv_, roles, texts, codes, fresh, ends, state, cost_, counts, edge, low, high, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cid != now:
                    if now is not None:
                        say(_tail(left))
                        audit.append(_TAIL[left])
                        yield out()
                    now, conv, cost, tally, audit, digest, kept, spoken, before, span = cid, conv_, cost_, [0] * 4, [], hashlib.sha256(), [], False, None, (None, None, 0)
                initial, _, loose, extra = faults(codes, fresh)
                paths = Paths(initial, loose, extra, np.array([0, len(initial)]), np.array([ends]))
                at, _, exits = paths.follow(paths.start(np.zeros(1, np.int64), np.array([state])))
                left = int(exits[0])
                audit.append(_LABELS[paths.label[at]].tobytes().decode())
                say(_lines(paths, at, roles, texts))
                tally = [a + b for a, b in zip(tally, counts, strict=True)]
                if edge:
                    if before is not None and not _legal(np.array(before), np.array(edge[0])):
                        tally[3] += 1
                    before = edge[1]
                if turns:
                    span = (low if span[2] == 0 else span[0], high, span[2] + turns - (span[2] > 0 and span[1] == low))
        if now is not None:
            say(_tail(left))
            audit.append(_TAIL[left])
            yield out()

    whole = whole.repartition("cid").sortWithinPartitions(*key).select("cid", "conv", "roles", "texts", "codes", "fresh", "ends", "state", "cost", "tally", "initials", "low", "high", "turns")
    return whole.mapInArrow(render, _SAID + ", repaired array<struct<role:string,text:string>>")


_SAID = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, *, keep_turns: bool = False) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conv of rows(conv, turn, role, text, gone).

    Rows come in order of turn, nulls first; ties in order of role, the first 64
    characters of the text, and a digest of both.  A row's first fault counts: blank,
    duplicate of an earlier role and text, truncated.  audit has the initials of the
    cheapest edits (Keep, Rerole, Delete, Insert), the least of them in ASCII.  With
    keep_turns, ``repaired`` has the turns that are left.  A row with gone is no turn, but
    its conversation has a row of the result: zeros, an empty audit and the digest of no
    bytes where no other is left.  A null conv is a conversation of its own; roles and
    texts are taken as they are, however long; an empty table gives no row.
    """
    found = _first_pass(rows, keep_turns)
    names = [c.split()[0] for c in _SAID.split(", ")] + ["repaired"] * keep_turns
    return found.where("closed").select(names).unionByName(_joined_pieces(found.where("not closed"), keep_turns).select(names))


def conversation_repairs(conversations: DataFrame, *, keep_turns: bool = False) -> DataFrame:
    """conv_id and what repair says of every conversation of conversations(conv_id, turn, role, text) after damage; other columns are not read."""
    return repair(damage(conversations), keep_turns=keep_turns).withColumnRenamed("conv", "conv_id")
