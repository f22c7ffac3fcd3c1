"""Cheapest repair of conversation structure, by a checkpointed dynamic program."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.session import materialize

# States of what has been emitted: nothing, a system message, a user's, an assistant's. Nothing and an assistant's may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_INSERT = (USER, USER, ASSISTANT, USER)  # the only message that may follow and may be inserted or given another role
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = "sua"
# A row's code: place of its role's initial in INITIALS (3: none of them), plus 4 if truncated; or FORCED, a row that has to go.
TRUNCATED, FORCED = 4, 8
INSERT, REROLE, DELETE, UNFINISHED = 2, 2, 3, 1  # costs; the last for each truncated row that stays
FAR = 1 << 40  # no way
ROLES = {USER: "user", ASSISTANT: "assistant"}

PIECE_ROWS = 512
PIECE_CHARS = 2_000_000
PIECES = """conv_id long, part long, seq long, codes binary, roles array<string>, texts array<string>, matrix array<long>, blank long, duplicate long, truncated long,
  illegal long, first string, last string, low long, high long, turns long"""
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CHECKPOINTS = "p long, q long, to_go array<long>, last_piece long, cost long"
MESSAGES = "conv_id long, position long, role string, text string, edit string"

Vector = tuple[int, int, int, int]


def with_inserts(v: Vector) -> Vector:
    """Costs to go where messages may be inserted first."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


END: Vector = with_inserts((0, FAR, FAR, 0))


def edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row as ``(initial, cost, next state)``, in ASCII order."""
    out = [("D", DELETE, state)]
    if code != FORCED:
        extra = UNFINISHED if code & TRUNCATED else 0
        kept = KEEPS.get((INITIALS + "-")[code & 3], {}).get(state)
        if kept is not None:
            out.append(("K", extra, kept))
        out.append(("R", REROLE + extra, AFTER_INSERT[state]))
    return out


@functools.lru_cache(maxsize=1 << 14)
def _step(code: int, v: Vector) -> Vector:
    return with_inserts(tuple(min(cost + v[to] for _, cost, to in edits(code, s)) for s in range(4)))


def before(code: int, v: Vector) -> Vector:
    """Costs to go before a row, from those behind it. Few differences between states occur, so steps are remembered."""
    low = min(v)
    return tuple(min(x + low, FAR) for x in _step(code, tuple(min(x - low, FAR) for x in v)))


def matrix(codes: bytes) -> list[int]:
    """Cheapest costs of a piece from every state to every state, row by row."""
    columns = []
    for end in range(4):
        v = tuple(0 if s == end else FAR for s in range(4))
        for code in reversed(codes):
            v = before(code, v)
        columns.append(v)
    return [columns[end][s] for s in range(4) for end in range(4)]


def walk(codes: bytes, state: int, to_go: Vector, last: bool) -> Iterator[tuple[str, int, int]]:
    """Edits of the ASCII-least cheapest way through a piece: ``(initial, row, state afterwards)``.

    ``to_go`` is the checkpoint behind the piece; the vectors inside are computed again and live as long as the walk.
    """
    costs = [to_go]
    for code in reversed(codes):
        costs.append(before(code, costs[-1]))
    costs.reverse()
    at = 0
    while at < len(codes) or (last and costs[at][state]):
        ways = [(sign, cost, at + 1, to) for sign, cost, to in edits(codes[at], state)] if at < len(codes) else []
        ways.insert(min(1, len(ways)), ("I", INSERT, at, AFTER_INSERT[state]))
        sign, _, then, to = next(w for w in ways if w[1] + costs[w[2]][w[3]] == costs[at][state])
        yield sign, at, to
        at, state = then, to


class Cutter:
    """Cuts sorted rows of one conversation after another into pieces of bounded size."""

    def __init__(self, part: int, most_rows: int, most_chars: int) -> None:
        self.part, self.most_rows, self.most_chars, self.seq = part, most_rows, most_chars, 0
        self.conv = None
        self._open()

    def _open(self) -> None:
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = None
        self.low = self.high = None
        self.turns = 0
        self.empty = True

    def close(self) -> dict | None:
        if self.empty:
            return None
        out = {
            "conv_id": self.conv, "part": self.part, "seq": self.seq, "codes": bytes(self.codes), "roles": self.roles, "texts": self.texts, "matrix": matrix(self.codes), **self.counts,
            "first": self.first, "last": self.last, "low": self.low, "high": self.high, "turns": self.turns,
        }
        self.seq += 1
        self._open()
        return out

    def add(self, conv: int | None, turn: int | None, role: str, text: str, copies: int, blank: bool, truncated: bool, first: bool) -> Iterator[dict]:
        """Equal rows of one turn come as one; behind the first of them all are duplicates."""
        if conv != self.conv and not self.empty:
            yield self.close()
        self.conv, self.empty = conv, False
        initial = role[:1]
        for k in range(copies):
            if len(self.codes) >= self.most_rows or self.chars >= self.most_chars:
                yield self.close()
                self.empty = False
            fault = "blank" if blank else "duplicate" if k or not first else "truncated" if truncated else None
            goes = fault in ("blank", "duplicate")
            self.codes.append(FORCED if goes else "sua".find(initial or "-") % 4 + (TRUNCATED if fault else 0))
            self.roles.append(None if goes else role)
            self.texts.append(None if goes else text)
            self.chars += 0 if goes else len(text)
            if fault:
                self.counts[fault] += 1
            if self.last is None:
                self.first = initial
            elif self.last + initial not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.last = initial
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1


def _records(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(",")]
    return pa.record_batch([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def cut_pieces(turns: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None, piece_rows: int, piece_chars: int) -> DataFrame:
    """Conversations in order, cut into pieces that carry their costs from state to state. Stored."""
    there = F.lit(1) if copies is None else copies
    raw = turns.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), there.cast("long").alias("copies"))
    # A row that is not there only tells that its conversation exists.
    gone = F.col("copies") <= 0
    raw = raw.select(
        "conv", F.when(~gone, F.col("turn")).alias("turn"), *[F.when(gone, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")], F.greatest("copies", F.lit(0)).alias("copies"))
    body = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    places = raw.filter((F.col("copies") > 0) & (body != "")).select("conv", "role", F.sha2("text", 256).alias("h"), F.struct("turn").alias("at"))
    repeated = places.groupBy("conv", "role", "h").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a <> b").select(
        F.col("conv").alias("c"), F.col("role").alias("r"), "h", F.col("a.turn").alias("first_turn"), F.lit(True).alias("again"))
    one = raw.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("own", F.sha2("text", 256))
    met = one.join(repeated, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("own") == F.col("h")), "left")
    flags = met.select(
        "conv", "turn", "role", "text", "copies", (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"),
        (F.col("again").isNull() | F.col("turn").eqNullSafe(F.col("first_turn"))).alias("first"))
    rows = materialize(flags, "turns")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(TaskContext.get().partitionId(), piece_rows, piece_chars)
        held, chars = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "blank", "truncated", "first")]):
                for piece in cutter.add(*row):
                    held.append(piece)
                    chars += 100 + sum(len(t) for t in piece["texts"] if t)
                    if chars >= piece_chars:
                        yield _records(held, PIECES)
                        held, chars = [], 0
        final = cutter.close()
        yield _records([*held, *([final] if final else [])], PIECES)

    order = ["conv", "turn", "role", "text"]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task, PIECES), "pieces")


def checkpoints(pieces: DataFrame) -> DataFrame:
    """``(p, q, to_go, last_piece, cost)`` by part and seq: the cost vector behind each piece, and before it from the start.

    Pieces of a conversation pass from its end to its start; a task holds one vector.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, v, fresh = None, END, True
        for batch in batches:
            out = []
            for own, part, seq, m in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "seq", "matrix")]):
                last = fresh or own != conv
                conv, fresh, v = own, False, END if last else v
                then = tuple(min(min(m[4 * s + t] + v[t] for t in range(4)), FAR) for s in range(4))
                out.append({"p": part, "q": seq, "to_go": list(v), "last_piece": int(last), "cost": then[START]})
                v = then
            yield _records(out, CHECKPOINTS)

    small = pieces.select("conv_id", "part", "seq", "matrix")
    order = [F.col("conv_id"), F.col("part").desc(), F.col("seq").desc()]
    return small.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(task, CHECKPOINTS)


class Conversation:
    """Report of a conversation whose pieces come in order."""

    def __init__(self, conv: int | None, cost: int) -> None:
        self.out = {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": cost}
        self.state, self.audit, self.digest, self.emitted = START, [], hashlib.sha256(), 0
        self.initial = self.low = self.high = None
        self.turns = 0

    def add(self, piece: dict) -> list[dict]:
        for c in ("blank", "duplicate", "truncated", "illegal"):
            self.out[c] += piece[c]
        if piece["first"] is not None:
            self.out["illegal"] += self.initial is not None and self.initial + piece["first"] not in ("su", "ua", "au")
            self.initial = piece["last"]
        if piece["low"] is not None:
            self.turns += piece["turns"] - (piece["low"] == self.high)
            self.low = piece["low"] if self.low is None else self.low
            self.high = piece["high"]
        messages, signs = [], []
        for sign, at, state in walk(piece["codes"], self.state, tuple(piece["to_go"]), bool(piece["last_piece"])):
            self.state = state
            signs.append(sign)
            if sign == "D":
                continue
            role = piece["roles"][at] if sign == "K" else ROLES[state]
            text = "" if sign == "I" else piece["texts"][at]
            self.digest.update((("\n" if self.emitted else "") + role + ":" + text).encode())
            messages.append({"conv_id": self.out["conv_id"], "position": self.emitted, "role": role, "text": text, "edit": sign})
            self.emitted += 1
        self.audit.append("".join(signs))
        return messages

    def report(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return self.out | {"gaps": min(gaps, (1 << 63) - 1), "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, messages: bool = False,
    piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The cheapest edits that make the roles of every conversation follow ``(system? (user assistant)+)?``.

    Rows are taken by turn, nulls first, then by role and text. A row's fault is the first of: blank (nothing but white
    space), duplicate (role and text seen earlier), truncated (does not end in ``.!?``). Keep costs 0, Rerole to user
    or assistant 2, Delete 3 (required for blank and duplicate rows), Insert of an empty user or assistant message 2;
    truncated rows that stay cost 1. Of the cheapest repairs the one whose initials are ASCII-least is taken. Roles go by their
    first letter: s, u, a; others have to be changed or deleted.

    Returns a row for every ``conv_id`` (``REPORT``), or with ``messages`` the repaired messages (``MESSAGES``), whose
    ``edit`` is K, R or I. Null ids are one conversation; null roles and texts are one space; null turns come first and have no part in gaps.
    ``copies`` says how often a row is there (once if not given); a conversation all of whose rows are there 0 times has
    zeros, an empty audit and the hash of an empty string. Other columns are ignored, whatever their names.

    Plan: rows are sorted by range, so that a long conversation is spread over tasks, and cut into pieces with a 4 x 4 matrix
    of costs each. Vectors at the pieces' ends, the checkpoints, come from the matrices alone, last piece first. Then pieces
    pass in order: each is solved again from its checkpoint and walked forward. Every pass is a stream that holds one piece,
    besides the report that it writes; the hash of a conversation can only be taken in order.
    """
    pieces = cut_pieces(turns, conv, turn, role, text, copies, piece_rows, piece_chars)
    known = checkpoints(pieces)
    joined = pieces.drop("matrix").join(known, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q"))).drop("p", "q")
    schema = MESSAGES if messages else REPORT

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                piece = batch.slice(k, 1).to_pylist()[0]
                if now is None or now.out["conv_id"] != piece["conv_id"]:
                    if now is not None and not messages:
                        held.append(now.report())
                    now = Conversation(piece["conv_id"], piece["cost"])
                found = now.add(piece)
                held += found if messages else []
                if len(held) >= 4096:
                    yield _records(held, schema)
                    held = []
        if now is not None and not messages:
            held.append(now.report())
        yield _records(held, schema)

    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(task, schema)
