"""Cheapest repair of conversations by a dynamic program with checkpoints.

A row of a conversation is kept, given another role or deleted, and empty turns may be inserted anywhere, so that the role
initials read ``(s?(ua)+)?`` at the lowest cost. The state is the place in that pattern. Going backward, a vector holds the
cost of the rest from each state; only every square-rootth vector is stored, and walking forward each block between two of
them is computed again and left by the ASCII-least edits among the tight ones. Vectors repeat up to a constant, so a step is a
lookup of (row kind, vector).

No conversation has to fit into a task. Rows are range-partitioned by conversation and turn. Conversations inside a partition are
finished there; of those that reach a partition's edge each part is stored with its row kinds, one byte each, and with the
costs between the states at both its ends. These 4 x 4 tables, one per part, compose to the vectors between parts; then the
parts of a conversation are walked in order, a block of texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

INF = float("inf")
START, SYSTEM, USER, ASSISTANT = range(4)
#: State behind an initial, by state; -1 where it cannot stand.
AFTER = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: State behind an inserted or re-roled turn, and its role, by state.
GIVEN = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
END = (0, INF, INF, 0)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")
NEEDS_TEXT = (0, 3)  # faults without which, or with which, a row may stay


def kind(initial: str, fault: int) -> int:
    """Row kind: which initial it has (3: none of the pattern's) and its fault."""
    return 4 * "sua".find(initial) + fault if initial in ("s", "u", "a") else 12 + fault


def moves(row: int, state: int) -> list[tuple[str, float, int]]:
    """(letter, cost, next state) of the edits that consume a row of a kind."""
    initial, fault = "sua-"[row // 4], row % 4
    out = [("D", DELETE, state)]
    if fault in NEEDS_TEXT:
        extra = TRUNCATED if fault == 3 else 0
        after = AFTER[initial][state] if initial in AFTER else -1
        if after >= 0:
            out.append(("K", KEEP + extra, after))
        out.append(("R", REROLE + extra, GIVEN[state][0]))
    return out


class Steps:
    """Backward and forward steps, remembered by (row kind, vector up to a constant)."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.back: dict[tuple[int, int], tuple[int, float]] = {}
        self.ahead: dict[tuple[int, int, int], tuple[str, int]] = {}

    def named(self, vector: Sequence[float]) -> tuple[int, float]:
        low = min(vector)
        rest = tuple(v - low for v in vector)
        if rest not in self.number:
            self.number[rest] = len(self.vectors)
            self.vectors.append(rest)
        return self.number[rest], low

    @staticmethod
    def inserted(vector: Sequence[float]) -> list[float]:
        """Costs when up to two turns may be inserted first; more never pay."""
        once = [min(v, INSERT + vector[GIVEN[s][0]]) for s, v in enumerate(vector)]
        return [min(v, INSERT + once[GIVEN[s][0]]) for s, v in enumerate(once)]

    def backward(self, row: int, vector: int) -> tuple[int, float]:
        """The vector in front of a row, and what it adds, from the one behind it."""
        found = self.back.get((row, vector))
        if found is None:
            behind = self.vectors[vector]
            front = [min(c + behind[to] for _, c, to in moves(row, s)) for s in range(4)]
            found = self.back[row, vector] = self.named(self.inserted(front))
        return found

    def forward(self, row: int, vector: int, state: int) -> tuple[str, int]:
        """The ASCII-least tight edits up to and with the row, and the state behind it; ``vector`` is the one behind the row."""
        found = self.ahead.get((row, vector, state))
        if found is None:
            behind = self.vectors[vector]
            front = [min(c + behind[to] for _, c, to in moves(row, s)) for s in range(4)]
            here, letters, at = self.inserted(front), "", state
            while True:
                options = [(x, to) for x, c, to in moves(row, at) if c + behind[to] == here[at]]
                if INSERT + here[GIVEN[at][0]] == here[at]:
                    options.append(("I", GIVEN[at][0]))
                letter, to = min(options)
                letters, at = letters + letter, to
                if letter != "I":
                    break
            found = self.ahead[row, vector, state] = (letters, at)
        return found


#: Only functions and classes of this module may name it: a function that is sent to a worker would take a copy along.
STEPS = Steps()


def tail(state: int) -> str:
    """Edits behind the last row."""
    return {USER: "I", SYSTEM: "II"}.get(state, "")


class Walk:
    """Forward walk over row kinds whose backward vectors are stored at checkpoints alone."""

    def __init__(self, rows: bytes, behind: Sequence[float]):
        self.rows, self.every = rows, max(1, isqrt(len(rows)))
        vector, cost = STEPS.named(behind)
        self.marks = {}
        for i in range(len(rows) - 1, -1, -1):
            if (i + 1) % self.every == 0 or i + 1 == len(rows):
                self.marks[i + 1] = vector
            vector, add = STEPS.backward(rows[i], vector)
            cost += add
        self.cost = cost + STEPS.vectors[vector][START]

    def edits(self, state: int) -> Iterator[tuple[str, int]]:
        """(letters, state behind) of each row."""
        for a in range(0, len(self.rows), self.every):
            b = min(len(self.rows), a + self.every)
            behind = [self.marks[b]]
            for i in range(b - 1, a, -1):
                behind.append(STEPS.backward(self.rows[i], behind[-1])[0])
            for i, vector in zip(range(a, b), reversed(behind)):
                letters, state = STEPS.forward(self.rows[i], vector, state)
                yield letters, state


def part_costs(rows: bytes) -> list[float]:
    """Costs from each state in front of ``rows`` to each behind them, row by row of a 4 x 4 table."""
    columns = []
    for end in range(4):
        vector, cost = STEPS.named([0 if s == end else INF for s in range(4)])
        for row in reversed(rows):
            vector, add = STEPS.backward(row, vector)
            cost += add
        columns.append([cost + v for v in STEPS.vectors[vector]])
    return [columns[end][start] for start in range(4) for end in range(4)]


class Output:
    """Repaired turns as one running hash, and as text where wanted."""

    def __init__(self, texts: bool):
        self.hash, self.state, self.parts, self.some = hashlib.sha256(), START, [] if texts else None, False

    def turn(self, role: str, text: str) -> None:
        line = f"{chr(10) if self.some else ''}{role}:{text}"
        self.some = True
        self.hash.update(line.encode())
        if self.parts is not None:
            self.parts.append(line)

    def apply(self, letters: str, role: str, text: str) -> None:
        """The turns that the edits of one row give."""
        for letter in letters:
            given, name = GIVEN[self.state]
            if letter == "D":
                continue
            if letter == "K":
                self.state = AFTER[role[0]][self.state]
                self.turn(role, text)
            else:
                self.state = given
                self.turn(name, text if letter == "R" else "")

    def text(self) -> str | None:
        return None if self.parts is None else "".join(self.parts)


@dataclass
class Part:
    """Consecutive rows of one conversation."""
    rows: bytearray = field(default_factory=bytearray)
    turns: list = field(default_factory=lambda: [None, None, 0])  # least, largest, how many
    faults: list = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, role: str, fault: int, copies: int) -> None:
        initial = role[:1]
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        later = fault if fault == 1 else 2  # further copies of a row that is not blank are duplicates
        self.rows += bytes([kind(initial, fault)]) + bytes([kind(initial, later)]) * (copies - 1)
        self.faults[fault] += 1
        self.faults[later] += copies - 1
        self.illegal += self.last is not None and (self.last + initial) not in ("su", "ua", "au")
        self.illegal += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        self.first = initial if self.first is None else self.first
        self.last = initial

    def join(self, other: Part) -> None:
        """Counts with those of the part behind this one; the rows are not joined."""
        if other.first is not None:
            self.illegal += other.illegal + (self.last is not None and (self.last + other.first) not in ("su", "ua", "au"))
            self.first = other.first if self.first is None else self.first
            self.last = other.last
            self.faults = [a + b for a, b in zip(self.faults, other.faults)]
        if other.turns[0] is not None:
            same = self.turns[1] == other.turns[0]
            self.turns = [other.turns[0] if self.turns[0] is None else self.turns[0], other.turns[1],
                          self.turns[2] + other.turns[2] - same]

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.turns[0] is None else self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return gaps, *self.faults[1:], self.illegal


RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
          ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
          ("repaired", pa.string())]
RESULT_DDL = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string, repaired string")
PART = [("part", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.float64())),
        ("stats", pa.list_(pa.int64())), ("edges", pa.list_(pa.string())), ("roles", pa.list_(pa.string())),
        ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))]
PART_DDL = ("part long, block long, codes binary, costs array<double>, stats array<long>, edges array<string>, "
            "roles array<string>, texts array<string>, copies array<long>")
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20


def _finished(part: Part, roles: list, texts: list, copies: list, keep: bool) -> tuple:
    """Result columns of a whole conversation."""
    walk, out, letters = Walk(bytes(part.rows), Steps.inserted(END)), Output(keep), []
    edits = walk.edits(START)
    for role, text, n in zip(roles, texts, copies):
        for _ in range(n):
            some, _state = next(edits)
            letters.append(some)
            out.apply(some, role, text)
    end = tail(out.state)
    out.apply(end, "", "")
    return (*part.counts(), int(walk.cost), "".join(letters) + end, out.hash.hexdigest(), out.text())


def _blocks(roles: list, texts: list, copies: list) -> Iterator[tuple[list, list, list]]:
    """The rows of a part in blocks of bounded rows and characters."""
    a, size = 0, 0
    for b in range(len(roles)):
        size += len(roles[b]) + len(texts[b])
        if b + 1 - a >= BLOCK_ROWS or size >= BLOCK_CHARS:
            yield roles[a:b + 1], texts[a:b + 1], copies[a:b + 1]
            a, size = b + 1, 0
    if a < len(roles):
        yield roles[a:], texts[a:], copies[a:]


def _scan(keep: bool):
    """Sorted rows to finished conversations, and to parts of those at the partition's edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        ids, columns, id_type = [], [[] for _ in (*RESULT, *PART)], None

        def emit(conv, result: Sequence | None, part: Sequence | None) -> None:
            ids.append(conv)
            for c, v in zip(columns, [*(result or [None] * len(RESULT)), *(part or [None] * len(PART))]):
                c.append(v)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(ids, id_type), *(pa.array(c, t) for c, (_, t) in zip(columns, [*RESULT, *PART]))]
            out = pa.record_batch(arrays, names=["conv_id", *(n for n, _ in [*RESULT, *PART])])
            ids.clear()
            for c in columns:
                c.clear()
            return out

        def close(edge: bool) -> None:
            if not edge:
                emit(now[0], _finished(part, roles, texts, copies, keep), None)
                return
            edges = [part.first, part.last]
            emit(now[0], None, (number, -1, bytes(part.rows), part_costs(bytes(part.rows)),
                                [*(v or 0 for v in part.turns), *part.faults, part.illegal], edges, None, None, None))
            for n, (r, t, c) in enumerate(_blocks(roles, texts, copies)):
                emit(now[0], None, (number, n, None, None, None, None, r, t, c))

        now, closed, held = None, 0, 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, turn, role, text, n, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        close(closed == 0)
                        closed += 1
                    now, part, roles, texts, copies = [conv], Part(), [], [], []
                if fault is None:  # a row that is gone, here for its conversation's sake
                    continue
                part.add(turn, role, fault, n)
                roles.append(role)
                texts.append(text if fault in NEEDS_TEXT else "")
                copies.append(n)
                held += 40 + len(text)
                if held > 4 << 20 and ids:
                    yield flush()
                    held = 0
        if now is not None:
            close(True)
            yield flush()
    return run


def _between(pdf):
    """Vectors behind each part of one conversation, its total counts and cost: one row per part, at most one part a task."""
    pdf = pdf.sort_values("part")
    vector, vectors = Steps.inserted(END), []
    for costs in reversed(pdf["costs"].tolist()):
        vectors.append(vector)
        vector = [min(costs[4 * s + e] + vector[e] for e in range(4)) for s in range(4)]
    total = Part()
    for stats, edges in zip(pdf["stats"], pdf["edges"]):
        stats = [int(v) for v in stats]
        turns = stats[:3] if stats[2] else [None, None, 0]
        one = Part(turns=turns, faults=stats[3:7], illegal=stats[7], first=edges[0], last=edges[1])
        total.join(one)
    out = pdf[["conv_id", "part"]].copy()
    out["behind"] = list(reversed(vectors))
    out["counts"] = [[*total.counts(), int(vector[START])]] * len(out)
    return out


def _assemble(keep: bool):
    """Parts and blocks in order, each part's first row with the vector behind it, to finished conversations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, letters, edits, counts, id_type = None, None, [], None, None, None

        def close() -> pa.RecordBatch:
            end = tail(out.state)
            out.apply(end, "", "")
            values = [*counts, "".join(letters) + end, out.hash.hexdigest(), out.text()]
            return pa.record_batch([pa.array([now[0]], id_type), *(pa.array([v], t) for v, (_, t) in zip(values, RESULT))],
                                   names=["conv_id", *(n for n, _ in RESULT)])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in range(batch.num_rows):
                conv, codes, behind, total, roles, texts, copies = (c[row].as_py() for c in batch.columns)
                if codes is not None:
                    if now is None or now[0] != conv:
                        if now is not None:
                            yield close()
                        now, out, letters = [conv], Output(keep), []
                    counts = total
                    edits = Walk(codes, behind).edits(out.state)
                    continue
                for role, text, n in zip(roles, texts, copies):
                    for _ in range(n):
                        some, _state = next(edits)
                        letters.append(some)
                        out.apply(some, role, text)
        if now is not None:
            yield close()
    return run


def faulty(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with equal ones joined to one (column copies) and the fault of the first
    of them: 1 blank, 2 duplicate, 3 truncated, 0 none, null for those that are gone."""
    one = rows.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.count(F.lit(1)).alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    digest = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    keyed = one.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k"),
                       F.col("conv_id").isNull().alias("k0"), *digest)
    # The same columns as above, so that both read one shuffle of the texts.
    again = (keyed.groupBy("k", "k0", "h1", "h2", "gone").agg(F.min(when).alias("first"), F.sum("copies").alias("n"))
             .where("n > 1").drop("n"))
    met = keyed.join(again, ["k", "k0", "h1", "h2", "gone"], "left")
    words = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = (F.when(F.col("gone"), F.lit(None).cast("int")).when(words == "", F.lit(1))
             .when(F.col("first").isNotNull() & (when > F.col("first")), F.lit(2))
             .when(~F.substring(words, -1, 1).isin(".", "!", "?"), F.lit(3)).otherwise(F.lit(0)))
    return met.select("conv_id", "turn", "role", "text", F.col("copies"), fault.alias("fault"))


def repair(conversations: DataFrame, texts: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired) of each conversation of
    ``conversations`` (conv_id, turn, role, text, and optionally gone: rows that only name their conversation).

    Rows go by turn, nulls first, then by role and text (first 100 characters, then a hash); equal rows stand together. A null
    role or text is one space. A conversation's fault counts, gaps and illegal neighbours are those of its rows;
    ``repaired`` has its turns after the edits as ``role:text`` lines (null unless ``texts``), of which only a hash is
    taken as they pass otherwise. A conversation without rows gives zeros, no edits and the hash of nothing; a null conv_id is a
    conversation of its own; an empty table gives no rows; other columns are ignored.

    Texts are shuffled two or three times (the third where the repeated texts are too many to broadcast). Equal rows are counted before; a conversation of any length is spread over the partitions by turn,
    and only its edits and its hash, which are one string each, come from one task, that holds a block of texts at a time."""
    spark = conversations.sparkSession
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"))
    order = ["conv_id", "turn", F.substring("role", 1, 100), F.substring("text", 1, 100), F.xxhash64("role", "text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind_of_id = rows.schema["conv_id"].dataType.simpleString()
    placed = faulty(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = durable(placed.mapInArrow(_scan(texts), f"conv_id {kind_of_id}, {RESULT_DDL}, {PART_DDL}"))
    result = ["conv_id", *(name for name, _ in RESULT)]
    whole = found.where("part IS NULL").select(*result)
    parts = found.where("block = -1").select("conv_id", "part", "costs", "stats", "edges")
    between = durable(parts.groupBy("conv_id").applyInPandas(
        _between, f"conv_id {kind_of_id}, part long, behind array<double>, counts array<long>"))
    open_ = found.where("part IS NOT NULL").select("conv_id", "part", "block", "codes", "roles", "texts", "copies")
    met = open_.alias("o").join(between.alias("b"), F.expr("o.conv_id <=> b.conv_id AND o.part = b.part AND o.block = -1"), "left")
    walked = (met.select("o.*", "behind", "counts").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "block")
              .select("conv_id", "codes", "behind", "counts", "roles", "texts", "copies")
              .mapInArrow(_assemble(texts), f"conv_id {kind_of_id}, {RESULT_DDL}"))
    return whole.unionByName(walked)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 marks a row as
    gone, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 gives it the role user. Nulls are read as one
    space, but stay nulls as conv_id and turn."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), way.alias("way"))
    text = (F.when(F.col("way").isin(0, 1), "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("way") == 0, "").when(F.col("way") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"),
                       F.explode(copies).alias("copy")).drop("copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The contract's columns of the damaged conversations."""
    return repair(damage(conversations), texts=False).drop("repaired")
