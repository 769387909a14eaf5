"""Conversation structure repair: the cheapest edits after which roles read (system) (user assistant)+, or nothing is left.

Edits keep a row (0), give it another role (2), delete it (3; blank and repeated rows must go) or insert an empty user or
assistant row (2); a row that stays although it is cut off costs 1. Roles so far are one of four states: nothing, system,
user, assistant. In a state an inserted or renamed row can have one role only, so the letters of the edits, the audit,
say everything; of equally cheap audits the ASCII-least is taken. Insertions belong to the row behind them, so audits of
the same rows never begin one another, and the lesser of two is known from the lesser of their beginnings.

Rows are cut into segments of bounded size, wherever their conversation begins or ends. A segment's costs from each
state to each, with the order of their audits, are a small table; the tables of a conversation chain to the states at its
segments' borders. Within a segment forward and backward cost vectors meet in the middle, the audit-least optimal
crossing is chosen, and both halves are solved alike, so no table of all rows and states is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harborlight.llm.common import look_up
from harborlight.session import written

#: States: nothing so far, system, user, assistant; the initials that lead on; the states that may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What an inserted or renamed row becomes in each state.
ADDED = (USER, USER, ASSISTANT, USER)
NAMES = (None, None, "user", "assistant")
#: Fixed costs.
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
NEVER = 1 << 40
#: Insertions that lead to an end, by state.
CLOSING = (0, 2, 1, 0)

#: Rows of a segment at most.
SEGMENT = 1 << 15

#: A row's code: its role's initial (s, u, a or another) and whether it must go or is cut off.
INITIALS, FAULTS = ("s", "u", "a", "other"), ("", "gone", "cut")


def _steps() -> list[list[list[tuple[int, str, int]]]]:
    """For each code and state, the ways over a row: (cost, letters, state behind)."""
    table = []
    for code in range(len(INITIALS) * len(FAULTS)):
        initial, fault = INITIALS[code // len(FAULTS)], FAULTS[code % len(FAULTS)]
        by_state = []
        for state in range(4):
            ways, here, before = [], state, ""
            for inserted in range(3):  # after two insertions the states begin to repeat
                paid = INSERT * inserted
                ways.append((paid + DELETE, before + "D", here))
                if fault != "gone":
                    stays = paid + CUT * (fault == "cut")
                    ways.append((stays + RENAME, before + "R", ADDED[here]))
                    if initial in NEXT[here]:
                        ways.append((stays, before + "K", NEXT[here][initial]))
                here, before = ADDED[here], before + "I"
            by_state.append(ways)
        table.append(by_state)
    return table


STEPS = _steps()

#: A vector holds (cost, rank) for each state; ranks order the least audits of equal rows up to that state.
Vector = tuple[tuple[int, int], ...]


def entering(state: int) -> Vector:
    return tuple((0, 0) if s == state else (NEVER, 0) for s in range(4))


class Solver:
    """Cost vectors over codes. Vectors are kept relative to their least cost, so few different ones arise and each step is worked out once."""

    def __init__(self) -> None:
        self.ahead: dict[tuple[Vector, int], tuple[int, Vector]] = {}
        self.back: dict[tuple[tuple[int, ...], int], tuple[int, tuple[int, ...]]] = {}

    def _ahead(self, vector: Vector, code: int) -> tuple[int, Vector]:
        found = self.ahead.get((vector, code))
        if found is None:
            ways = [
                (paid + cost, rank, letters, there)
                for state, (paid, rank) in enumerate(vector) if paid < NEVER
                for cost, letters, there in STEPS[code][state]
            ]
            best = {}
            for cost, *audit, there in sorted(ways):
                best.setdefault(there, (cost, tuple(audit)))
            ranks = {audit: i for i, audit in enumerate(sorted(audit for _, audit in best.values()))}
            least = min(cost for cost, _ in best.values())
            found = least, tuple((best[s][0] - least, ranks[best[s][1]]) if s in best else (NEVER, 0) for s in range(4))
            self.ahead[vector, code] = found
        return found

    def _back(self, costs: tuple[int, ...], code: int) -> tuple[int, tuple[int, ...]]:
        found = self.back.get((costs, code))
        if found is None:
            new = [min(min(NEVER, cost + costs[there]) for cost, _, there in STEPS[code][state]) for state in range(4)]
            least = min(new)
            found = least, tuple(c - least if c < NEVER else NEVER for c in new)
            self.back[costs, code] = found
        return found

    def forward(self, codes: bytes, vector: Vector) -> tuple[int, Vector]:
        """A cost that all share, and the vector behind the rows."""
        total = 0
        for code in codes:
            paid, vector = self._ahead(vector, code)
            total += paid
        return total, vector

    def backward(self, codes: bytes, costs: tuple[int, ...]) -> tuple[int, ...]:
        """Costs from each state before the rows to the end behind them, but for one that all share."""
        for code in reversed(codes):
            costs = self._back(costs, code)[1]
        return costs

    def crossing(self, vector: Vector, costs: tuple[int, ...]) -> int:
        """The state in which the audit-least of the cheapest ways crosses."""
        return min((paid + costs[s], rank, s) for s, (paid, rank) in enumerate(vector))[2]

    def edits(self, codes: bytes, state: int, costs: tuple[int, ...]) -> list[str]:
        """The letters over each row, from a state to the cheapest end."""
        out: list[str] = []
        work = [(0, len(codes), state, costs)]
        while work:
            low, high, state, costs = work.pop()
            if high - low == 1:
                out.append(min((cost + costs[there], letters) for cost, letters, there in STEPS[codes[low]][state])[1])
            elif high > low:
                middle = (low + high) // 2
                across = self.crossing(
                    self.forward(codes[low:middle], entering(state))[1], self.backward(codes[middle:high], costs)
                )
                work.append((middle, high, across, costs))
                work.append((low, middle, state, tuple(0 if s == across else NEVER for s in range(4))))
        return out


def chain(vector: Vector, table: list[tuple[int, Vector]]) -> tuple[int, Vector]:
    """The vector behind a segment, of which `table` says the cost and vector from each state."""
    best: dict[int, tuple[int, tuple[int, int]]] = {}
    for state, (paid, rank) in enumerate(vector):
        if paid < NEVER:
            total, behind = table[state]
            for there, (cost, order) in enumerate(behind):
                if cost < NEVER:
                    way = (paid + total + cost, (rank, order))
                    best[there] = min(best.get(there, way), way)
    ranks = {audit: i for i, audit in enumerate(sorted(audit for _, audit in best.values()))}
    least = min(cost for cost, _ in best.values())
    return least, tuple((best[s][0] - least, ranks[best[s][1]]) if s in best else (NEVER, 0) for s in range(4))


# ---------------------------------------------------------------- rows

VISIBLE, ENDED, MARKS = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z", r"[.!?]"


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) of conversations with made faults; null role and text are one space.

    By CRC-32 of `conv_id:turn` (nulls one space) modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence marks,
    3 gives it twice, 4 makes it the user's.
    """
    fault = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(_filled("text"), MARKS, "")).otherwise(_filled("text"))
    return conversations.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(_filled("role")).alias("role"), text.alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _named(rows: DataFrame) -> DataFrame:
    """Rows with a digest of conversation, role and text."""
    known = F.to_json(F.struct("conv_id", "role", "text"), {"ignoreNullFields": "false"})
    return rows.withColumn("key", F.unhex(F.sha2(known, 256)))


def _marked(rows: DataFrame) -> DataFrame:
    """Different rows without their texts: conv_id, turn, role, key, blank, cut, copies, repeats (seen in an earlier turn)."""
    blank = ~F.col("text").rlike(VISIBLE)
    short = rows.select("conv_id", "turn", "role", "key", "copies", blank.alias("blank"), (~blank & ~F.col("text").rlike(ENDED)).alias("cut"))
    short = short.groupBy("conv_id", "turn", "role", "key", "blank", "cut").agg(F.sum("copies").alias("copies"))
    short = written(short, "rows")
    # Nulls are the least turn.
    first = short.groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    found = look_up(short, written(first, "repeated"), "key", "first")
    return found.select(*short.columns, (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("repeats"))


SEGMENTS = (
    "part long, codes binary, keys array<binary>, roles array<string>, turns long, low long, high long, blank long, duplicate long, "
    "truncated long, illegal long, initial string, last string, ends array<long>"
)
SEGMENT_TYPES = [
    ("part", pa.int64()), ("codes", pa.binary()), ("keys", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())),
    *((c, pa.int64()) for c in ("turns", "low", "high", "blank", "duplicate", "truncated", "illegal")),
    ("initial", pa.string()), ("last", pa.string()), ("ends", pa.list_(pa.int64())),
]
LEGAL, LEADING = {"su", "ua", "au"}, {"s", "u", "a"}


class Segment:
    """Rows of one conversation, gathered in order."""

    def __init__(self, conv_id: object):
        self.conv_id, self.codes, self.keys, self.roles = conv_id, bytearray(), [], []
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, key: bytes, blank: bool, cut: bool, repeated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += cut and not repeated
        gone = blank or repeated
        kind = INITIALS.index(initial if initial in LEADING else "other")
        self.codes.append(kind * len(FAULTS) + FAULTS.index("gone" if gone else "cut" if cut else ""))
        if not gone:
            self.keys.append(key)
            self.roles.append(role)

    def row(self, part: int, solver: Solver) -> tuple:
        ends = []
        for state in range(4):
            total, vector = solver.forward(self.codes, entering(state))
            ends += [total, *(x for pair in vector for x in pair)]
        return (
            self.conv_id, part, bytes(self.codes), self.keys, self.roles, self.turns, self.low, self.high, self.blank, self.duplicate,
            self.truncated, self.illegal, self.first, self.last, ends,
        )


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def segments(marked: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Rows in order, packed into segments of at most `size` rows of one conversation, with what each amounts to.

    The order is turn (nulls first), role, digest. Ranges of the order, not whole conversations, go to a task.
    """
    kind, arrow = marked.schema["conv_id"].dataType.simpleString(), _arrow(marked, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, part, open_one, done, held = Solver(), TaskContext.get().partitionId() << 40, None, [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "key", "blank", "cut", "copies", "repeats"))
            for conv_id, turn, role, key, blank, cut, copies, repeats in zip(*columns):
                for copy in range(copies):
                    if open_one is None or open_one.conv_id != conv_id or len(open_one.codes) >= size:
                        if open_one is not None:
                            done.append(open_one.row(part, solver))
                            part, held = part + 1, held + len(open_one.codes)
                        open_one = Segment(conv_id)
                        if held >= size:
                            yield _batch(done, [("conv_id", arrow), *SEGMENT_TYPES])
                            done, held = [], 0
                    open_one.add(turn, role, key, blank, cut, repeats or copy > 0)
        if open_one is not None:
            done.append(open_one.row(part, solver))
        yield _batch(done, [("conv_id", arrow), *SEGMENT_TYPES])

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "key"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, {SEGMENTS}")


STATES = "part long, state int, costs array<long>, trailing int"
TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
BORDER_TYPES = [
    ("part", pa.int64()), ("state", pa.int32()), ("costs", pa.list_(pa.int64())), ("trailing", pa.int32()),
    *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
]


def _conversation(parts: list[dict], solver: Solver) -> Iterator[tuple]:
    """The state before each segment and the costs behind it; the last segment has the conversation's figures, too."""
    tables = [
        [(e[9 * s], tuple((e[9 * s + 1 + 2 * t], e[9 * s + 2 + 2 * t]) for t in range(4))) for s in range(4)] for e in (p["ends"] for p in parts)
    ]
    vector, total, vectors = entering(NOTHING), 0, []
    for table in tables:
        vectors.append(vector)
        paid, vector = chain(vector, table)
        total += paid
    costs = tuple(INSERT * n for n in CLOSING)
    end = solver.crossing(vector, costs)
    total += vector[end][0] + costs[end]
    turns, illegal, high, last = 0, 0, None, None
    for p in parts:
        if p["high"] is not None:
            turns += p["turns"] - (high == p["low"])
            high = p["high"]
        illegal += p["illegal"] + (last is not None and last + p["initial"] not in LEGAL)
        last = p["last"]
    low = next((p["low"] for p in parts if p["low"] is not None), None)
    figures = (0 if low is None else high - low + 1 - turns, *(sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")), illegal, total)
    # From the end back: the state in which the best way enters each segment.
    out, there = [], end
    for k in range(len(parts) - 1, -1, -1):
        closing = costs if k == len(parts) - 1 else tuple(0 if s == there else NEVER for s in range(4))
        ways = [
            (paid + tables[k][s][0] + tables[k][s][1][there][0], rank, s)
            for s, (paid, rank) in enumerate(vectors[k]) if paid < NEVER and tables[k][s][1][there][0] < NEVER
        ]
        state = min(ways)[2]
        out.append((parts[k]["part"], state, list(closing), CLOSING[end] if k == len(parts) - 1 else 0, *(figures if k == len(parts) - 1 else [None] * 6)))
        there = state
    return reversed(out)


def borders(packed: DataFrame) -> DataFrame:
    """For each segment the state before it, the costs of the states behind it, and insertions at the end; and figures of whole conversations."""
    columns = ["conv_id", "part", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "initial", "last", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, parts, done = Solver(), [], []
        for batch in batches:
            for row in batch.to_pylist():
                if parts and parts[0]["conv_id"] != row["conv_id"]:
                    done.extend(_conversation(parts, solver))
                    parts = []
                parts.append(row)
            yield _batch(done, BORDER_TYPES)
            done = []
        if parts:
            done.extend(_conversation(parts, solver))
        yield _batch(done, BORDER_TYPES)

    ordered = packed.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, f"{STATES}, {TOTALS}")


EDITS = "part long, audit string, lines array<struct<place: long, key: binary, role: string, edit: string>>"
LINE = pa.struct([("place", pa.int64()), ("key", pa.binary()), ("role", pa.string()), ("edit", pa.string())])


def solve(packed: DataFrame, known: DataFrame) -> DataFrame:
    """conv_id, part, audit and lines of each segment; a line has its place, edit and role, and its row's digest unless it is inserted."""
    kind, arrow = packed.schema["conv_id"].dataType.simpleString(), _arrow(packed, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, lines, rows = row["state"], [], zip(row["keys"], row["roles"])
                audit = solver.edits(row["codes"], state, tuple(row["costs"]))
                audit += ["I"] * row["trailing"]
                place = 0
                for code, letters in zip(row["codes"] + b"\0" * row["trailing"], audit):
                    for letter in letters:
                        own = next(rows) if letter != "I" and code % len(FAULTS) != FAULTS.index("gone") else (None, None)
                        if letter in "IR":
                            state = ADDED[state]
                        elif letter == "K":
                            state = NEXT[state][own[1][0]]
                        if letter != "D":
                            lines.append({"place": place, "key": own[0], "role": own[1] if letter == "K" else NAMES[state], "edit": letter})
                        place += 1
                out.append((row["conv_id"], row["part"], "".join(audit), lines))
            yield _batch(out, [("conv_id", arrow), ("part", pa.int64()), ("audit", pa.string()), ("lines", pa.list_(LINE))])

    joined = packed.join(known.select(F.col("part").alias("of"), "state", "costs", "trailing"), F.col("part") == F.col("of"))
    joined = joined.select("conv_id", "part", "codes", "keys", "roles", "state", "costs", "trailing")
    return joined.mapInArrow(run, f"conv_id {kind}, {EDITS}")


def repair(conversations: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repaired rows, audits and figures of conversations (conv_id, turn, role, text; `copies` of a row, 1 without that column).

    * rows: conv_id, part, place (their order), role, text, edit (K kept, R another role, I inserted)
    * audits: conv_id, part (their order), audit: one letter for each edit, D for a row that went
    * figures: conv_id, gaps, blank, duplicate, truncated, illegal, cost

    Rows are taken by turn (nulls first), equal turns by role, then by digest of conversation, role and text. Null roles and
    texts are one space; rows without a conv_id are one conversation; repeated rows are duplicates. Empty tables give no
    rows. Long conversations are cut into segments; texts move once, to the rows that stay.
    """
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1).cast("long")
    rows = _named(conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), copies.alias("copies")))
    packed = written(segments(_marked(rows), size), "segments")
    known = written(borders(packed), "borders")
    solved = written(solve(packed, known), "edits")
    lines = solved.select("conv_id", "part", F.explode("lines").alias("line")).select("conv_id", "part", "line.*")
    # A row that stays is the only one of its digest that does.
    texts = rows.where(F.col("text").rlike(VISIBLE)).select(F.col("key").alias("own"), "text").dropDuplicates(["own"])
    stay = lines.where("key is not null").join(texts, F.col("key") == F.col("own")).select("conv_id", "part", "place", "role", "text", "edit")
    inserted = lines.where("key is null").select("conv_id", "part", "place", "role", F.lit("").alias("text"), "edit")
    whole = known.where("cost is not null").select(F.col("part").alias("of"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    figures = solved.select("conv_id", "part").join(whole, F.col("part") == F.col("of")).drop("part", "of")
    return stay.unionByName(inserted), solved.select("conv_id", "part", "audit"), figures


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def digest(conversations: DataFrame, repaired: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """The columns that the registered query returns, one row for each conv_id of the given conversations.

    A conversation's lines are read in order, one after the other, because SHA-256 can't be put together from parts.
    """
    rows, audits, figures = repaired
    kind, arrow = conversations.schema["conv_id"].dataType.simpleString(), _arrow(conversations, "conv_id")

    def lines(df: DataFrame, **given: Column) -> DataFrame:
        kinds = {"part": "long", "place": "long", "audit": "string", "line": "string", **{c: "long" for c in FIGURES}}
        first = {"part": F.lit(-1), "place": F.lit(-1)}
        return df.select("conv_id", *((first | given).get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))

    all_lines = (
        lines(conversations.select("conv_id").distinct())
        .unionByName(lines(figures, **{c: F.col(c) for c in FIGURES}))
        .unionByName(lines(audits, part=F.col("part"), audit=F.col("audit")))
        .unionByName(lines(rows, part=F.col("part"), place=F.col("place"), line=F.concat("role", F.lit(":"), "text")))
    )
    types = [("conv_id", arrow), *((c, pa.int64()) for c in FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv_id, totals, audit, sha, empty, done = False, None, [0] * len(FIGURES), [], hashlib.sha256(), True, []
        for batch in batches:
            for own, letters, text, *numbers in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "line", *FIGURES))):
                if not begun or own != conv_id:
                    if begun:
                        done.append((conv_id, *totals, "".join(audit), sha.hexdigest()))
                    begun, conv_id, totals, audit, sha, empty = True, own, [0] * len(FIGURES), [], hashlib.sha256(), True
                if numbers[0] is not None:
                    totals = numbers
                if letters is not None:
                    audit.append(letters)
                if text is not None:
                    sha.update((text if empty else "\n" + text).encode())
                    empty = False
            yield _batch(done, types)
            done = []
        if begun:
            done.append((conv_id, *totals, "".join(audit), sha.hexdigest()))
        yield _batch(done, types)

    ordered = all_lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    columns = ", ".join(f"{c} long" for c in FIGURES)
    return ordered.mapInArrow(run, f"conv_id {kind}, {columns}, audit string, repaired_sha256 string")
