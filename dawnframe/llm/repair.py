"""Repair of the structure of conversations by branch-and-bound.

Roles must read system (at most one, first), then user and assistant in turn, ending with the assistant.  Blank turns and
turns whose role and text came before are deleted, truncated ones (no ``.``, ``!`` or ``?`` at the end) cost a penalty if they
stay; keep, rerole, delete and insert have costs, and the cheapest edit sequence wins, the ASCII-least among equals (``repair_search``).

How it runs.  Turns become narrow units (order key, role's initial, fault, digest), equal rows one unit with a count by
a partial aggregate.  What came before is found by the first turn of each (conversation, digest), joined back on
the unit's own key.  Units are dealt to ranges of (conversation, order) and cut into segments of at most ``SEGMENT``; each segment
is searched where it lies: a whole conversation for its end, a part of a longer one for every state it can begin and end in.  So a
conversation may hold any share of all turns and is searched in parallel.  At last segments and texts meet once, hashed by conversation and
sorted: a stream joins the segments' plans, applies the edits and hashes the repaired lines.

A SHA-256 over a whole conversation can't be taken in parts, so the last step reads a conversation's turns in one task.  It
streams them: it holds one Arrow batch, the audit, and about four bytes a turn of that conversation.

Defined results.  Order: turn (nulls first), then role, text (first 32 characters of each), digest.  Null role, text, and null ``conv_id`` or
``turn`` in the damaged key: one space; a null ``conv_id`` is a conversation.  An empty role is a role of another kind.  Equal
rows: the first stands, the others are duplicates (blank ones are blank).  ``gaps`` stays at a long's end if it is greater.  A conversation without rows: zeros,
empty audit, the hash of the empty string.  An empty table: an empty table.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnframe.durable import written
from dawnframe.llm import repair_search as rs
from dawnframe.llm.arrow import pieces

#: Units searched together.
SEGMENT = 64
ORDER = ("turn", "role_head", "text_head", "digest")
LONGEST = (1 << 63) - 1
INSERTED = {2: "user", 3: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the turns after the damage that the checksum of ``conv_id:turn`` says; a dropped turn has no copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), what.alias("what"))
    hurt = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), copies.alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.withColumns({"role_head": F.substring("role", 1, 32), "text_head": F.substring("text", 1, 32), "digest": digest})


def units(rows: DataFrame) -> DataFrame:
    """Distinct turns, narrow: key, ``initial``, ``copies``, ``blank``, ``truncated``, and ``first``: no equal role and text came before."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    open_end = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    facts = _keyed(rows.where("copies > 0")).select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), open_end.alias("truncated"), "copies")
    keys = [c for c in facts.columns if c != "copies"]
    distinct = written(facts.groupBy(*keys).agg(F.sum("copies").alias("copies")), "repair-units")
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("dated"), "turn")).alias("at")
    firsts = distinct.groupBy("conv_id", "digest").agg(earliest).select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), F.col("at.turn").alias("_t"), F.lit(True).alias("first"))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("conv_id", "_c"), ("digest", "_d"), ("turn", "_t"))]
    return distinct.join(firsts, same, "left").select(*distinct.columns, F.coalesce("first", F.lit(False)).alias("first"))


class _Segment:
    """Neighbouring units of one conversation, and what is known of them in the end."""

    def __init__(self):
        self.turns: list[rs.Turn] = []
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.ends = [None, None]  # initials
        self.numbers: list[int | None] = [None, None, 0, None, None]  # least, greatest, distinct, first, last turn number
        self.extra: list[tuple[int, int]] = []

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, first: bool, copies: int) -> None:
        counts, numbers = self.counts, self.numbers
        if blank:
            counts[0] += copies
        else:
            counts[1] += copies - first
            counts[2] += first and truncated
        if self.turns:
            counts[3] += self.ends[1] + initial not in rs.LEGAL
        else:
            self.ends[0], numbers[3] = initial, turn
        counts[3] += copies - 1  # a role beside itself
        if copies > 1:
            self.extra.append((len(self.turns), copies - 1))
        if turn is not None:
            numbers[0] = turn if numbers[0] is None else min(numbers[0], turn)
            numbers[1] = turn if numbers[1] is None else max(numbers[1], turn)
            numbers[2] += not self.turns or numbers[4] != turn
        self.ends[1], numbers[4] = initial, turn
        self.turns.append((initial if initial and initial in "sua" else "o", "x" if blank or not first else "t" if truncated else "."))

    def payload(self, begins: bool, ends: bool) -> str:
        """JSON; a part that isn't known to begin (end) its conversation is searched for every state at that end."""
        least = {"end": list(rs.search(self.turns))} if begins and ends else rs.plans(self.turns, range(1) if begins else range(4))
        return json.dumps({"plans": least, "counts": self.counts, "ends": self.ends, "numbers": self.numbers, "extra": self.extra, "units": len(self.turns)})


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, payload): segments in order of (part, chunk)."""
    found = units(rows)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *ORDER)]
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ["turn", "initial", "blank", "truncated", "first", "copies"]
    key = found.schema["conv_id"]
    schema = T.StructType([T.StructField("conv_id", key.dataType), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("payload", T.StringType())])

    def cut(batches) -> Iterator[pa.RecordBatch]:
        part, at, held, kind = TaskContext.get().partitionId(), ..., _Segment(), None
        chunk, sure = 0, False  # sure: the conversation begins in this part
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ids, chunks, texts = zip(*out, strict=True)
            made = pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, kind), "part": pa.array([part] * len(out), pa.int32()), "chunk": pa.array(chunks, pa.int32()), "payload": pa.array(texts, pa.string())})
            out.clear()
            return made

        for piece in pieces(batches):
            kind = piece.column("conv_id").type
            for conv, *unit in zip(*[piece.column(c).to_pylist() for c in ("conv_id", *columns)], strict=True):
                other = at is not ... and conv != at
                if other or len(held.turns) == SEGMENT:
                    out.append((at, chunk, held.payload(sure and chunk == 0, other)))
                    held, chunk = _Segment(), chunk + 1
                if other:
                    chunk, sure = 0, True
                at = conv
                held.add(*unit)
            if len(out) >= 256:
                yield batch()
        if held.turns:
            out.append((at, chunk, held.payload(sure and chunk == 0, False)))
        if out:
            yield batch()

    return dealt.select("conv_id", *columns).mapInArrow(cut, schema)


class _Plan:
    """The plan of one conversation from its segments, in order."""

    def __init__(self):
        self.cost, self.audit, self.steps = 0, "", ""
        self.counts, self.numbers, self.end = [0, 0, 0, 0], [None, None, 0, None], None
        self.extra: dict[int, int] = {}
        self.units = 0
        self.states = {0: (0, 0)}  # state: (cost, place of the best audit so far among those of the states)
        self.trail: list[dict[int, tuple[int, str]]] = []  # per segment: state -> (state before, audit)
        self.whole: tuple[int, str] | None = None

    def add(self, payload: str) -> None:
        seg = json.loads(payload)
        for i, c in enumerate(seg["counts"]):
            self.counts[i] += c
        low, high, distinct, first, last = seg["numbers"]
        mine = self.numbers
        if low is not None:
            mine[0] = low if mine[0] is None else min(mine[0], low)
            mine[1] = high if mine[1] is None else max(mine[1], high)
            mine[2] += distinct - (self.units > 0 and first is not None and first == mine[3])
        mine[3] = last
        if self.units:
            self.counts[3] += self.end + seg["ends"][0] not in rs.LEGAL
        self.end = seg["ends"][1]
        self.extra |= {self.units + i: n for i, n in seg["extra"]}
        self.units += seg["units"]
        if "end" in seg["plans"]:
            self.whole = tuple(seg["plans"]["end"])
            return
        best: dict[int, tuple] = {}
        for way, (cost, audit) in seg["plans"].items():
            a, b = int(way[0]), int(way[1])
            if a in self.states:
                found = (self.states[a][0] + cost, self.states[a][1], audit, a)
                best[b] = min(best.get(b, found), found)
        self.trail.append({b: (a, audit) for b, (_, _, audit, a) in best.items()})
        places = {b: i for i, (b, _) in enumerate(sorted(best.items(), key=lambda x: x[1][1:3]))}
        self.states = {b: (found[0], places[b]) for b, found in best.items()}

    def close(self) -> None:
        """Settle ``cost``, ``steps`` (an edit for each unit) and ``audit`` (one for each turn)."""
        if self.whole is None:
            cost, _, state = min((c + rs.INSERT * len(rs.TAIL[s]), place, s) for s, (c, place) in self.states.items())
            parts = [rs.TAIL[state]]
            for step in reversed(self.trail):
                state, audit = step[state]
                parts.append(audit)
            self.whole = (cost, "".join(reversed(parts)))
        self.cost, self.steps = self.whole
        self.trail, self.whole = [], None
        self.audit = self.steps
        if self.extra:
            self.cost += rs.DELETE * sum(self.extra.values())
            out, unit = [], 0
            for letter in self.steps:
                out.append(letter)
                if letter != "I":
                    out.append("D" * self.extra.get(unit, 0))
                    unit += 1
            self.audit = "".join(out)

    @property
    def gaps(self) -> int:
        low, high, distinct, _ = self.numbers
        return 0 if low is None else min(high - low + 1 - distinct, LONGEST)


class _Writer:
    """Applies a plan's steps to its units and passes on the repaired lines."""

    def __init__(self, steps: str):
        self.steps, self.at, self.state = steps, 0, 0

    def _inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.steps) and self.steps[self.at] == "I":
            self.state = rs.NEXT[self.state]
            self.at += 1
            yield INSERTED[self.state], ""

    def unit(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserts()
        edit = self.steps[self.at]
        self.at += 1
        if edit == "K":
            self.state = rs.START[self.state][role[0]]
            yield role, text
        elif edit == "R":
            self.state = rs.NEXT[self.state]
            yield INSERTED[self.state], text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserts()
        if self.at != len(self.steps):
            raise ValueError("a conversation's turns changed between two reads of the table")


MARK, PART, ROW = 0, 1, 2


def _streams(rows: DataFrame) -> DataFrame:
    """Marks of all conversations, their segments and their turns, hashed by conversation and sorted."""
    kinds = {"part": "int", "chunk": "int", "payload": "string", "turn": rows.schema["turn"].dataType, "role_head": "string", "text_head": "string", "digest": "binary", "role": "string", "text": "string"}

    def as_kind(frame: DataFrame, kind: int) -> DataFrame:
        others = [F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
        return frame.select("conv_id", F.lit(kind).alias("kind"), *others)

    marks = as_kind(rows.select("conv_id").distinct(), MARK)
    cut = as_kind(written(segments(rows), "repair-segments"), PART)
    texts = as_kind(_keyed(rows.where("copies > 0")), ROW)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "part", "chunk", *ORDER)]
    both = marks.unionByName(cut).unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "kind", "payload", "turn", "digest", "role", "text")


def _repaired(batches) -> Iterator[tuple]:
    """From sorted streams: ("line", conv_id, role, text) for each repaired line, ("end", conv_id, plan) after each conversation."""
    at, plan, writer, last = ..., _Plan(), None, None

    def end():
        nonlocal writer
        if writer is None:
            plan.close()
            writer = _Writer(plan.steps)
        for role, text in writer.rest():
            yield "line", at, role, text
        yield "end", at, plan

    for piece in pieces(batches):
        columns = [piece.column(c).to_pylist() for c in ("conv_id", "kind", "payload", "turn", "digest", "role", "text")]
        for conv, kind, payload, turn, digest, role, text in zip(*columns, strict=True):
            if at is ... or conv != at:
                if at is not ...:
                    yield from end()
                at, plan, writer, last = conv, _Plan(), None, None
            if kind == PART:
                plan.add(payload)
            elif kind == ROW:
                if writer is None:
                    plan.close()
                    writer = _Writer(plan.steps)
                if last != (turn, digest):
                    for line in writer.unit(role, text):
                        yield "line", conv, *line
                last = (turn, digest)
    if at is not ...:
        yield from end()


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, copies): counts of faults, cost, audit and the hash of the repaired lines."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in NUMBERS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        kind = None

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def batch(out):
            ids, *numbers, audits, hashes = zip(*out, strict=True)
            columns = {"conv_id": pa.array(ids, kind)} | {c: pa.array(v, pa.int64()) for c, v in zip(NUMBERS, numbers, strict=True)}
            return pa.RecordBatch.from_pydict(columns | {"audit": pa.array(audits, pa.string()), "repaired_sha256": pa.array(hashes, pa.string())})

        out, digest, lines = [], hashlib.sha256(), 0
        for what, conv, *rest in _repaired(seen()):
            if what == "line":
                digest.update(f"{chr(10) if lines else ''}{rest[0]}:{rest[1]}".encode("utf-8", "surrogatepass"))
                lines += 1
                continue
            plan = rest[0]
            out.append((conv, plan.gaps, *plan.counts, plan.cost, plan.audit, digest.hexdigest()))
            digest, lines = hashlib.sha256(), 0
            if len(out) >= 256:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return _streams(rows).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place from 0, role, text)."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        kind, place, out = None, 0, []

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def batch():
            ids, places, roles, texts = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, kind), "place": pa.array(places, pa.int64()), "role": pa.array(roles, pa.string()), "text": pa.array(texts, pa.string())})

        for what, conv, *rest in _repaired(seen()):
            if what == "end":
                place = 0
                continue
            out.append((conv, place, *rest))
            place += 1
            if len(out) >= 256:
                yield batch()
        if out:
            yield batch()

    return _streams(rows).mapInArrow(run, schema)
