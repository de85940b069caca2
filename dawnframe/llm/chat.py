"""Chat formatting by cumulative-snapshot collapse, with DataFrame functions alone.

Logs often store a conversation again after every turn.  Each turn gets a rolling hash of the conversation up to
it: the XOR, over the turns so far, of two 64-bit hashes of (position, role, digest of the text), 128 bits in all.  A conversation
whose whole hash is the prefix hash of a longer one is a snapshot of it and is dropped by an anti-join; of equal
conversations the one with the least id stays.  The maximal conversations are rendered turn by turn.

The collapse works on digests: texts are read once to be hashed, where they lie, and shuffled once, for the rendering.
Positions and rolling hashes are running totals, so a conversation may hold any share of all turns: turns are
numbered and hashed inside chunks of ``CHUNK`` turn numbers, the chunks' totals are accumulated (a row for each chunk)
and added back.  A chunk is rendered as one row, ``part`` 0, 1, ... of ``n_parts``, so no group outgrows a task; nearly every
conversation is one part.  Should many turns share their numbers, so that a chunk has over ``PIECE`` turns, it is rendered as
pieces of that many turns, each a part.

A part is bounded by its turns, not by bytes: one whose texts together pass 2 GB, the most a value can hold, fails its task.

A marker inside a text or role is broken by a blank before its last bar (``<|im_end |>``), and line breaks in a role become
blanks, so no turn can pass for another.

Defined results: exact repeats of a turn row count once; turns with the same number are ordered by role and then by the
MD5 of the text; a null turn number stands before all others; a null role or text renders as an empty string and differs from
an empty one; rows without a conversation id form no conversation; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnframe.durable import written

CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS
PIECE = 2000
START, END = "<|im_start|>", "<|im_end|>"
TURN = ["turn", "role", "digest"]


def _hash(seed: int) -> Column:
    null = lambda c: F.col(c).isNull()
    return F.xxhash64(F.lit(seed), "position", null("role"), "role", null("digest"), "digest")


def _placed(turns: DataFrame) -> DataFrame:
    """The turns of conversations with their ``chunk``; a null turn number has one before all others."""
    chunk = F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(-(1 << 62))).cast("long")
    return turns.where(F.col("conv_id").isNotNull()).select("conv_id", chunk.alias("chunk"), "turn", "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))


def chunks(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk): ``size``, the turns ``before`` it, ``n_turns`` of the conversation, its first part and ``n_parts``."""
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("size"))
    own = Window.partitionBy("conv_id")
    upto = own.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = F.ceil(F.col("size") / PIECE)
    return sizes.select(
        "conv_id", "chunk", "size",
        (F.sum("size").over(upto) - F.col("size")).alias("before"), F.sum("size").over(own).alias("n_turns"),
        (F.sum(parts).over(upto) - parts).alias("part"), F.sum(parts).over(own).alias("n_parts"),
    )


def prefixes(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``position`` (from 1) and the rolling hash ``h1``, ``h2`` up to the turn."""
    order = [F.asc_nulls_first(c) for c in TURN]
    inside = Window.partitionBy("conv_id", "chunk").orderBy(*order)
    ranked = rows.withColumn("nth", F.row_number().over(inside))
    hashed = ranked.join(places, ["conv_id", "chunk"]).withColumn("position", F.col("nth") + F.col("before"))
    hashed = hashed.select("conv_id", "chunk", "n_turns", "position", *[_hash(i).alias(f"x{i}") for i in (1, 2)])
    totals = hashed.groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"x{i}").alias(f"t{i}") for i in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = hashed.join(carried, ["conv_id", "chunk"])
    return joined.select("conv_id", "n_turns", "position", *[F.bit_xor(f"x{i}").over(upto).bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal(hashed: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_copies`` of the conversations that no other one contains as a prefix."""
    whole = hashed.where("position = n_turns").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashed.where("position < n_turns").select("position", "h1", "h2").distinct()
    return whole.join(inner, ["position", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def _safe(value: str | Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    for mark in (START, END):
        value = F.replace(value, F.lit(mark), F.lit(mark.replace("|>", " |>")))
    return value


def _joined(turns: Column) -> Column:
    """The text of turns given as an array of (turn, role, digest, text)."""
    line = lambda t: F.concat(F.lit(START), F.regexp_replace(_safe(t.role), r"[\r\n]", " "), F.lit("\n"), _safe(t.text), F.lit(END))
    return F.array_join(F.transform(F.array_sort(turns), line), "\n")


def collapse(turns: DataFrame) -> DataFrame:
    """One row for each part of each maximal conversation: ``conv_id``, ``part``, ``n_parts``, ``n_turns``, ``n_copies``, ``rendered``."""
    texts = _placed(turns)
    rows = written(texts.select("conv_id", "chunk", *TURN).distinct(), "chat-turns")
    places = written(chunks(rows), "chat-chunks")
    kept = maximal(written(prefixes(rows, places), "chat-prefixes"))
    kept = written(kept.join(places, "conv_id").select("conv_id", "chunk", "size", "part", "n_parts", "n_turns", "n_copies"), "chat-kept")
    crowded = kept.where(F.col("size") > PIECE)
    # Texts of dropped conversations are never collected: what stays of them is found before the aggregate.
    ours = texts.join(kept.where(F.col("size") <= PIECE).select("conv_id", "chunk"), ["conv_id", "chunk"], "left_semi")
    plain = ours.groupBy("conv_id", "chunk")
    one = F.collect_set(F.struct(*TURN, "text"))
    columns = ["conv_id", "part", "n_parts", "n_turns", "n_copies"]

    if crowded.isEmpty():
        found = plain.agg(one.alias("t")).join(kept, ["conv_id", "chunk"])
        return found.select(*columns, _joined(F.col("t")).alias("rendered"))
    plain = plain.agg(one.alias("t")).join(kept, ["conv_id", "chunk"])
    inside = Window.partitionBy("conv_id", "chunk").orderBy(*[F.asc_nulls_first(c) for c in TURN])
    piece = F.floor((F.row_number().over(inside) - 1) / PIECE)
    numbered = rows.join(crowded, ["conv_id", "chunk"]).withColumn("part", F.col("part") + piece).select("chunk", *TURN, *columns)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("conv_id", "chunk", *TURN)]
    split = texts.alias("x").join(numbered.alias("n"), same).select(*[f"n.{c}" for c in (*columns, *TURN)], "x.text").groupBy(*columns).agg(one.alias("t"))
    return plain.select(*columns, "t").unionByName(split).select(*columns, _joined(F.col("t")).alias("rendered"))
