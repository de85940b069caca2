"""Column helpers for the operators that use DataFrame functions alone.

Arrays are handed to higher-order functions as arguments, never captured inside a lambda: a captured expression
would be evaluated again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def occurrences(text: Column, pattern: str) -> Column:
    """How many characters of a text belong to matches of the pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def shifted(array: Column, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


BLOCK = 128


def running_totals(sizes: Column) -> Column:
    """For each element (long) the sum of all before it.  Blocks keep the cost far below the square of the length."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def blocks(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: let(F.slice(a, s, BLOCK), lambda b: F.struct(b.alias("own"), total(b).alias("sum"))))

    def inner(b: Column) -> Column:  # b: all blocks
        def one(x: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(b, 1, i), F.lit(0).cast("long"), lambda s, y: s + y.sum)
            return let(before, lambda t: F.transform(x.own, lambda _, j: t + total(F.slice(x.own, 1, j))))

        return F.flatten(F.transform(b, one))

    return let(let(sizes, blocks), inner)


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found), in code points, end exclusive.

    ``split`` gives what lies between the matches, so the offsets are running totals of gap and match lengths.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    long = lambda c: F.length(c).cast("long")

    def sized(p: Column) -> Column:
        return F.zip_with(p.found, F.slice(p.gaps, 1, F.size(p.found)), lambda m, g: F.struct(long(g).alias("gap"), long(m).alias("own"), m.alias("found")))

    def placed(f: Column) -> Column:
        before = running_totals(F.transform(f, lambda s: s.gap + s.own))
        return F.zip_with(f, before, lambda s, b: F.struct((b + s.gap).alias("start"), (b + s.gap + s.own).alias("end"), s.found.alias("found")))

    return F.when(text.rlike(pattern), let(let(parts, sized), placed)).otherwise(none)


#: Characters in a block of text; spans are looked up and cut out block by block, so the cost grows with the text, not with spans times text.
TEXT_BLOCK = 1024


def _blocks_of(start: Column, end: Column) -> Column:
    at = lambda c: F.floor(c / TEXT_BLOCK).cast("long")
    return F.sequence(at(start), at(end - 1))


def by_block(found: Column) -> Column:
    """Spans (start, end, ...) as a struct of ``blocks``, the numbers of the blocks of text they touch, and ``groups``: the spans (start, end) of each."""
    pieces = F.array_sort(F.flatten(F.transform(found, lambda s: F.transform(_blocks_of(s.start, s.end), lambda b: F.struct(b.alias("block"), s.start.alias("start"), s.end.alias("end"))))))

    def grouped(p: Column) -> Column:
        def cut(n: Column) -> Column:  # n: the blocks of all pieces, sorted
            first = F.transform(F.array_distinct(n), lambda b: F.array_position(n, b).cast("int"))
            return let(first, lambda f: F.struct(F.array_distinct(n).alias("blocks"), F.zip_with(f, shifted(f, 1), lambda a, z: F.slice(p, a, F.coalesce(z, F.size(p) + 1) - a)).alias("groups")))

        return let(F.transform(p, lambda x: x.block), cut)

    return let(pieces, grouped)


def touched(index: Column, start: Column, end: Column) -> Column:
    """Whether a span of ``by_block`` overlaps start to end."""
    return F.exists(_blocks_of(start, end), lambda b: F.exists(_group(index, b), lambda x: (x.start < end) & (x.end > start)))


def _group(index: Column, block: Column) -> Column:
    none = F.array().cast("array<struct<block:bigint,start:bigint,end:bigint>>")
    return F.coalesce(F.get(index.groups, (F.array_position(index.blocks, block) - 1).cast("int")), none)


def masked(text: Column, found: Column, mask: str) -> Column:
    """``text`` with each span of ``found`` (sorted by start) replaced by the mask; spans that overlap share one."""

    def one(index: Column, block: Column, i: Column) -> Column:
        base = i.cast("long") * TEXT_BLOCK
        part = lambda a, b: F.substring(block, (a - base + 1).cast("int"), (b - a).cast("int"))

        def step(state: Column, s: Column) -> Column:
            low, high = F.greatest(s.start, base), F.least(s.end, base + TEXT_BLOCK)
            new = F.when(low >= state.at, F.concat(state.done, part(state.at, low), F.when(s.start >= base, F.lit(mask)).otherwise(F.lit("")))).otherwise(state.done)
            return F.struct(new.alias("done"), F.greatest(state.at, high).alias("at"))

        start = F.struct(F.lit("").alias("done"), base.alias("at"))
        return F.aggregate(_group(index, i.cast("long")), start, step, lambda s: F.concat(s.done, part(s.at, base + TEXT_BLOCK)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return let(by_block(found), lambda index: F.array_join(F.transform(blocks, lambda b, i: one(index, b, i)), ""))
