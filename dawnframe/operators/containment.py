"""Which texts of a group contain one another, by an inverted index instead of comparing all with all.

If a lies in b then every piece of a lies in b, so it is enough to look b up under one piece of a.  Each text is
indexed under all its pieces of ``SIZE`` characters and looked up under the rarest piece of its own; a text shorter than that is one
piece, and the texts of its group are indexed under pieces of its length too.  What shares a piece is a candidate, and ``contains``
settles it.  Pieces carry ids, not texts, and a piece's frequency is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnframe.durable import written

SIZE = 5


def _pieces(text: Column, sizes: Column) -> Column:
    """The distinct pieces of a text, of each of the sizes."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(text)), of)))


def candidates(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, a, b): ids of ``left`` and ``right`` (group, id, text) that may contain one another.

    Ids are unique within a group and side; empty texts are left out; a null group matches nothing.
    """
    both = left.select(group, F.lit(True).alias("mine"), "id", "text").unionByName(right.select(group, F.lit(False).alias("mine"), "id", "text"))
    both = both.where((F.length("text") > 0) & F.col(group).isNotNull())
    size = F.least(F.length("text"), F.lit(SIZE))
    sizes = both.groupBy(group).agg(F.collect_set(size).alias("sizes"))  # at most SIZE numbers
    pieces = both.join(sizes, group).select(group, "mine", "id", size.alias("size"), F.explode(_pieces(F.col("text"), F.col("sizes"))).alias("piece"))
    # A piece is its hash: two that meet by chance are one more candidate.
    rows = written(pieces.select(group, "mine", "id", (F.length("piece") == F.col("size")).alias("own"), F.xxhash64("piece").alias("piece")), "pieces")
    often = rows.groupBy(group, "piece").agg(F.count("*").alias("often"))
    rare = rows.where("own").join(often, [group, "piece"]).groupBy(group, "mine", "id").agg(F.min(F.struct("often", "piece")).piece.alias("piece"))

    def met(mine: bool) -> DataFrame:
        """Texts of one side under their rarest piece against the other's index."""
        asked = rare.where(F.col("mine") == mine).select(group, "piece", F.col("id").alias("asked"))
        held = rows.where(F.col("mine") != mine).select(group, "piece", F.col("id").alias("held"))
        a, b = ("asked", "held") if mine else ("held", "asked")
        return asked.join(held, [group, "piece"]).select(group, F.col(a).alias("a"), F.col(b).alias("b"))

    return met(True).unionByName(met(False)).distinct()


def pairs(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, a, b) of which one contains the other."""
    mine = left.select(group, F.col("id").alias("a"), F.col("text").alias("_mine"))
    theirs = right.select(group, F.col("id").alias("b"), F.col("text").alias("_theirs"))
    found = candidates(left, right, group).join(mine, [group, "a"]).join(theirs, [group, "b"])
    return found.where(F.col("_mine").contains(F.col("_theirs")) | F.col("_theirs").contains(F.col("_mine"))).select(group, "a", "b")
