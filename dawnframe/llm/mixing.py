"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are counted in cells of source, language and topic.  Raking finds a factor for every source, language and
topic, each in turn scaled to its target share until all three marginals hold; a cell gives the share ``BUDGET`` times its
three factors of its tokens, but never more than it has.  A document is then drawn with its cell's probability, decided by a hash
of its id: the draw is the same in every run and on every machine, and expected tokens meet the targets.

Targets: ``shares`` gives a column's target by value; without it, natural shares are flattened by ``TEMPERATURE``
(share to the power, normalised), which lifts rare values and damps common ones, none beyond all its tokens (what a value can't
give is spread over the others).  ``BUDGET`` is the part of all tokens
to draw.  A value that ``shares`` leaves out or gives nothing is not drawn.  Targets that can't hold together (more tokens wanted of a value
than there are, or margins that contradict each other) are met as far as scaling goes; ``margins`` reports target and expected share of every value.

The cells are aggregated before any shuffle; a hot source is a few rows by then.  Up to ``CELLS`` cells are raked in memory;
beyond, each round is a few aggregations over the written table of cells, with the same factors in the end.  Documents meet the
factors (a row for each value, not for each cell), so no text is shuffled unless a margin has over ``CELLS`` values.

Topic: ``topic_of``, any column or expression; without one, the kind of writing (``kind_of_writing``), a fixed number of classes
decided from the layout of the text.

Defined results: a null source, language or topic is a value of its own (``∅``); a document without words counts one
token; null ids are drawn by the hash of null; repeated rows share one decision; an empty table gives an empty table;
further columns are kept by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnframe.durable import written

BUDGET = 0.5
TEMPERATURE = 0.7
#: Raking ends after a round in which no value missed its target by more than this share of the budget when its turn came, or nothing moved any more.
TOLERANCE = 0.0005
#: Rounds at most; convergence is geometric, and far sooner, where targets can be met.
ROUNDS = 2000
#: A factor stays below this: a value whose tokens are all drawn can't give more, however large its factor.
MOST = 1e6
#: Up to so many cells are raked in the driver's memory, and up to so many factors of a margin are broadcast.
CELLS = 100_000
SEED = 20240229
MARGINS = ("source", "lang", "topic")
NONE = "∅"


def kind_of_writing(text: Column) -> Column:
    """The topic where no better one is known: from the share of bars, signs, digits and capitals and from the length of lines."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    part = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / size
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(F.length(text) < 200, "short").when(part(r"[|]+") > 0.02, "table").when(part(r"[#*$%&<>]+") > 0.05, "markup")
        .when(part(r"[A-Z]+") > 0.3, "capitals").when(size / lines < 60, "verse").when(F.length(text) > 8000, "long").otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words of a text, at least one."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.greatest(F.length(blank) - F.length(F.replace(blank, F.lit("x"), F.lit(""))), F.lit(1)).cast("long")


def _topic(topic_of: Column | None) -> Column:
    return kind_of_writing(F.col("text")) if topic_of is None else F.coalesce(topic_of.cast("string"), F.lit(NONE))


def labelled(docs: DataFrame, topic_of: Column | None = None) -> DataFrame:
    """``doc_id``, the three margin columns and ``tokens``."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        _topic(topic_of).alias("topic"),
        tokens(text).alias("tokens"),
    )


def _raised(tokens: np.ndarray) -> np.ndarray:
    return np.maximum(tokens, 0) ** TEMPERATURE


def _flattened(tokens: np.ndarray, budget: float) -> np.ndarray:
    """Flattened shares of a margin's values, none above what its tokens can give of the budget."""
    most = tokens / max(tokens.sum() * budget, 1e-300)
    raised = _raised(tokens.astype(float))
    full = np.zeros(len(tokens), bool)
    while True:
        scale = (1 - most[full].sum()) / max(raised[~full].sum(), 1e-300)
        over = ~full & (scale * raised > most)
        if not over.any():
            return np.where(full, most, np.maximum(scale, 0) * raised)
        full |= over


def _rake_in_memory(cells: list, budget: float, shares: dict) -> dict[str, dict]:
    """Margin -> value -> (factor, target, expected share of the budget)."""
    tokens = np.array([c.tokens for c in cells], float)
    whole = tokens.sum() * budget
    values, codes, wanted, factor = {}, {}, {}, {}
    for m in MARGINS:
        values[m], codes[m] = np.unique([c[m] for c in cells], return_inverse=True)
        given = shares.get(m)
        natural = np.bincount(codes[m], tokens, len(values[m]))
        wanted[m] = np.array([float(given.get(v, 0.0)) for v in values[m].tolist()]) if given else _flattened(natural, budget)
        factor[m] = np.ones(len(values[m]))

    def has(m):
        drawn = np.minimum(tokens, tokens * budget * factor["source"][codes["source"]] * factor["lang"][codes["lang"]] * factor["topic"][codes["topic"]])
        return np.bincount(codes[m], drawn, len(values[m])) / whole

    for _ in range(ROUNDS):
        moved = miss = 0.0
        for m in MARGINS:
            now = has(m)
            by = np.divide(wanted[m], now, out=np.zeros_like(now), where=now > 0)
            new, off = np.minimum(factor[m] * by, MOST), np.abs(now - wanted[m])
            miss, moved = max(miss, float(off.max())), max(moved, float(np.where(new < MOST, off, 0.0).max()))
            factor[m] = new
        if miss < TOLERANCE or moved < TOLERANCE / 100:
            break
    return {m: {v: (float(f), float(w), float(h)) for v, f, w, h in zip(values[m].tolist(), factor[m], wanted[m], has(m), strict=True)} for m in MARGINS}


def _targets(cells: DataFrame, m: str, total: float, budget: float, given: dict | None) -> DataFrame:
    """(value of the margin, target, f = 1.0) for all values that occur."""
    natural = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("n"))
    if given:
        shares = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{m} string, target double")
        return written(natural.join(shares, m, "left").select(m, F.coalesce("target", F.lit(0.0)).alias("target"), F.lit(1.0).alias("f")), f"mix-{m}")
    rows = written(natural.select(m, (F.col("n") / F.lit(total * budget)).alias("most"), F.pow("n", F.lit(TEMPERATURE)).alias("r")), f"mix-{m}")
    scale, full = 0.0, -1
    while True:  # a higher scale fills more values, which leaves more for the others
        over = F.lit(scale) * F.col("r") > F.col("most")
        got = rows.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("most"))).alias("most"), F.sum(F.when(~over, F.col("r"))).alias("r")).first()  # one row
        if got.full == full:
            break
        full, scale = got.full, (1 - (got.most or 0.0)) / (got.r or 1e-300)
    return written(rows.select(m, F.least(F.lit(scale) * F.col("r"), F.col("most")).alias("target"), F.lit(1.0).alias("f")), f"mix-{m}")


def _rake_in_rounds(cells: DataFrame, total: float, budget: float, shares: dict) -> dict[str, DataFrame]:
    """Margin -> (value, f, target, expected), for tables of cells of any size."""
    found = {m: _targets(cells, m, total, budget, shares.get(m)) for m in MARGINS}

    def has(m):
        """What the margin's values give now, beside their targets and factors."""
        rows = cells
        for k in MARGINS:
            rows = rows.join(found[k].select(k, F.col("f").alias(f"f_{k}")), k)
        drawn = F.least(F.col("tokens"), F.col("tokens") * F.lit(budget) * F.col("f_source") * F.col("f_lang") * F.col("f_topic"))
        return found[m].join(rows.groupBy(m).agg((F.sum(drawn) / F.lit(total * budget)).alias("has")), m)

    for _ in range(ROUNDS):
        moved = miss = 0.0
        for m in MARGINS:
            by = F.when(F.col("has") > 0, F.col("target") / F.col("has")).otherwise(0.0)
            next_f = written(has(m).select(m, "target", "has", F.least(F.col("f") * by, F.lit(MOST)).alias("f")), f"mix-{m}")
            off = F.abs(F.col("has") - F.col("target"))
            a, b = next_f.agg(F.max(off), F.max(F.when(F.col("f") < MOST, off))).first()  # one row
            miss, moved = max(miss, a or 0.0), max(moved, b or 0.0)
            found[m] = next_f.select(m, "target", "f")
        if miss < TOLERANCE or moved < TOLERANCE / 100:
            break
    return {m: written(has(m).select(m, "f", "target", F.col("has").alias("expected")), f"mix-{m}") for m in MARGINS}


def rake(rows: DataFrame, budget: float = BUDGET, shares: dict[str, dict[str, float]] | None = None) -> dict[str, DataFrame]:
    """Margin -> (value, ``f``, ``target``, ``expected``) of labelled rows; a row for each value that occurs."""
    spark = rows.sparkSession
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()  # one row
    if n > CELLS:
        return _rake_in_rounds(cells, float(total), budget, shares or {})
    found = _rake_in_memory(cells.collect(), budget, shares or {}) if n else {m: {} for m in MARGINS}  # at most CELLS rows
    return {m: spark.createDataFrame([(v, *x) for v, x in found[m].items()], f"{m} string, f double, target double, expected double") for m in MARGINS}


def uniform(column: str = "doc_id", seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(column)), 11) / F.lit(float(1 << 53))


def _with_chance(rows: DataFrame, factors: dict[str, DataFrame], names: dict[str, str], budget: float, into: str) -> DataFrame:
    """``rows`` with the probability of their cells; ``names`` says which columns hold the margins."""
    for m in MARGINS:
        own = factors[m].select(F.col(m).alias(f"_mix_v_{m}"), F.col("f").alias(f"_mix_f_{m}"))
        own = F.broadcast(own) if own.count() <= CELLS else own
        rows = rows.join(own, F.col(names[m]) == F.col(f"_mix_v_{m}"), "left").drop(f"_mix_v_{m}")
    product = F.lit(budget)
    for m in MARGINS:
        product = product * F.coalesce(f"_mix_f_{m}", F.lit(0.0))
    return rows.withColumn(into, F.least(product, F.lit(1.0))).drop(*[f"_mix_f_{m}" for m in MARGINS])


def plan(docs: DataFrame, budget: float = BUDGET, shares: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None) -> DataFrame:
    """For each document its cell, ``tokens``, ``probability``, and whether it is ``drawn``."""
    rows = written(labelled(docs, topic_of), "mix-documents")
    found = _with_chance(rows, rake(rows, budget, shares), {m: m for m in MARGINS}, budget, "probability")
    return found.select("doc_id", *MARGINS, "tokens", "probability", (uniform() < F.col("probability")).alias("drawn"))


def margins(docs: DataFrame, budget: float = BUDGET, shares: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None) -> DataFrame:
    """(margin, value, target, expected): how well the targets are met, as shares of the budget."""
    found = rake(labelled(docs, topic_of), budget, shares)
    parts = [found[m].select(F.lit(m).alias("margin"), F.col(m).alias("value"), "target", "expected") for m in MARGINS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mixed(docs: DataFrame, budget: float = BUDGET, shares: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None) -> DataFrame:
    """The drawn documents, with the columns of ``docs``, their ``topic`` and ``probability`` (in place of such columns of ``docs``)."""
    factors = rake(labelled(docs, topic_of), budget, shares)
    kept = [c for c in docs.columns if c not in ("topic", "probability")]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")  # so no column of the documents clashes with one of the work
    rows = docs.select(whole, F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), _topic(topic_of).alias("topic"), uniform().alias("u"))
    drawn = _with_chance(rows, factors, {m: m for m in MARGINS}, budget, "probability").where("u < probability")
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in kept], "topic", "probability")
