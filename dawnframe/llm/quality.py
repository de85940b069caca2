"""Quality rules under weak supervision, with DataFrame functions alone.

Each rule votes for a text (1), against it (-1) or abstains (0).  Nobody knows how good the rules are: expectation
maximisation over all documents estimates how often each rule objects to good documents and to bad ones, and how
many there are.  Bad documents come in kinds, one for each rule (its kind offends mostly that rule), since one bad
class would take the votes on shouting and on symbols for independent, which they are not.  An abstention says
nothing.  The posterior probability of the good class replaces all-must-pass filtering: a document is kept at
``KEEP`` or more.

One pass over the texts reduces each document to a few numbers and its votes, which are written out.  The EM runs
over the counts of vote patterns (at most 3 to the number of rules, whatever the corpus size, so they fit in the driver) until it
converges, and reads no text.

Base figures of the contract: words ``[^\\x20\\x09-\\x0D]+``; ``word_chars`` code points in words; ``n_symbols``
characters of ``[#*$%&|<>]``; ``n_dup_lines`` lines with a word that equal an earlier one; ``n_repeat_words`` words
in eight-word windows that occur twice or more in the text.  ``base_failed``: under 20 words, or more than 30 % of
the words repeat in windows; such a document is never kept.

A text's words are one array in its task, as long as the text: texts of 100 MB need gigabytes there.

Defined results: a null or blank text has zero words and fails the base rule; repeated rows are judged one by one;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnframe.durable import written
from dawnframe.llm.native import let, occurrences, shifted, words

WINDOW = 8
KEEP = 0.5
#: EM ends when no estimate moves by more than ``TOLERANCE`` in a round; ``ROUNDS`` only guards against a fault.
TOLERANCE, ROUNDS = 1e-9, 1_000_000
#: Where EM starts, and what a prior of the weight of ``PRIOR`` times the corpus holds on to: the share of good
#: documents, how often a rule objects to its own kind of bad document, and how often to any other document.
GOOD, HIT, SLIP, PRIOR = 0.8, 0.9, 0.005, 0.05


def repeated_window_words(windows: Column) -> Column:
    """Words covered by windows that occur at least twice."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    none = F.array().cast("array<int>")
    places = lambda p: F.zip_with(p, shifted(p, 1), lambda a, b: F.when(a.h == b.h, F.array(a["at"], b["at"])).otherwise(none))
    at = F.array_sort(F.array_distinct(F.flatten(let(placed, places))))
    steps = lambda a: F.zip_with(a, shifted(a, 1), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
    return F.aggregate(let(at, steps), F.lit(0).cast("long"), lambda s, x: s + x)


def figures(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base figures and what the rules look at; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    rows = rows.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    further = lambda h, reach: F.zip_with(h, shifted(h, reach), lambda a, b: F.xxhash64(a, b))
    for reach in (1, 2):  # hashes of 2 and 4 words from those of 1 and 2
        rows = rows.withColumn("hashes", further(F.col("hashes"), reach))
    windows = F.slice(further(F.col("hashes"), 4), 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")  # no window repeats unless four of its words do
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    count, none = lambda c: c.cast("long"), F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        count(F.size("words")).alias("n_words"),
        count(F.length(F.array_join("words", ""))).alias("word_chars"),
        count(occurrences(F.col("text"), r"[#*$%&|<>]+")).alias("n_symbols"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when((F.size("words") > WINDOW) & again, let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), repeated_window_words(w)).otherwise(none))).otherwise(none).alias("n_repeat_words"),
        count(F.size("lines")).alias("n_lines"),
        count(occurrences(F.col("text"), r"[A-Z]+")).alias("n_capitals"),
        count(F.length("text") - F.length(F.replace(F.col("text"), F.lit("!"), F.lit("")))).alias("n_shouts"),
        count(F.length("text") - F.length(F.replace(F.col("text"), F.lit("|"), F.lit("")))).alias("n_bars"),
        count(occurrences(F.col("text"), r"[0-9]+")).alias("n_digits"),
        count(occurrences(F.col("text"), r"[.,;:]+")).alias("n_stops"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Rule -> its vote; a document that says too little for a rule gets an abstention."""
    share = lambda part, of="word_chars": F.col(part) / F.greatest(F.col(of), F.lit(1))
    enough = F.col("n_words") >= 50
    length = share("word_chars", "n_words")
    shouts = share("n_shouts", "n_words")
    stops = share("n_stops", "n_words")
    repeats, lines = share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")
    return {
        "symbols": _vote(share("n_symbols") < 0.01, share("n_symbols") > 0.05),
        "table_bars": _vote(share("n_bars", "n_words") == 0, share("n_bars", "n_words") > 0.2),
        "shouting": _vote((share("n_capitals") < 0.1) & (shouts < 0.02), (share("n_capitals") > 0.3) | (shouts > 0.2)),
        "repetition": _vote(enough & (repeats == 0) & (lines == 0), (repeats > 0.3) | (lines > 0.5)),
        "word_length": _vote(length.between(3, 9), (length < 2) | (length > 14)),
        "digits": _vote(share("n_digits") < 0.05, share("n_digits") > 0.25),
        "punctuation": _vote(stops.between(0.02, 0.5), stops > 1.0),
    }


def _posterior(model: dict, votes: Column) -> Column:
    """Posterior of every class.  The model enters as two array constants, so every round runs the same code."""
    k = len(model["objects"][0])
    prior = F.lit([math.log(p) for p in model["share"]])
    terms = F.lit([math.log(x) for row in model["objects"] for p in row for x in (p, 1.0, 1 - p)])
    classes = F.sequence(F.lit(0), F.lit(k))
    fit = F.transform(classes, lambda c: F.get(prior, c) + F.aggregate(F.transform(votes, lambda v, i: F.get(terms, (c * k + i) * 3 + v + 1)), F.lit(0.0), lambda s, x: s + x))
    raised = F.transform(F.array(fit), lambda f: F.transform(f, lambda x: F.exp(x - F.array_max(f))))[0]
    return F.transform(F.array(raised), lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda s, y: s + y)))[0]


def _start(k: int) -> dict:
    return {"share": [GOOD] + [(1 - GOOD) / k] * k, "objects": [[SLIP] * k] + [[HIT if i == c else SLIP for i in range(k)] for c in range(k)]}


def _e_step(model: dict, votes: np.ndarray) -> np.ndarray:
    """Posterior of every class for every pattern."""
    objects = np.array(model["objects"])
    fit = np.log(model["share"]) + (votes < 0) @ np.log(objects).T + (votes > 0) @ np.log(1 - objects).T
    raised = np.exp(fit - fit.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def fit_patterns(votes: np.ndarray, n: np.ndarray, tolerance: float = TOLERANCE) -> dict:
    """EM to convergence over vote patterns (rows of -1, 0, 1) and how many documents have each."""
    k, total = votes.shape[1], float(n.sum())
    start = model = _start(k)
    held = PRIOR * total * np.array(start["share"])
    slips = held[:, None] * np.array(start["objects"])
    for _ in range(ROUNDS if total else 0):
        mass = _e_step(model, votes) * n[:, None]
        against, for_it = mass.T @ (votes < 0), mass.T @ (votes > 0)
        new = {"share": (mass.sum(0) + held) / (total * (1 + PRIOR)), "objects": (against + slips) / (against + for_it + held[:, None])}
        moved = max(np.abs(np.array(new[x]) - np.array(model[x])).max() for x in new)
        model = new
        if moved < tolerance:
            break
    return {x: np.array(model[x]).tolist() for x in model}


def estimate(votes: DataFrame, k: int) -> dict:
    """``share`` of each class, and ``objects``: each class's chance of an objection by rule."""
    patterns = votes.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 to the number of rules
    patterns.sort(key=lambda r: list(r.votes))
    return fit_patterns(np.array([r.votes for r in patterns], float).reshape(-1, k), np.array([r.n for r in patterns], float))


def judge(docs: DataFrame) -> DataFrame:
    """Base figures, ``base_failed``, ``kept``, ``posterior`` and the votes for every row."""
    named = rules()
    facts = written(figures(docs).withColumn("votes", F.array(*named.values())), "quality-votes")
    model = estimate(facts, len(named))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    posterior = _posterior(model, F.col("votes"))[0]
    return facts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (posterior >= KEEP)).alias("kept"), posterior.alias("posterior"),
        *[F.get("votes", F.lit(i)).alias(f"vote_{n}") for i, n in enumerate(named)],
    )
