"""Secret scans by a battery of randomness tests, with DataFrame functions alone.

Base spans (leftmost, non-overlapping per kind; a match that fails its test is dropped without a retry): ``assign``
(a named value of six or more characters), ``access`` (``AKIA`` keys of 20 or more), ``hex`` (24 or more digits).
They always count.  The method adds kind ``random``: runs of 20 or more token characters that look drawn at random.
All of them are tested, with or without digits and letters; of digits alone 24 are ``hex``, and fewer tell too little.

Each candidate's encoding is inferred from its characters (hexadecimal of one case, base 32, base 36, base 64, and letters of one case or
both where no digit stands), which gives its alphabet.  Three tests ask how likely natural text of the same length is to look this random:

- chi-squared uniformity over the alphabet; natural letters are uneven, and the more so the longer they run.  Which letters are frequent counts
  beside how uneven they are: rare letters are as frequent as others in random tokens only;
- runs, in two sequences: digits and letters change places seldom in natural tokens and often in random ones; vowels and consonants change places
  often in words and seldom in random letters.  What a random token does there follows from the shares of digits and vowels in its encoding;
- serial correlation of neighbouring symbols, which is near zero for random tokens.

Their scores are combined by Stouffer's method, each weighted by how far random tokens of that encoding and make lie from natural ones, so a test
that can't tell the two apart there (unevenness of hexadecimal, digits among letters alone) says nothing, and one that speaks for natural text counts against the others.
The false-discovery rate over all candidates of the corpus is held
at ``ALPHA`` by the Benjamini-Hochberg rule with length weights: power grows with length, so a candidate's p-value
is divided by its length over the mean length, at most ``MOST_WEIGHT``.  The rule needs only how many candidates lie
in each of ``BINS`` classes of the p-value, one small aggregation; rounding is to the careful side.

One pass over the texts writes the spans and classes; the threshold is then one number.

Defined results: a null or empty text has no span; offsets are code points, end exclusive; whole texts of any
length are read; a candidate that touches a base span adds nothing; repeated rows are reported one by one and each
counts as a candidate; an empty table gives an empty table; further columns, whatever their names, are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnframe.durable import written
from dawnframe.llm.native import by_block, let, masked, shifted, spans, touched

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

ALPHA = 0.01
BINS, STEP = 1200, 0.05
MOST_WEIGHT = 4.0
#: Sums of squared and cubed letter shares of European prose; how often neighbouring letters and digits, and
#: neighbouring vowels and consonants, change places in names, paths and words; the size of their serial correlation.
SQUARES, CUBES, DIGIT_CHANGES, VOWEL_CHANGES, SERIAL = 0.066, 0.0055, 0.08, 0.60, 0.25
#: Log of a random letter's share over its share in prose (mean of English, German, French and Spanish; 1.2 at most),
#: a to z; the mean over prose, and the spread of one letter, widened since a word's letters depend on each other.
LETTERS = (-0.81, 0.84, 0.16, -0.18, -1.31, 0.98, 0.68, 0.23, -0.59, 1.2, 1.2, -0.17, 0.31, -0.7, -0.49, 0.69, 1.2, -0.57, -0.67, -0.58, -0.07, 1.16, 1.2, 1.2, 1.2, 1.2)
LETTER, LETTER_SPREAD = -0.39, 1.0
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="


def _normal(z: Column) -> Column:
    """P(Z <= z), to about 1e-4 relative in the middle and by the logistic form in the tails; never zero."""
    x = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(-1.5976 * x - 0.070566 * x * x * x))


class Encoding(NamedTuple):
    """What random tokens of an encoding are like."""

    symbols: float
    digit_changes: float  # share of neighbouring letters and digits that change places
    vowel_changes: float  # the same of neighbouring letters
    rarity: float  # mean of ``LETTERS``


def _encoding(symbols: int, letters: str, digits: int, cases: int = 1) -> Encoding:
    own, vowels = cases * len(letters), sum(x in VOWELS for x in letters) / len(letters)
    share = digits / (own + digits)
    return Encoding(float(symbols), 2 * share * (1 - share), 2 * vowels * (1 - vowels), sum(LETTERS[ord(x) - 97] for x in letters) / len(letters))


VOWELS = "aeiouy"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Letters alone of one case and of both, hexadecimal of one case, base 32, base 36, base 64.
ENCODINGS = (_encoding(26, ALPHABET, 0), _encoding(52, ALPHABET, 0, 2), _encoding(16, "abcdef", 10), _encoding(32, ALPHABET, 6), _encoding(36, ALPHABET, 10), _encoding(64, ALPHABET, 10, 2))


def _inferred(token: Column) -> Column:
    """Place of a token's encoding in ``ENCODINGS``, from 1."""
    both = token.rlike("[a-z]") & token.rlike("[A-Z]")
    alone = F.when(both, 2).otherwise(1)
    return F.when(~token.rlike("[0-9]"), alone).when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 3).when(token.rlike("^[A-Z2-7=]+$"), 4).when(both, 6).otherwise(5)


def _classes(token: Column) -> Column:
    """The token with v, c, d, s for each vowel, consonant, digit and other character."""
    kinds = "".join("v" if x.lower() in VOWELS else "c" if x.isalpha() else "d" if x.isdigit() else "s" for x in SYMBOLS)
    return F.translate(token, SYMBOLS, kinds)


def _symbols(token: Column) -> Column:
    """Places of a token's characters in ``SYMBOLS``."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(SYMBOLS), c))


def battery(found: Column) -> Column:
    """(start, end, found) -> (start, end, n, p) with p the combined p-value."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    times = lambda classes, pattern: F.regexp_count(classes, F.lit(pattern)).cast("double")
    one = F.transform(
        found,
        lambda f: F.struct(
            f.start.alias("start"), f.end.alias("end"), F.length(f.found).cast("double").alias("n"), _inferred(f.found).alias("e"), _symbols(f.found).alias("c"), _classes(f.found).alias("w")
        ),
    )

    def tested(f: Column) -> Column:
        counts = F.transform(F.array_distinct(f.c), lambda x: F.size(f.c) - F.size(F.array_remove(f.c, x)))
        pairs = F.zip_with(F.slice(f.c, 1, F.size(f.c) - 1), shifted(f.c, 1), lambda a, b: (a * b).cast("double"))
        rarity = lambda x: F.element_at(F.array(*[F.lit(v) for v in LETTERS]), ((x - 1) % 26 + 1).cast("int"))
        return F.struct(
            f.start.alias("start"), f.end.alias("end"), f.n.alias("n"), f.e.alias("e"),
            total(F.transform(counts, lambda x: x.cast("double") * x)).alias("squares"),
            times(f.w, "[vcd](?=[vcd])").alias("mixed"), times(f.w, "d(?=[vc])|[vc](?=d)").alias("digit_changes"),
            times(f.w, "[vc](?=[vc])").alias("spelt"), times(f.w, "v(?=c)|c(?=v)").alias("vowel_changes"),
            times(f.w, "[vc]").alias("letters"),
            total(F.transform(f.c, lambda x: F.when(x <= 52, rarity(x)).otherwise(0.0))).alias("rare"),
            total(F.transform(f.c, lambda x: x.cast("double"))).alias("s1"),
            total(F.transform(f.c, lambda x: (x * x).cast("double"))).alias("s2"),
            total(pairs).alias("s12"),
        )

    sums = F.transform(one, tested)

    def scored(s: Column) -> Column:
        n = s.n
        of = lambda field: F.element_at(F.array(*[F.lit(getattr(e, field)) for e in ENCODINGS]), s.e)
        k = of("symbols")
        mean = s.s1 / n
        variance = F.greatest(s.s2 / n - mean * mean, F.lit(1e-9))
        chi = k / n * s.squares - n
        natural = k + k * (n - 1) * SQUARES - n
        spread = k * F.sqrt(4 * n * (CUBES - SQUARES * SQUARES) + 2 * SQUARES * SQUARES)
        root = lambda x: F.sqrt(F.greatest(x, F.lit(1.0)))
        within = lambda z, most: F.least(F.greatest(z, F.lit(-most)), F.lit(most))
        turns = lambda found, usual, places: (found - usual * places) / (root(places) * (usual * (1 - usual)) ** 0.5)
        serial = F.abs((s.s12 / (n - 1) - mean * mean) / variance)
        # Each test: how far the token lies from natural ones, and how far random ones of its make do.
        tests = [
            ((natural - chi) / spread, (natural - (k - 1)) / spread),
            ((s.rare - LETTER * s.letters) / (LETTER_SPREAD * root(s.letters)), (of("rarity") - LETTER) * s.letters / (LETTER_SPREAD * root(s.letters))),
            (turns(s.digit_changes, DIGIT_CHANGES, s.mixed), F.when(of("digit_changes") > 0, turns(of("digit_changes") * s.mixed, DIGIT_CHANGES, s.mixed)).otherwise(0.0)),
            (-turns(s.vowel_changes, VOWEL_CHANGES, s.spelt), -turns(of("vowel_changes") * s.spelt, VOWEL_CHANGES, s.spelt)),
            (within((SERIAL - serial) * F.sqrt(n), 1.5), within(SERIAL * F.sqrt(n) - (2 / math.pi) ** 0.5, 1.5)),
        ]
        tests = F.array(*[F.struct(within(z, 12.0).alias("z"), F.greatest(far, F.lit(0.0)).alias("far")) for z, far in tests])
        z = let(tests, lambda t: total(F.transform(t, lambda x: x.z * x.far)) / F.sqrt(total(F.transform(t, lambda x: x.far * x.far)) + 1e-9))
        return F.struct(s.start.alias("start"), s.end.alias("end"), n.alias("n"), _normal(-z).alias("p"))

    return F.transform(sums, scored)


def _marked(found: Column, kind: int) -> Column:
    return F.transform(found, lambda f: F.struct(f.start.alias("start"), f.end.alias("end"), F.lit(kind).alias("kind")))


def scanned(docs: DataFrame, kept: list[str], text: str = "text") -> DataFrame:
    """``kept`` (a struct of these columns), ``base`` (start, end, kind) and ``candidates`` (start, end, n, p)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    own = [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept")] if kept else []
    rows = docs.select(*own, *[spans(whole, p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", CANDIDATE))])
    own = ["kept"] if kept else []
    assign = F.filter("assign", lambda f: F.length(F.regexp_extract(f.found, ASSIGN, 2)) >= 6)
    access = F.filter("access", lambda f: f.end - f.start >= 20)
    base = _sorted(F.concat(_marked(assign, 0), _marked(access, 1), _marked(F.col("hex"), 2)))
    rows = rows.select(*own, base.alias("base"), "token")
    free = let(by_block(F.col("base")), lambda b: F.filter("token", lambda t: ~touched(b, t.start, t.end)))
    return rows.select(*own, "base", battery(F.when(F.size("base") > 0, free).otherwise(F.col("token"))).alias("candidates"))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-60))) / STEP), F.lit(BINS)).cast("int")


def threshold(rows: DataFrame) -> tuple[float, int]:
    """(mean length, least class of p-values that counts as discovery) over all candidates of ``scanned`` rows."""
    each = rows.select(F.explode("candidates").alias("c"))
    mean = each.agg(F.avg("c.n")).first()[0] or 1.0
    classes = each.select(_bin(F.col("c.p") / F.least(F.col("c.n") / mean, F.lit(MOST_WEIGHT))).alias("bin")).groupBy("bin").count().collect()  # at most BINS + 1
    total, above, least = sum(r["count"] for r in classes), 0, BINS + 1
    for r in sorted(classes, key=lambda r: -r["bin"]):
        above += r["count"]
        if 10 ** (-r["bin"] * STEP) <= ALPHA * above / total:
            least = r["bin"]
    return mean, least


def _all_spans(mean: float, least: int) -> Column:
    """Base spans and the discoveries among the candidates, by start and then kind."""
    random = F.filter("candidates", lambda c: _bin(c.p / F.least(c.n / mean, F.lit(MOST_WEIGHT))) >= least)
    return _sorted(F.concat("base", _marked(random, 3)))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: arrays of (start, end, kind), by start and then kind."""
    rows = written(scanned(docs, ["doc_id"], text), "secret-candidates")
    return rows.select("kept.doc_id", "base", _all_spans(*threshold(rows)).alias("spans"))


def redact(docs: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret of ``text`` masked (overlapping spans become one) and ``n_chars`` brought up to date.

    The texts are scanned twice, for the threshold and for the spans, so none of them is shuffled or joined.
    """
    limits = threshold(written(scanned(docs, []).where(F.size("candidates") > 0).select("candidates"), "secret-candidates"))
    rows = scanned(docs, docs.columns).select("kept", _all_spans(*limits).alias("spans"))
    text = F.when(F.size("spans") > 0, masked(F.col("kept.text"), F.col("spans"), mask)).otherwise(F.col("kept.text"))
    rows = rows.select("kept", text.alias("text"))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col("kept").getField(c)).alias(c) for c in docs.columns])


def _sorted(found: Column) -> Column:
    by = F.array_sort(F.transform(found, lambda f: F.struct(f.start.alias("start"), f.kind.alias("kind"), f.end.alias("end"))))
    return F.transform(by, lambda f: F.struct(f.start.alias("start"), f.end.alias("end"), f.kind.alias("kind")))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", F.get(names, f.kind), f.start.cast("string"), f.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    rows = find(docs)
    kinds = F.transform("base", lambda b: b.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
