"""The added secrets, the language model and the toxicity model against plain re-computations."""

import collections
import math
import random
import re
import string

import numpy as np

from dawnframe.llm import langid, secrets, toxicity

CAPS, SMALL, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits


def plain_p(token):
    """The battery's p-value of one token, character by character."""
    n = len(token)
    upper, lower, digit = (any(c in alphabet for c in token) for alphabet in (CAPS, SMALL, DIGITS))
    # symbols, letters, how many digits, cases
    if not digit:
        size, own, digits, cases = (52, SMALL, 0, 2) if upper and lower else (26, SMALL, 0, 1)
    elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        size, own, digits, cases = 16, "abcdef", 10, 1
    elif re.fullmatch("[A-Z2-7=]+", token):
        size, own, digits, cases = 32, SMALL, 6, 1
    else:
        size, own, digits, cases = (64, SMALL, 10, 2) if upper and lower else (36, SMALL, 10, 1)
    vowel = lambda x: x.lower() in "aeiouy"
    at = [secrets.SYMBOLS.index(c) + 1 for c in token]
    letters = [c for c in token if c in CAPS + SMALL]
    neighbours = list(zip(token, token[1:], strict=False))
    spelt = [(a, b) for a, b in neighbours if a in CAPS + SMALL and b in CAPS + SMALL]
    mixed = [(a, b) for a, b in neighbours if a in CAPS + SMALL + DIGITS and b in CAPS + SMALL + DIGITS]
    squares = sum(k * k for k in collections.Counter(token).values())
    s, c = secrets.SQUARES, secrets.CUBES
    pairs = n * (n - 1)
    spread = n * math.sqrt(4 * n * (c - s * s) + 2 * s * s)
    tests = [((n + pairs * s - squares) / spread, pairs * (s - 1 / size) / spread)]
    rarity = lambda x: secrets.LETTERS[SMALL.index(x.lower())]
    root = math.sqrt(max(len(letters), 1)) * secrets.LETTER_SPREAD
    tests.append(((sum(map(rarity, letters)) - secrets.LETTER * len(letters)) / root, len(letters) * (sum(map(rarity, own)) / len(own) - secrets.LETTER) / root))
    share, rate = digits / (len(own) * cases + digits), secrets.DIGIT_CHANGES
    root = math.sqrt(max(len(mixed), 1) * rate * (1 - rate))
    tests.append(((sum((a in DIGITS) != (b in DIGITS) for a, b in mixed) - rate * len(mixed)) / root, len(mixed) * (2 * share * (1 - share) - rate) / root if digits else 0))
    share, rate = sum(map(vowel, own)) / len(own), secrets.VOWEL_CHANGES
    root = math.sqrt(max(len(spelt), 1) * rate * (1 - rate))
    tests.append(((rate * len(spelt) - sum(vowel(a) != vowel(b) for a, b in spelt)) / root, len(spelt) * (rate - 2 * share * (1 - share)) / root))
    mean = sum(at) / n
    variance = max(sum(x * x for x in at) / n - mean * mean, 1e-9)
    serial = abs((sum(a * b for a, b in zip(at, at[1:], strict=False)) / (n - 1) - mean * mean) / variance)
    tests.append((max(-1.5, min(1.5, (secrets.SERIAL - serial) * math.sqrt(n))), min(1.5, secrets.SERIAL * math.sqrt(n) - math.sqrt(2 / math.pi))))
    tests = [(max(-12.0, min(12.0, z)), max(far, 0.0)) for z, far in tests]
    z = max(-12.0, min(12.0, -sum(z * far for z, far in tests) / math.sqrt(sum(far * far for _, far in tests) + 1e-9)))
    return 1 / (1 + math.exp(-1.5976 * z - 0.070566 * z**3))


def test_random_spans_match_a_plain_battery_and_step_up_rule(spark):
    rng = random.Random(41)
    alphabets = [CAPS + SMALL + DIGITS, CAPS + "234567", "0123456789ABCDEF", SMALL, CAPS + SMALL + DIGITS + "+/", "etaoinshrdlu-_", DIGITS]
    token = lambda: "".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randrange(18, 70)))
    texts = [" é ".join(rng.choice([token(), "plain words", "path/to/some_ordinary_directory", "password=abcdefghijklmnopqrstuvwxyz"]) for _ in range(6)) for _ in range(120)] + [None, ""]
    found = []  # (text, start, end, p) of the candidates that touch no base span
    for i, text in enumerate(texts):
        value = text or ""
        base = [m.span() for m in re.finditer(secrets.ASSIGN, value) if len(m[2]) >= 6]
        base += [m.span() for m in re.finditer(secrets.ACCESS, value) if m.end() - m.start() >= 20] + [m.span() for m in re.finditer(secrets.HEX, value)]
        found += [(i, *m.span(), plain_p(m[0])) for m in re.finditer(secrets.CANDIDATE, value) if not any(a < m.end() and m.start() < b for a, b in base)]
    mean = sum(b - a for _, a, b, _ in found) / len(found)
    cell = lambda a, b, p: min(math.floor(-math.log10(max(p / min((b - a) / mean, secrets.MOST_WEIGHT), 1e-60)) / secrets.STEP), secrets.BINS)
    cells = collections.Counter(cell(a, b, p) for _, a, b, p in found)
    limit = min((k for k in cells if 10 ** (-k * secrets.STEP) <= secrets.ALPHA * sum(n for j, n in cells.items() if j >= k) / len(found)), default=secrets.BINS + 1)
    want = {(i, a, b) for i, a, b, p in found if cell(a, b, p) >= limit}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    got = {(i, int(s.split(":")[1]), int(s.split(":")[2])) for i, x in spans.items() for s in x.split(",") if s.startswith("random")}
    assert got == want and 50 < len(want) < len(found)


def test_languages_are_those_of_the_nearest_centroid(spark):
    rng = random.Random(43)
    words = {"aa": "salo mire tuna volo pasti".split(), "bb": "grund stark licht wachs dorf".split(), "cc": "чай лес дом река".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randrange(1, 40))), g) for i, g in enumerate(rng.choice(sorted(words)) for _ in range(240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, text, _ in rows:
        counts = langid.ngram_counts(text)
        padded = " " + text + " "  # as many n-grams as a plain count gives: an n-gram starts at every place that has room for three
        assert counts.sum() == 3 * (len(padded) - 2)
        weighed = [math.sqrt(c) * w for c, w in zip(counts.tolist(), model["idf"].tolist(), strict=True)]
        norm = math.sqrt(math.fsum(x * x for x in weighed))
        cosines = [math.fsum(x * y for x, y in zip(weighed, centre, strict=True) if x) / norm for centre in model["centres"].T.tolist()]
        best = max(range(len(cosines)), key=lambda j: cosines[j])
        assert abs(found[i].score - cosines[best]) < 1e-5
        assert found[i].lang_pred == model["langs"][best] or max(c for c, g in zip(cosines, model["langs"], strict=True) if g == found[i].lang_pred) > cosines[best] - 1e-5


def plain_ftrl(offset, texts):
    """FTRL-proximal over dictionaries, coordinate by coordinate."""
    seen = collections.Counter(b for _, found in texts for b in found)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(b):
        if abs(z[b]) <= toxicity.L1:
            return 0.0
        return -(z[b] - math.copysign(toxicity.L1, z[b])) / ((toxicity.BETA + math.sqrt(n[b])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for label, found in texts:
            used = [b for b in found if seen[b] >= toxicity.LEAST_TEXTS]
            before = {b: weight(b) for b in used}
            share = 1 / (1 + math.exp(-(offset + sum(before.values()))))
            g = (share - label) * (toxicity.TOXIC_WEIGHT if label else 1)
            for b in used:
                rate = (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / toxicity.ALPHA
                z[b] += g - rate * before[b]
                n[b] += g * g
    return {b: weight(b) for b in z if weight(b)}


def test_toxicity_weights_match_plain_ftrl():
    rng = random.Random(47)
    common = [f"word{i}" for i in range(30)]
    texts = []
    for _ in range(300):
        label = int(rng.random() < 0.3)
        words = [rng.choice(common) for _ in range(rng.randrange(3, 12))] + ["vile"] * label
        texts.append((label, toxicity.features(" ".join(words)).tolist()))
    cuts = np.cumsum([0] + [len(f) for _, f in texts])
    found = toxicity.ftrl(-0.8, np.array([y for y, _ in texts]), cuts, np.array([b for _, f in texts for b in f]))
    want = plain_ftrl(-0.8, texts)
    assert found.keys() == want.keys() and len(want) > 1
    assert all(abs(found[b] - want[b]) < 1e-6 for b in want)
    assert toxicity.features("vile")[0] in want
