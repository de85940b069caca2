import numpy as np
import xxhash

from dawnframe.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int")
    return sorted((tuple(r) for r in simhash.near_duplicates(frame).collect()), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [" ".join(rng.choice([f"w{i}" for i in range(90)], 80)) for _ in range(12)]
    rows = []
    for n, text in enumerate(base):
        for copy in range(14):
            words = text.split()
            for _ in range(copy % 4):
                words[rng.integers(len(words))] = f"x{rng.integers(50)}"
            rows.append((n * 20 + copy, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "a b"), (905, "a b"), (None, "a b"), (906, "é ü " * 3000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_every_pair_within_three_bits_meets_at_an_anchor():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for bit in rng.choice(64, 3, replace=False):
            y ^= 1 << int(bit)
        met = False
        for shift in (32, 0):
            a, b = (set(simhash.anchors_of(np.array([v >> shift & 0xFFFFFFFF], np.int64))[1].tolist()) for v in (x, y))
            assert all((n ^ (x >> shift & 0xFFFFFFFF)).bit_count() <= 2 for n in a) and len(a) <= 17
            met |= bool(a & b)
        assert met


def test_one_of_each_component_stays(spark):
    frame = spark.createDataFrame([(3, "a b c d e", "en", "s", 9), (1, "A b c d e", "en", "s", 9), (1, "A b c d e", "en", "s", 9), (7, "z y x w v u t", "en", "s", 13), (None, "z y x w v u t", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, (r.doc_id for r in simhash.keep_one_of_each(frame).collect()))) == ["1", "7", "None"]


def test_an_id_of_several_documents_loses_only_the_copies(spark):
    """Id 5 names a copy of id 3 and a text of its own; ids 9 and 9 are two kept-print rows of one component."""
    rows = [(3, "a b c d e"), (5, "a b c d e"), (5, "z y x w v u t"), (5, "z y x w v u t"), (9, "k l m n o p"), (9, "K l m n o p"), (9, None), (None, "a b c d e")]
    frame = spark.createDataFrame([(i, t, "x", 7, 1, "n") for i, t in rows], "doc_id long, text string, fingerprint string, n int, print int, component_id string")
    kept = simhash.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    found = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert [f for f in found if f[0] != 9] == [(3, "a b c d e"), (5, "z y x w v u t"), (None, "a b c d e")]
    assert [f[0] for f in found if f[0] == 9] == [9]
    assert simhash.keep_one_of_each(frame.limit(0)).count() == 0


def test_crowded_anchors_keep_all_components(monkeypatch):
    """Many fingerprints that share a half, some of them within three bits of each other in the rest."""
    monkeypatch.setattr(simhash, "CROWDED", 64)
    rng = np.random.default_rng(8)
    for shift, side in ((0, 0), (32, 1)):
        far = rng.integers(0, 1 << 32, 600)
        near = far[:200] ^ (1 << rng.integers(0, 32, 200)) ^ (1 << rng.integers(0, 32, 200)) ^ (1 << rng.integers(0, 32, 200))
        values = np.unique(np.concatenate([far, near])).astype(np.int64) << shift
        a, b = simhash._links(np.full(len(values), 5 | side << 32), values, 3)
        assert (np.bitwise_count(a ^ b) <= 3).all()
        assert max(len(p) for p in simhash._split(values, 5 | side << 32)) < 64

        def roots(pairs, values=values):
            root = {int(v): int(v) for v in values}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in pairs:
                root[find(int(x))] = find(int(y))
            groups = {}
            for v in root:
                groups.setdefault(find(v), set()).add(v)
            return {frozenset(g) for g in groups.values()}

        every = [(x, y) for i, x in enumerate(values) for y in values[:i][np.bitwise_count(values[:i] ^ x) <= 3]]
        assert roots(zip(a, b, strict=True)) == roots(every)
