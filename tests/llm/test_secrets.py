import hashlib
import random
import re
import string
import time

from dawnframe.llm import secrets

ASSIGN = re.compile(secrets.ASSIGN)
SCHEMA = "doc_id long, text string, base int, spans int"


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def digest(found):
    return hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def scan(spark, texts):
    frame = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in secrets.report(frame).collect()}


def test_base_spans_match_brute_force(spark):
    rng = random.Random(5)
    pieces = ["password = 'abcdef'", "secret=token: abcdefgh", "API_KEY:x", "apikey=\"A/b+c=\" ", "AKIA" + "Z9" * 10, "AKIAAKIA12", "deadbeef" * 4, "é ", "\n", "token==abc:def", "word ", "ü" * 5, "0" * 23, "f" * 24]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(150)] + [None, "", "  ", "deadbeef" * 3 + " " + "a1" * 3000, "q7" * 60000, ("0f" * 12 + "x") * 700]
    found = scan(spark, texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)], text
        assert found[i].base_sha256 == digest(want), text


def test_random_tokens_are_found_and_natural_ones_left(spark):
    rng = random.Random(9)
    alphabet = string.ascii_letters + string.digits
    drawn = ["see " + "".join(rng.choice(alphabet) for _ in range(40)) + " here" for _ in range(40)]
    plain = [f"path/to/some_ordinary_directory_name_{i}/with-words-2024" for i in range(40)] + [f"chapter1section{i}paragraphnumbering" for i in range(40)]
    found = scan(spark, drawn + plain)
    assert sum("random" in found[i].spans for i in range(40)) >= 36
    assert sum("random" in found[i].spans for i in range(40, 120)) == 0


def test_keys_without_digits_are_found_and_long_words_left(spark):
    rng = random.Random(10)
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    drawn = [key(string.ascii_letters, 20) for _ in range(40)] + [key(string.ascii_letters, 40) for _ in range(40)]
    drawn += [key(string.ascii_uppercase, 40) for _ in range(40)] + [key(string.ascii_lowercase, 40) for _ in range(40)]
    names = "keitstlichschenverpf internationalization-of-things Donaudampfschifffahrtsgesellschaft getElementsByTagNameAndClassName how-to-make-a-cup-of-tea path/to/some_ordinary_directory"
    plain = f"{names} dichlorodiphenyltrichloroethane pneumonoultramicroscopicsilicovolcanoconiosis auxauxentionmentment SCREAMING_SNAKE_CASE_NAME ------------------------ ======================== aaaaaaaaaaaaaaaaaaaaaaaa 20240131123059000000".split()
    found = scan(spark, [f"see {t} here" for t in drawn + plain])
    for at, least in ((0, 32), (40, 38), (80, 36), (120, 36)):
        assert sum("random" in found[i].spans for i in range(at, at + 40)) >= least, at
    assert [t for i, t in enumerate(plain, 160) if "random" in found[i].spans] == []


def test_recall_by_encoding_and_length(spark):
    """From 24 characters on nine of ten keys of every encoding are found, beside as many natural names."""
    rng = random.Random(11)
    encodings = {
        "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits, "BASE36": string.ascii_uppercase + string.digits,
        "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "letters": string.ascii_letters, "lower": string.ascii_lowercase, "UPPER": string.ascii_uppercase,
    }
    cases = [(name, n) for name in encodings for n in (20, 24, 32, 40) for _ in range(50)]
    drawn = ["".join(rng.choice(encodings[name]) for _ in range(n)) for name, n in cases]
    words = "report table annual market window signal history weather station planet garden northern language reading volume section chapter station journey".split()
    glue = ("-", "_", "/", "")
    plain = [glue[i % 4].join(rng.choice(words) for _ in range(5)) + ("" if i % 3 else f"{glue[i % 4]}{rng.randrange(2030)}") for i in range(900)]
    plain += ["".join(rng.choice(words).capitalize() for _ in range(4)) for _ in range(450)] + ["_".join(rng.choice(words).upper() for _ in range(4)) for _ in range(450)]
    found = scan(spark, [f"see {t} here" for t in drawn + plain])
    hits = {}
    for i, case in enumerate(cases):
        hits[case] = hits.get(case, 0) + ("random" in found[i].spans)
    assert {case: n for case, n in hits.items() if case[1] >= 24 and n < 45} == {}, hits
    assert {case: n for case, n in hits.items() if n < 35} == {}, hits
    assert sum("random" in found[i].spans for i in range(len(drawn), len(drawn + plain))) <= 9


def test_empty_table(spark):
    assert scan(spark, []) == {}


def brute_mask(text, found):
    out, at = "", 0
    for start, _, end in found:
        if start >= at:
            out += text[at:start] + "<SECRET>"
        at = max(at, end)
    return out + text[at:]


def test_masking_matches_brute_force_and_keeps_columns(spark):
    rng = random.Random(31)
    pieces = ["password = 'abcdef'", "secret=token: abcdefgh", "AKIA" + "Z9" * 10, "deadbeef" * 4, "é ", "word ", "ü😀" * 300, "token = " + "0f" * 900 + " ", "\n", "api_key=AKIA" + "Q7" * 12 + " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(80)] + [None, "", "x" * 1024 + "password=abcdefg", "y" * 1020 + "password=abcdefg" + "z" * 3000]
    rows = [(i, t, "a", 1, 2, 3, 4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _token string, base int, spans int, kept int, n_chars long")
    found = secrets.redact(docs)
    assert found.columns == docs.columns
    for r in found.collect():
        text = texts[r.doc_id]
        if text is not None:
            assert r.text == brute_mask(text, brute(text)), text
            assert r.n_chars == len(r.text) and (r._token, r.base, r.spans, r.kept) == ("a", 1, 2, 3)


def test_many_secrets_in_one_text_take_linear_time(spark):
    seconds = []
    for n in (4000, 16000):
        docs = spark.createDataFrame([(1, f"password = hunter2hunter{'x' * 190}\n" * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert secrets.redact(docs).first().text == ("<SECRET>\n") * n
        assert secrets.report(docs).first().n_assign == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 60 and seconds[1] < 8 * seconds[0] + 10
