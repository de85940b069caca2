"""Quality, personal data, language, toxicity, decontamination and page text against brute force and on odd input."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from dawnframe.llm import decontaminate, html, langid, pii, quality, toxicity

LONG = "lorem ipsum dolor sit amet " * 8000
ODD = [None, "", " \n\t ", "x", "é" * 50, LONG, "a b c d e f g h " * 6, "a b c d e f g h " * 6]


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or ""), 9, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words int, votes string")


def blank_split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_quality(t):
    t = t or ""
    w = blank_split(t)
    lines = [x for x in t.split("\n") if blank_split(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]


def test_quality_figures_match_brute_force(spark):
    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(60):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 40]))] + ["#x|", "\n", "same line\n", "ü<>"]
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(120))))
    for r in quality.judge(frame(spark, texts)).collect():
        want = brute_quality(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_prose_and_drops_junk(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "nrsl"]
    prose = [". ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() for _ in range(8)) for _ in range(160)]
    junk = [" ".join(rng.choice(words) + rng.choice(["###", "$$$", "&&&"]) for _ in range(90)) for _ in range(20)]
    shout = ["!! ".join(rng.choice(words).upper() for _ in range(90)) for _ in range(20)]
    kept = {r.doc_id: r.kept for r in quality.judge(frame(spark, prose + junk + shout)).collect()}
    assert sum(kept[i] for i in range(160)) >= 158
    assert sum(kept[i] for i in range(160, 200)) == 0


def test_quality_of_an_empty_table(spark):
    assert quality.judge(frame(spark, [])).count() == 0


def brute_pii(text):
    text = text or ""
    out = []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data_matches_brute_force(spark):
    rng = random.Random(3)
    pieces = ["a.b+c@x-y.co.uk", "@", "a@b", "x@y.z@q.r", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "5500-0000-0000-0004", "1234567890123456", "+1 (555) 010-9999", "+49 30 1234", "+1 2 3", "é", " ", ".", "-", "007.8.9.10", "word", "\n", "+", "12"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(400)] + ODD + ["9" * 20000, "a" * 20000 + "@", "1." * 5000]
    for r in pii.report(frame(spark, texts)).collect():
        want = brute_pii(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE] == [f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want]


def test_checksums_and_context_decide_on_more_kinds():
    kinds = lambda t: [k for _, _, k in pii.find(t)[1]]
    assert kinds("GB82 WEST 1234 5698 7654 32") == ["iban"]
    assert kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("DE89 3704 0044 0532 0130 00 AND MORE") == kinds("DE89370400440532013000 12") == ["iban"]
    assert kinds("GB82WEST12345698765432X") == kinds("DE8937040044053201300") == []
    assert pii.find("to NO93 8601 1117 947 or DE89370400440532013000, now")[1] == [(3, 21, "iban"), (25, 47, "iban")]
    assert kinds("my ssn is 123-45-6789") == ["national_id"]
    assert kinds("part 123-45-6789") == []
    assert kinds("call 030 1234 5678") == ["local_phone"]
    assert kinds("rows 030 1234 5678") == []


def test_redaction(spark):
    row = pii.redact(frame(spark, ["mail a@b.co now", None])).orderBy("doc_id").collect()
    assert (row[0].text, row[1].text) == ("mail <EMAIL> now", None)


def languages(rng, n):
    sounds = {"aa": ("th", "en", "ing", "ou"), "bb": ("sch", "ung", "ei", "ö"), "cc": ("eau", "ou", "é", "tion")}
    return [(i, lang, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(60))) for i, lang in enumerate(rng.choices(list(sounds), k=n))]


def test_language_is_learned_and_odd_texts_are_unknown(spark):
    made = languages(random.Random(4), 300)
    rows = [(i, t, g, "s", 0, "clash") for i, g, t in made] + [(1000 + i, t, None, "s", 0, "clash") for i, t in enumerate([None, "", "123 !!", "½ ² ①② Ⅷ", "\u0301 \u093f"])] + [(2000, "thing ouen " * 9000, None, "s", 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [(i, g) for i, g, _ in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and all(found[i].held_out and found[i].lang_pred == g for i, g in held)
    assert all((found[1000 + i].lang_pred, found[1000 + i].score) == ("und", 0.0) for i in range(5))
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs, model).collect()}
    assert kept == {i: g for i, g, _ in made} | {2000: "aa"}


def test_words_keep_their_vowel_signs():
    plain = lambda t: "".join(map(chr, langid._plain(t)))
    assert plain("Héllo,  wörld 42!") == " héllo wörld "
    assert plain("हिन्दी में") == " हिन्दी में "
    assert langid._plain("12 ½") is None


def test_texts_of_unlearned_languages_are_rejected_at_every_length(spark):
    rng = random.Random(14)
    sounds = {"aa": ("th", "en", "ing", "ou", "er", "a"), "bb": ("sch", "ung", "ei", "ö", "zu", "e")}
    made = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    learned = [(i, made(sounds[g], n), g) for i, (g, n) in enumerate((g, n) for g in sounds for n in [2, 8, 30, 60, 100, 300] * 25)]
    again = [(i + 1000, made(sounds[g], n), None) for i, (g, n) in enumerate((g, n) for g in sounds for n in (2, 20, 60, 250, 3000))]
    foreign = ["".join(map(chr, range(97, 123))), ["który", "się", "być", "przez", "jak", "tylko", "książka", "wszystko"], ["м", "д", "ы", "п", "ю", "жк"], ["的", "是", "不", "了", "在", "人"]]
    other = [(i + 2000, made(parts, n), None) for i, (parts, n) in enumerate((p, n) for p in foreign for n in (1, 2, 5, 20, 200, 1000, 5000))] + [(3000, "ж", None), (3001, "中", None)]
    docs = spark.createDataFrame(learned + again + other, "doc_id long, text string, lang string")
    found = {r.doc_id: r.rejected for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert sum(found[i] for i, _, _ in learned) <= 3
    assert not any(found[i] for i, _, _ in again)
    assert [i for i, _, _ in other if not found[i]] == []


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs)).first().lang_pred == "und"
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0


def test_toxicity_learns_words_and_scores_odd_texts(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "er", "il", "os")]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(50)]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            text[rng.randrange(50)] = rng.choice(["vile", "scummy", "moronic"])
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t, "toxic") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (902, LONG, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= found[i].score < 0.5 and found[i].predicted == 0 for i in (900, 901, 902))
    assert toxicity.score(docs, {}).where("predicted = 1").count() == 0


def test_toxicity_blocks_keep_pairs_across_the_cut(monkeypatch):
    text = " ".join(f"word{i}" for i in range(400))
    whole = set(toxicity.features(text).tolist())
    monkeypatch.setattr(toxicity, "BLOCK", 257)
    assert set(toxicity.features(text).tolist()) == whole


def brute_leaks(docs, items):
    found = set()
    for d, text in docs:
        w = decontaminate.words_of(text)
        for i, item in items:
            v = decontaminate.words_of(item)
            if not v or not w:
                continue
            k = min(5, len(v))
            own = collections.Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                part = w[s : s + len(v)]
                seen = collections.Counter(tuple(part[j : j + k]) for j in range(len(part) - k + 1))
                common = sum((seen & own).values())
                if common and common / (seen.total() + own.total() - common) >= 0.8:
                    found.add((d, i))
                    break
    return found


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 20, 45])))) for i in range(25)] + [(90, ""), (91, None), (92, "Solo")]
    docs = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 150))]
        if d % 2:
            item = rng.choice(items[:25])[1].upper().split()
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, ""), (502, items[3][1]), (503, LONG + items[4][1] + ", " + items[5][1]), (504, "it is solo!")]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 20
    for size in (decontaminate.BLOCK_CHARS, 400):  # in one block, and in several
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(table, bench, size).collect()} == want
    kept = {r.doc_id for r in decontaminate.keep_uncontaminated(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contaminations(table, bench.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<div><a href=x>link only</a></div>", ""),
        ("<p>one<p>two <b>bold</b>er", "one two bolder"),
        ("<article><h1>T</h1><p>a<br>b&nbsp;c\n d</p></article><footer>f</footer>", "T a b c d"),
        ("<body><nav>menu, menu</nav><div class='content'><p>Text, with commas, and length enough to count as text.</p><div class='ad-slot'>buy, now</div><form>q</form></div><div id=sidebar>side, side, side</div><section class='comments'><p>I like it, really, so much, yes.</p></section>", "Text, with commas, and length enough to count as text."),
        ("<main><section><p>First, a section that is long enough to be kept.</p></section><section><p>Second, a section that is long enough too.</p></section></main>", "First, a section that is long enough to be kept. Second, a section that is long enough too."),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<p>x</p><script>if (a < b) { document.write('<p>no</p>') }</script><style>p{}</style><!-- <p>no</p> --><p>y</p>", "x y"),
        ("<a title=\"x>text</a> more", "text more"),
        ("<div" * 2000, ""),
    ],
)
def test_page_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("super<wbr>cali", "supercali"),
        ("word<img src=x>.", "word."),
        ("word<script>x()</script>, more", "word, more"),
        ("word<svg><path d='x'/><title>t</title></svg>, more", "word, more"),
        ("word<button>press</button>, more", "word, more"),
        ("E=<math><mi>m</mi><mo>c</mo></math>.", "E=mc."),
        ("a<o:p>b</o:p>c", "abc"),
        ("a<br>b", "a b"),
        ("one<hr>two", "one two"),
        ("a <x-name>b</x-name> c", "a b c"),
        ("x<select><option>1<option>2</select>y", "x y"),
        ("a<picture><source srcset=x><img src=y></picture>b", "ab"),
    ],
)
def test_what_stands_within_a_line_leaves_no_space(inner, want):
    text = "A paragraph, with commas, and length enough to count as the article's text."
    assert html.main_text(f"<article><p>{text}</p><p>{inner}</p><p>{text}</p></article>") == f"{text} {want} {text}"


def test_a_comment_without_an_end_hides_the_rest():
    assert html.main_text("<p>shown</p><!-- a > b") == "shown"


LONG_P, SHORT_P = "a, b, c, d, e, " + "word " * 57, "Short one."


@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_unequal_parts_of_an_article_are_kept(outer):
    section = lambda n: "<section>" + f"<p>{LONG_P}</p>" * n + "</section>"
    links = "<ul>" + "<li><a href=x>elsewhere</a></li>" * 5 + "</ul>"
    page = f"<body><nav>menu</nav><{outer}><h1>Title</h1>{section(12)}{links}{section(2)}<h2>Head</h2><p>{SHORT_P}</p><section><p>Last.</p></section></{outer}><footer>foot</footer></body>"
    assert html.main_text(page).split() == f"Title {LONG_P * 14} Head {SHORT_P} Last.".split()


def test_parts_beside_the_article_without_a_common_container():
    column = lambda n: "<div><div>" + f"<p>{LONG_P}</p>" * n + "</div></div>"
    page = f"<body><h1>Title</h1>{column(12)}<div><a href=x>linked</a> <a href=y>elsewhere</a></div>{column(1)}<p>{SHORT_P}</p>loose</body>"
    assert html.main_text(page).split() == f"Title {LONG_P * 13} {SHORT_P} loose".split()


def test_pages_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (2, None, None, 5)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.extract(rows).collect()) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]


@pytest.mark.parametrize(
    "names",
    [
        'class="content has-sidebar"', 'class="main-content no-sidebar"', 'class="page right-sidebar"', 'class="content hidden-xs"', 'class="post with-comments"',
        'class="entry-content social-post"', 'id="legal-guide" class="article"', 'class="layout-no-sidebar"', 'class="sidebar"', 'class="social widget"',
    ],
)
def test_names_alone_never_empty_a_page(names):
    """Names of layout aren't furniture, a good name beats a bad one, and a bad one can't take most of the page."""
    assert html.main_text(f"<body><nav>menu</nav><div {names}><p>{LONG_P}</p><p>{LONG_P}</p></div><footer>f</footer></body>").split() == f"{LONG_P} {LONG_P}".split()


@pytest.mark.parametrize("names", ["site-footer", "ad-slot", "cookieNotice", "nav-primary", "related-posts", "social-share", "widget", "comment-list", "sidebar left", "has-icon newsletter"])
@pytest.mark.parametrize("outer", ["<article>{}</article>{}", "<div class=content>{}</div>{}", "<div>{}</div>{}", "<article>{}{}</article>"])
def test_furniture_goes_by_name(names, outer):
    long, furniture = f"<p>{LONG_P}</p>" * 3, f'<div class="{names}"><p>{LONG_P}</p></div>'
    assert html.main_text("<body>" + outer.format(long, furniture) + "</body>").split() == LONG_P.split() * 3


def test_comments_stay_out_however_many():
    page = f"<body><div><p>{LONG_P}</p></div><div class=comments>" + f"<article class=comment><p>{LONG_P}</p></article>" * 9 + "</div></body>"
    assert html.main_text(page).split() == LONG_P.split()
    assert html.main_text(f"<div class=comments><p>{LONG_P}</p></div>") == ""


def test_letters_that_change_length_in_lower_case_move_nothing():
    assert html.main_text("<p>" + "İ" * 40 + "</p><script>no</SCRIPT ><p>yes</p>") == "İ" * 40 + " yes"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p><script src=x />var code</script><p>b</p>", "a b"),
        ("<p>a</p><iframe src=x /><p>b</p><script/><p>c</p><script>no</script>", "a b c"),
        ("<p>a <span class=ad>buy</span><b hidden>x</b> b</p>", "a b"),
        ("<a href=x><div>link</a> words, of the text, that follow</div>", "link words, of the text, that follow"),
        ("<table><tr><td>a<tr><td>b<td>c</table>", "a b c"),
    ],
)
def test_broken_markup(page, want):
    assert html.main_text(page) == want


def test_deep_pages_take_linear_time():
    for page in ("<div>x" * 30000, "<div>" * 30000 + "x" + "</b>" * 30000, "<span>" * 30000 + "<div>x</div>" * 30000, "<title/>" * 30000 + "<p>x", "<div class=ad>" * 30000 + "x"):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 5


def plain_scores(tree):
    """Points of every container by the rule itself, on nested (tag, children or text) tuples; tag -> points, for trees with a tag a node."""
    found = collections.Counter()

    def walk(node, above):
        tag, below = node
        if isinstance(below, str):
            points = len(below) / 100 if len(below) < 25 else 1 + below.count(",") + min(len(below) // 100, 3) + len(below) / 1000
            for up, share in zip(reversed(above), (1, 0.5, 0.2, 0.1), strict=False):
                found[up] += points * share
        else:
            for b in below:
                walk(b, [*above, tag])

    walk(tree, ["#"])
    return found


def test_scores_match_the_rule():
    rng = random.Random(21)
    for _ in range(100):
        names = (f"x{i}" for i in range(1000))

        def made(depth):
            if depth > 4 or rng.random() < 0.3:
                return "p", " ".join(rng.choice(["word", "word,", "longerword"]) for _ in range(rng.randrange(1, 60)))
            return next(names), [made(depth + 1) for _ in range(rng.randrange(1, 4))]

        tree = (next(names), [made(1), made(1)])
        show = lambda n: f"<{n[0]}>" + (n[1] if isinstance(n[1], str) else "".join(map(show, n[1]))) + f"</{n[0]}>"  # noqa: B023, E731
        nodes, parts = html._read(show(tree))
        html._score(nodes, parts)
        want = plain_scores(tree)
        for n in nodes:
            if n.tag != "p":
                assert abs(n.score - want[n.tag]) < 1e-9
                assert n.size == sum(len(" ".join(t.split())) for b, t, _, _ in (x for x in parts if x) if n.depth == 0 or _under(b, n))


def _under(node, top):
    while node is not None and node is not top:
        node = node.up
    return node is top


def test_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_containers_that_score_the_same_give_the_first():
    part = f"<p>{LONG_P}</p>"
    page = f"<body><td><section>{part}</section></td><td><section>{part.replace('word', 'other')}</section></td></body>"
    assert html.main_text(page).split()[: len(LONG_P.split())] == LONG_P.split()


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>{p}</p><h2>Sources</h2><ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul></article>", "{p} Sources one two three"),
        ("<article><p>{p}</p><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div></article>", "{p} one two three"),
        ("<article><p>{p}</p><h2>Sources</h2><div><ul>" + "<li><a href=1>one</a></li>" * 9 + "</ul></div></article>", "{p} Sources" + " one" * 9),
        ("<article><p>{p}</p><ul>" + "<li><a href=1>one</a></li>" * 9 + "</ul></article>", "{p}"),
        ("<main><p>{p}</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul></main>", "{p}"),
        ("<article><p>{p}</p></article><ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul>", "{p}"),
        ("<article><p>{p}</p><p class=social>{p}</p></article>", "{p} {p}"),
        ("<article><p>{p}</p><p class=social>Follow us here</p></article>", "{p}"),
        ("<article><p>{p}</p><p class=related>See also the pages of <a href=1>{p}</a></p></article>", "{p}"),
        ("<article><p>{p}</p></article><p class=social>{p}</p>", "{p}"),
        ("<article><p>{p}</p><p class=disclaimer>{p}</p><p class='social disclaimer'>{p}</p></article>", "{p}"),
        ("<main><p>{p}</p><section class=legal-notice><p>{p}</p></section></main>", "{p}"),
        ("<article><p>{p}</p><div class=menu-of-the-day><p>{p}</p></div></article>", "{p} {p}"),
        ("<article><p>{p}</p><section id=comment-on-the-law><p>{p}</p></section></article>", "{p} {p}"),
        ("<article><p>{p}</p><section id=join-the-discussion><p>{p}</p></section></article>", "{p}"),
        ("<article><p>{p}</p><div class='menu-of-the-day sidebar'><p>{p}</p></div></article>", "{p}"),
        ("<body><p><a href=1>{p}</a></p></body>", ""),
    ],
)
def test_names_and_link_lists_within_an_article(page, want):
    assert html.main_text(page.replace("{p}", LONG_P)).split() == want.replace("{p}", LONG_P).split()


def test_em_converges_and_finds_the_rules_accuracies():
    """On votes drawn from known accuracies; more rounds or a stricter tolerance change nothing."""
    rng = np.random.default_rng(4)
    n, k = 20000, 4
    kind = rng.choice(k + 1, n, p=[0.85, 0.06, 0.04, 0.03, 0.02])
    chance = np.vstack([np.full(k, 0.01), np.where(np.eye(k) > 0, 0.85, 0.02)])[kind]
    votes = np.where(rng.random((n, k)) < 0.2, 0, np.where(rng.random((n, k)) < chance, -1, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model, closer = quality.fit_patterns(patterns, counts), quality.fit_patterns(patterns, counts, 1e-13)
    assert np.allclose(model["share"], closer["share"], atol=1e-6) and np.allclose(model["objects"], closer["objects"], atol=1e-6)
    assert np.allclose(model["share"], [0.85, 0.06, 0.04, 0.03, 0.02], atol=0.03)
    assert all(abs(model["objects"][i + 1][i] - 0.85) < 0.1 for i in range(k))


def test_posteriors_match_bayes_rule(spark):
    """The posterior column against the product of the model's chances, pattern by pattern."""
    rng = random.Random(6)
    texts = ["word " * 60, "UP!! " * 60, "a|b # " * 60, "1234 5678 " * 60, None, *("plain words, of some length. " * rng.randrange(1, 9) for _ in range(30))]
    rows = quality.judge(frame(spark, texts)).collect()
    names = list(quality.rules())
    votes = [tuple(r[f"vote_{x}"] for x in names) for r in rows]
    counts = collections.Counter(votes)
    model = quality.fit_patterns(np.array(sorted(counts), float), np.array([counts[v] for v in sorted(counts)], float))
    for r, v in zip(rows, votes, strict=True):
        fit = [s * np.prod([p if x < 0 else 1 - p if x > 0 else 1 for p, x in zip(o, v, strict=True)]) for s, o in zip(model["share"], model["objects"], strict=True)]
        assert abs(r.posterior - fit[0] / sum(fit)) < 1e-9


def brute_iban(text):
    """Every start and end, nothing shared with the operator but the lengths."""
    found, at = [], 0
    for a in range(len(text)):
        if a < at or (a and text[a - 1].isascii() and text[a - 1].isalnum()):
            continue
        for b in range(len(text), a + 14, -1):
            part = text[a:b]
            code = part.replace(" ", "")
            if "  " in part or part != part.strip() or not re.fullmatch("[A-Z]{2}[0-9]{2} ?[A-Z0-9 ]+", part) or len(code) != pii.IBAN_LENGTHS.get(code[:2]):
                continue
            if b < len(text) and text[b].isascii() and text[b].isalnum():
                continue
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                found.append((a, b, "iban"))
                at = b
                break
    return found


def test_ibans_match_brute_force():
    rng = random.Random(17)
    good = ["DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S"]
    for _ in range(300):
        text = ""
        for _ in range(rng.randrange(1, 4)):
            code = rng.choice(good)
            if rng.random() < 0.3:
                code = code[:8] + rng.choice("0123456789AB") + code[9:]
            if rng.random() < 0.5:
                code = " ".join(code[i : i + 4] for i in range(0, len(code), 4))
            text += code + rng.choice([" ", " AND ", "x", ", é", " 12 ", "\n", "ü"])
        assert [s for s in pii.find(text)[1] if s[2] == "iban"] == brute_iban(text), text
