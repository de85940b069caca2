"""Several changes of a key, folds, as-of joins, containment, paging and stored versions: against plain Python, with hot keys and nulls."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from dawnframe.operators import asof, containment, keyed, markdown, news, registry, requests
from dawnframe.sources import feeds, logs

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def seconds(x):
    return None if x is None else int((x.replace(tzinfo=dt.UTC) - START).total_seconds())


def test_changes_of_one_key_in_order(spark):
    base = spark.createDataFrame([("a", "old", 1), ("b", "old", 1), (None, "old", 1)], "slug string, name string, n int")
    batch = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 2, 2), ("c", "z", 3, 1), (None, "w", 4, 1)], "slug string, name string, n int, seq int")
    rows = lambda f: sorted(((r.slug, r.name, r.n) for r in f.collect()), key=str)
    assert rows(keyed.upsert(base, batch, ["slug"], [F.col("seq").desc()])) == sorted([("a", "y", 2), ("b", "old", 1), ("c", "z", 3), (None, "w", 4)], key=str)
    assert rows(keyed.update_by_id(base, batch, "slug", ["name", "n"], ["seq"])) == sorted([("a", "y", 2), ("b", "old", 1), (None, "w", 4)], key=str)
    patch = spark.createDataFrame([("a", "p", None, 1), ("a", None, 7, 2), ("a", None, None, 3), ("q", "p", 1, 1), ("q", "r", 1, 2)], "slug string, name string, n int, seq int")
    merged, rejected = keyed.partial_update(base, patch, "slug", ["seq"])
    assert rows(merged) == sorted([("a", "p", 7), ("b", "old", 1), (None, "old", 1)], key=str) and rejected.count() == 2


def test_one_request_is_granted_and_the_others_are_refused(spark):
    rows = spark.createDataFrame([(1, "planned", None), (2, "skipped", None), (None, "planned", None)], "id long, status string, history_id long")
    asked = spark.createDataFrame([(1, "published", 10, 2), (1, "skipped", 11, 1), (1, "published", 12, 3), (2, "published", 13, 1), (3, "skipped", 14, 1), (None, "skipped", 15, 1), (1, None, 16, 0)], "id long, new_status string, history_id long, seq int")
    moved, refused = keyed.transition(rows, asked, "id", "planned", ["seq"])
    assert sorted(map(tuple, moved.collect()), key=str) == sorted([(1, "skipped", 11), (2, "skipped", None), (None, "skipped", 15)], key=str)
    assert sorted(r.history_id for r in refused.collect()) == [10, 12, 13, 14, 16]


def test_first_of_several_guarded_writes(spark):
    base = spark.createDataFrame([(1, "old", 5), (2, "old", None)], "id long, name string, version int")
    writes = spark.createDataFrame([(1, "a", 4, 1), (1, "b", 5, 2), (1, "c", 5, 3), (2, "d", None, 1), (9, "e", 5, 1)], "id long, name string, version int, seq int")
    applied, skipped = keyed.guarded_write(base, writes, "id", "version", ["name"], ["seq"])
    assert sorted((r.id, r.name) for r in applied.collect()) == [(1, "b"), (2, "old")]
    assert sorted(r.name for r in skipped.collect()) == ["a", "c", "d", "e"]


def test_created_once(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), (None, 4)], "slug string, seq int")
    created, refused = keyed.create(spark.createDataFrame([("b",)], "slug string"), rows, ["slug"], ["seq"])
    assert sorted(map(tuple, created.collect()), key=str) == [("a", 1), (None, 4)] and sorted(r.seq for r in refused.collect()) == [2, 3, 5]


MOVES = [("planned", "published"), ("planned", "skipped"), ("skipped", "planned"), ("published", "archived")]


def test_fold_of_requests_equals_a_loop(spark):
    rng = random.Random(2)
    states = {k: rng.choice(["planned", "skipped", "published", "draft", None]) for k in [None, *range(30)]} | {7: "planned"}
    wishes = ["planned", "skipped", "published", "archived", "draft", None]
    asked = [(rng.choice([7, 7, 7, None, *range(34)]), i, "skipped" if rng.random() < 0.5 else rng.choice(wishes)) for i in range(3000)]
    now, want = dict(states), []
    for k, i, to in asked:
        before = now.get(k)
        granted = (before, to) in MOVES
        now = now | {k: to} if granted else now
        want.append((i, before, granted, to if granted else before))
    rows = spark.createDataFrame(list(states.items()), "id long, status string")
    after, told = requests.fold(rows, spark.createDataFrame(asked, "id long, seq int, new_status string").repartition(3), "id", ["seq"], MOVES)
    assert sorted((r.seq, r.before, r.granted, r.after) for r in told.collect()) == want
    assert {r.id: r.status for r in after.collect()} == {k: now[k] for k in states} and after.count() == len(states)


@pytest.mark.parametrize("keys", [["k"], []])
def test_neighbours_in_time_equal_a_search(spark, keys):
    rng = random.Random(3)
    moment = lambda: None if rng.random() < 0.03 else START + dt.timedelta(seconds=rng.randrange(4000))
    key = lambda: rng.choice(["hot", "hot", "hot", None, "a", "b", "left only"])
    left = [(i, key(), moment()) for i in range(400)]
    right = [(rng.choice(["hot", "hot", "a", "c", None]), moment(), rng.randrange(50)) for _ in range(300)]
    found = asof.neighbours(spark.createDataFrame(left, "id int, k string, ts timestamp"), spark.createDataFrame(right, "k string, at timestamp, v int").repartition(3), keys, "ts", "at", ["v"])
    pick = lambda *how: asof.chosen(F.col("ts"), *how)
    got = {r.id: r for r in found.select("id", pick("backward").alias("b"), pick("forward").alias("f"), pick("nearest").alias("n"), pick("nearest", 10).alias("w")).collect()}
    assert len(got) == len(left)
    for i, k, ts in left:
        near = [(at, v) for g, at, v in right if at is not None and ts is not None and (g == k or not keys)]
        near = [(at, min(v for a, v in near if a == at)) for at in {a for a, _ in near}]
        back, ahead = max((x for x in near if x[0] <= ts), default=None), min((x for x in near if x[0] >= ts), default=None)
        best = min(near, key=lambda x: (abs(x[0] - ts), x[0]), default=None)
        close = best if best and abs(best[0] - ts) <= dt.timedelta(seconds=10) else None
        plain = lambda m: None if m is None else (seconds(m["at"]), m.v)
        want = [None if x is None else (seconds(x[0]), x[1]) for x in (back, ahead, best, close)]
        assert [plain(got[i][c]) for c in "bfnw"] == want


def test_asof_join_of_empty_tables(spark):
    left, right = spark.createDataFrame([(1, START)], "id int, ts timestamp"), spark.createDataFrame([], "at timestamp, v int")
    assert [tuple(r) for r in asof.asof_join(left, right, [], "ts", "at", ["v"]).select("id", "matched_at", "v").collect()] == [(1, None, None)]
    assert asof.asof_join(left.where("false"), right, [], "ts", "at", ["v"]).count() == 0


def test_containment_finds_every_pair_with_few_candidates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    titles = [(g, i, " ".join(word() for _ in range(rng.randint(1, 7)))) for g in ("r", "s") for i in range(120)] + [("r", 900, "a"), ("r", 901, ""), (None, 902, "abc")]
    lines = [(g, i, f"{word()} {t}" if rng.random() < 0.3 else t[1:-1] if rng.random() < 0.5 else word() * 3) for g, i, t in titles]
    frame = lambda rows: spark.createDataFrame(rows, "report string, id long, text string")
    want = {(g, a, b) for g, a, x in lines for h, b, y in titles if g == h and g and x and y and (x in y or y in x)}
    assert {tuple(r) for r in containment.pairs(frame(lines), frame(titles), "report").collect()} == want
    assert len(want) <= containment.candidates(frame(lines), frame(titles), "report").count() < 3 * len(want) + 200


def test_links_of_blank_lines_and_titles(spark):
    lines = spark.createDataFrame([("r", 1, "- "), ("r", 2, "- nowhere near"), ("s", 3, "- zzz"), ("r", 4, "- alpha"), ("t", 5, "- x")], "report string, line_no int, line string")
    items = spark.createDataFrame([("r", 1, "alpha", "u1"), ("r", 2, "beta", "u2"), ("s", 1, "", "u3"), ("r", 3, "gone", "")], "report string, position int, title string, link string")
    got = {r.line_no: r.line for r in news.attach_links(lines, items).collect()}
    assert got == {1: "-  [🔗](u1)", 2: "- nowhere near", 3: "- zzz [🔗](u3)", 4: "- alpha [🔗](u1)", 5: "- x"}


def test_pages_from_the_last_row(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(9)]), i) for i in range(200)]
    registry.write_paged(spark.createDataFrame(rows, "day int, id int"), str(tmp_path / "t"), [("day", True), ("id", False)])
    table, last, seen = spark.read.parquet(str(tmp_path / "t")), None, []
    while found := [tuple(r) for r in registry.page_after(table, [("day", True), ("id", False)], 30, last).collect()]:
        seen += found
        last = found[-1]
    assert seen == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    plan = registry.page_after(table, [("day", True), ("id", False)], 30, (4, 7))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(day,4)" in plan and "TakeOrderedAndProject" in plan


def test_equal_buckets_are_not_read(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("x"), F.lit(None).cast("string").alias("y"))
    changed = rows.withColumn("y", F.when(F.col("k") == 44, F.lit("new"))).where("k <> 45")
    before, after = str(tmp_path / "b"), str(tmp_path / "a")
    keyed.store_bucketed(rows, before, "k", ["x", "y"], 16)
    keyed.store_bucketed(changed.repartition(5), after, "k", ["x", "y"], 16)
    buckets = {r.b for r in rows.where("k in (44, 45)").select(F.pmod(F.xxhash64("k"), F.lit(16)).alias("b")).collect()}
    assert set(keyed.changed_buckets(spark, before, after)) == buckets
    for version in ("b", "a"):  # what isn't read may as well be gone
        for folder in (tmp_path / version / "rows").glob("bucket=*"):
            if int(folder.name.split("=")[1]) not in buckets:
                shutil.rmtree(folder)
    assert {(r.k, r.action) for r in keyed.audit_stored(spark, before, after, "k", ["x", "y"]).collect()} == {(44, "update"), (45, "delete")}
    assert keyed.audit_stored(spark, before, before, "k", ["x", "y"]).count() == 0


def test_flags_instead_of_rows_for_admins(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, owner string")
    actors = spark.createDataFrame([("a", "author"), ("root", "admin"), ("b", "admin")], "actor string, role string")
    assert sorted((r.id, r.actor, r.admins) for r in registry.scope_flags(rows, actors, "owner").collect()) == [(1, "a", True), (2, None, True), (3, None, True)]
    assert not registry.scope_flags(rows, actors.where("role = 'author'"), "owner").first().admins


def test_feed_files(spark, tmp_path):
    good = "<item><title> A &amp; B </title><link>http://x/1</link><pubDate>d</pubDate></item>"
    files = [f"<rss><channel><title>feed</title>{good}<item><title>bad</titel></item>\n{good.replace('A', 'C')}</channel></rss>", "<rss><channel><item>\n<title>  </title></item><item a='1'><title>D</title></item>", ""]
    for i, text in enumerate(files):
        (tmp_path / f"{i}.xml").write_text(text)
    items, rejected = feeds.feed_files(spark, str(tmp_path))
    assert sorted(map(tuple, items.collect())) == [("A & B", "http://x/1", "Google News", "d"), ("C & B", "http://x/1", "Google News", "d"), ("D", "", "Google News", "")]
    assert [r.record for r in rejected.collect()] == ["<item><title>bad</titel></item>"]


@pytest.mark.parametrize(("md", "want"), [
    ("# T\n\n> a\n>\n>> b\nc", "a b"), ("> \n\n> q\n> r", "q r"), ("x\n> y\nz\n\nw", "y"), ("a" * 60 + "\n" + "b" * 39 + "\nmore", "a" * 60 + " " + "b" * 39),
    ("a" * 60 + "\n" + "b" * 50 + "\nmore", "a" * 60 + " " + "b" * 39 + "..."), ("", markdown.NO_SUMMARY), ("# only", markdown.NO_SUMMARY), (None, markdown.NO_SUMMARY), ("p\n# h\nq", "p"),
])
def test_summaries(spark, md, want):
    assert spark.createDataFrame([(md,)], "md string").select(markdown.intro_summary(F.col("md")).alias("s")).first().s == want


def test_summary_of_very_many_lines(spark):
    rows = spark.range(1).select(F.concat(F.lit("> q\n"), F.repeat(F.lit("> line\n"), 200000)).alias("md"))
    assert len(rows.select(markdown.intro_summary(F.col("md")).alias("s")).first().s) == 103


def test_dump_of_all_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, None, [1.5, None], START), (1, None, [1.5, None], START), (2, "x\n", [], START + dt.timedelta(microseconds=7))], "k long, s string, v array<float>, at timestamp")
    logs.dump_all({"a": a, "b": a.select("s").where("false")}, str(tmp_path / "d"))
    back = logs.restore_all(spark, str(tmp_path / "d"))
    assert back["a"].schema == a.schema and sorted(map(str, back["a"].collect())) == sorted(map(str, a.collect()))
    assert {tuple(r) for r in logs.verify_dump(spark, str(tmp_path / "d")).collect()} == {("a", 3, True), ("b", 0, True)}
    part = next((tmp_path / "d" / "tables" / "a").glob("part-*.json"))
    part.write_text(part.read_text().replace("1.5", "1.6") + '{"k":3}\n')
    (part.parent / f".{part.name}.crc").unlink()
    assert {tuple(r) for r in logs.verify_dump(spark, str(tmp_path / "d")).collect()} == {("a", 3, False), ("b", 0, True)}
