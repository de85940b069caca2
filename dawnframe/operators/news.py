"""News sections: union, keep-first dedup, numbering, references, caps and message budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnframe.durable import written
from dawnframe.functions.exprs import strip
from dawnframe.operators import containment
from dawnframe.operators.topk import dedup_long_text, first_k, keep_first, numbered, ranked

#: Patterns and marks of the report texts.
REF = r"#(\d+)\s*"
SOURCE_REF = r"\[來源 #(\d+)\]"
LINK_MARK = "🔗"
LINK = r"\s*\[🔗\]\([^)]+\)\s*"
FILLER = "- 今日無相關新聞"
BUDGET = 4000
#: The daily report's first line, and its sections in order: name, header, most lines.
DAILY = "📰 早安新聞摘要 — "
DAILY_SECTIONS = (("ai", "**🤖 AI 人工智慧**", 10), ("tech", "**💻 科技 & 半導體**", 8), ("general", "**🌏 重大新聞**", 3))


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Feeds in their fixed order, as ``feed_order``; ``position`` stays each feed's own."""
    return reduce(DataFrame.unionByName, [f.withColumn("feed_order", F.lit(i)) for i, f in enumerate(feeds)])


def order_feeds(rows: DataFrame, feed: str, order: list[str]) -> DataFrame:
    """Rows of many feeds in one table: ``feed_order`` by the feed's name (from 0) and ``position`` within it (from 0)."""
    names = rows.select(feed).distinct().select(feed, (F.row_number().over(Window.orderBy(feed)) - 1).alias("feed_order"))  # a row for each feed
    placed = number_items(rows, feed, order).withColumn("position", F.col("n") - 1).drop("n")
    return placed.join(names, feed)


def dedup_titles(rows: DataFrame, section: str, title: str, order: list[str], row_id: str) -> DataFrame:
    """The earliest row of each section and lower-cased title; digests are shuffled, not titles."""
    return dedup_long_text(rows, [section], F.lower(title), order, row_id)


def dedup_urls(rows: DataFrame, url: str, order: list[str]) -> DataFrame:
    """The earliest row of each exact address."""
    return keep_first(rows, [url], [F.col(c) for c in order])


def number_items(rows: DataFrame, report: str, order: list[str]) -> DataFrame:
    """``n`` from 1 within each report, over sections in order."""
    return numbered(rows, [report], [F.col(c) for c in order], "n")


def title_link_map(rows: DataFrame, title: str, link: str, order: str | Column, within: tuple[str, ...] = ()) -> DataFrame:
    """(title, link) by stripped title, for each value of ``within``; the last one wins and both must be filled."""
    at = F.col(order) if isinstance(order, str) else order
    kept = rows.select(*within, strip(F.col(title)).alias("title"), F.col(link).alias("link"), at.alias("_at")).where("title <> '' and link <> ''")
    return kept.groupBy(*within, "title").agg(F.max_by("link", "_at").alias("link"))


def _rebuilt(rows: DataFrame, row_id: str, report: str, text: str, pattern: str, items: DataFrame, made: Column, otherwise: Column) -> DataFrame:
    """``text`` with each match of ``pattern`` replaced by ``made`` of the item it numbers, or ``otherwise``.

    Only rows with a match take part in the join, as (row, position, number); ``_token`` is the match itself.
    """
    body = F.col(text)
    tokens = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("token"), F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("n"))
    refs = rows.where(body.rlike(pattern)).select(row_id, F.col(report).alias("report"), F.posexplode(tokens).alias("_pos", "_t"))
    # Items count from 1.  What names none, often the same number in every row, gets a number of its row that no item has, so it meets in no one task.
    n = F.col("_t.n").try_cast("long")
    refs = refs.select(row_id, "report", "_pos", F.col("_t.token").alias("_token"), F.when(n >= 1, n).otherwise(-1 - F.pmod(F.xxhash64(row_id), F.lit(1 << 40))).alias("n"))
    resolved = refs.join(items, ["report", "n"], "left").select(row_id, F.struct("_pos", F.coalesce(made, otherwise).alias("text")).alias("r"))
    by_row = resolved.groupBy(row_id).agg(F.array_sort(F.collect_list("r")).alias("_r"))
    gaps = F.split(body, pattern, -1)
    parts = F.zip_with(gaps, F.coalesce(F.col("_r.text"), F.array().cast("array<string>")), lambda g, r: F.concat(F.coalesce(g, F.lit("")), F.coalesce(r, F.lit(""))))
    return rows.join(by_row, row_id, "left").withColumn(text, F.when(F.col("_r").isNull(), body).otherwise(F.array_join(parts, ""))).drop("_r")


def resolve_refs(rows: DataFrame, row_id: str, report: str, text: str, items: DataFrame) -> DataFrame:
    """``#N`` and the white space after it become a link and one space; an unknown number or empty link vanishes.

    ``items``: (report, n, link).
    """
    made = F.when(F.col("link") != "", F.concat(F.lit(f"[{LINK_MARK}]("), F.col("link"), F.lit(") ")))
    return _rebuilt(rows, row_id, report, text, REF, items, made, F.lit(""))


def resolve_source_refs(rows: DataFrame, row_id: str, report: str, text: str, items: DataFrame) -> DataFrame:
    """``[來源 #N]`` becomes ``[source](url)``; an unknown number stays as it is.  ``items``: (report, n, source, url)."""
    made = F.concat(F.lit("["), F.col("source"), F.lit("]("), F.col("url"), F.lit(")"))
    return _rebuilt(rows, row_id, report, text, SOURCE_REF, items, made, F.col("_token"))


def attach_links(lines: DataFrame, items: DataFrame, line: str = "line") -> DataFrame:
    """Lines ``- title`` of a report with the link of the equal title, else of the first that contains it or is in it.

    ``lines``: (report, line_no, line); ``items``: (report, position, title, link).  Equal lines are looked up once; containment goes by an index of
    pieces (``containment``), so a report may hold any share of all lines.  An empty title lies in every line, and an empty line in every title.
    """
    open_line = F.col(line).startswith("- ") & ~F.col(line).contains(f"[{LINK_MARK}]") & ~F.col(line).contains("http")
    title = strip(F.substring(F.col(line), 3, 1 << 30))
    keyed = lines.withColumn("_title", F.when(open_line, title))
    known = items.groupBy("report", "title").agg(F.max_by("link", "position").alias("link"), F.min("position").alias("position")).where("link <> ''")
    known = written(known, "titles")  # read by each side of the index
    exact = keyed.join(known.select("report", F.col("title").alias("_title"), F.col("link").alias("_exact")), ["report", "_title"], "left")
    missed = written(exact.where(F.col("_exact").isNull() & F.col("_title").isNotNull()).groupBy("report", "_title").agg(F.min("line_no").alias("id")), "open-lines")

    there = containment.pairs(missed.select("report", "id", F.col("_title").alias("text")), known.select("report", F.col("position").alias("id"), F.col("title").alias("text")), "report")
    first = there.groupBy("report", F.col("a").alias("id")).agg(F.min("b").alias("_found"))
    blank = known.where("title = ''").select("report", F.col("position").alias("_blank"))
    top = known.groupBy("report").agg(F.min("position").alias("_top"))
    chosen = missed.join(first, ["report", "id"], "left").join(blank, "report", "left").join(top, "report", "left")
    chosen = chosen.withColumn("position", F.when(F.col("_title") == "", F.col("_top")).otherwise(F.least("_found", "_blank")))
    loose = chosen.join(known.select("report", "position", F.col("link").alias("_loose")), ["report", "position"]).select("report", "_title", "_loose")

    link = F.coalesce("_exact", "_loose")
    out = exact.join(loose, ["report", "_title"], "left")
    return out.select("report", "line_no", F.when(link.isNotNull(), F.concat(F.col(line), F.lit(f" [{LINK_MARK}]("), link, F.lit(")"))).otherwise(F.col(line)).alias(line))


def section_top_k(sections: DataFrame, rows: DataFrame, section: str, order: list[str], line: str, most: int | None = None) -> DataFrame:
    """The first ``cap`` lines of each section; an empty section has the filler line.  ``sections``: (section, cap).

    The rank filter uses the largest cap, so each section is cut before the shuffle; the exact cap follows.  A caller that knows the largest
    cap gives it as ``most``; else a small job reads it, since only a number known to the plan cuts rows before the shuffle.
    """
    most = (sections.agg(F.max("cap")).first()[0] or 0) if most is None else most
    nth = F.row_number().over(Window.partitionBy(section).orderBy(*order))
    top = rows.withColumn("rank", nth).where(F.col("rank") <= most).select(section, F.col("rank").cast("long").alias("rank"), line)
    kept = sections.join(top, section, "left").where(F.col("rank").isNull() | (F.col("rank") <= F.col("cap")))
    return kept.select(section, F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce(line, F.lit(FILLER)).alias(line))


def daily_report(reports: DataFrame, items: DataFrame, report: str, date: str, sections: tuple = DAILY_SECTIONS) -> DataFrame:
    """The text of each report: first line, then each section's header and first lines, or the filler, and a blank line.

    ``reports``: (report, date as text), one row each; ``items``: (report, section, position, title, link), in any number.  A title's link is the
    last one filled for the equal stripped title anywhere in the report, sections in their order, else its own; without one the title stands
    alone.  Null titles and links count as empty.  Items of other sections give no line and no link.  Of each section only its first lines are
    shuffled, and of the links one of each (report, title) and task, so a report may hold any share of all items.  Of equal positions the lesser
    title, then link, comes first.
    """
    place = F.lit(None).cast("int")
    for i, (name, _, _) in enumerate(sections):
        place = F.when(F.col("section") == name, i).otherwise(place)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = items.select(report, place.alias("_place"), "position", filled("title"), filled("link")).where("_place is not null")
    most = max(cap for _, _, cap in sections)
    top = first_k(rows, [report, "_place"], [F.col(c) for c in ("position", "title", "link")], most, "_nth")
    top = top.where(F.col("_nth") <= F.element_at(F.array(*[F.lit(cap) for _, _, cap in sections]), F.col("_place") + 1))
    links = title_link_map(rows, "title", "link", F.struct("_place", "position", "title", "link"), (report,))
    linked = top.join(links.withColumnRenamed("link", "_mapped"), [report, "title"], "left")
    link = F.coalesce("_mapped", "link")
    line = F.concat(F.lit("- "), F.col("title"), F.when(link != "", F.concat(F.lit(f" [{LINK_MARK}]("), link, F.lit(")"))).otherwise(""))
    each = linked.groupBy(report).agg(F.collect_list(F.struct("_place", "_nth", line.alias("line"))).alias("_lines"))  # at most the sum of the caps

    def block(i: int, header: str) -> Column:
        own = F.array_sort(F.filter("_lines", lambda x: x._place == i))["line"]
        return F.concat(F.lit(header + "\n"), F.when(F.size(own) > 0, F.array_join(own, "\n")).otherwise(FILLER), F.lit("\n"))

    head = F.concat(F.lit(DAILY), F.coalesce(F.col(date), F.lit("")), F.lit("\n"))
    text = F.array_join(F.array(head, *[block(i, header) for i, (_, header, _) in enumerate(sections)]), "\n")
    return reports.select(report, date).join(each, report, "left").select(report, text.alias("text"))


def fit_to_budget(text: Column, lead: str, budget: int = BUDGET) -> Column:
    """A text within the budget: as it is; else without links outside the lead section; else without links.

    A line that names the lead starts its section; the next line with a bold header ends it.
    """
    heads = F.split(text, rf"\n(?=\*\*|[^\n]*\Q{lead}\E)", -1)  # sections: their first line decides for all
    bare = lambda section: F.array_join(F.transform(F.split(section, "\n", -1), lambda x: F.regexp_replace(x, LINK, "")), "\n")
    trimmed = F.array_join(F.transform(heads, lambda s: F.when(F.substring_index(s, "\n", 1).contains(lead), s).otherwise(bare(s))), "\n")
    return F.when(F.length(text) <= budget, text).when(F.length(trimmed) <= budget, trimmed).otherwise(F.regexp_replace(text, LINK, ""))


def locale_route(query: Column) -> Column:
    """``zh-TW`` for a text with a Chinese character, else ``en-US``."""
    return F.when(query.rlike("[\\u4e00-\\u9fff]"), "zh-TW").otherwise("en-US")


def encode_query(topic: Column, keep_slash: bool = False) -> Column:
    """Percent-encoded for an address: a space is ``%20``; unreserved marks stay."""
    out = F.replace(F.replace(F.replace(F.url_encode(topic), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def history_digest(rows: DataFrame, key: str, order: list, k: int = 8) -> DataFrame:
    """The newest ``k`` entries of each key as text lines: date, title, stance (at most 118), up to three links (60)."""
    newest = ranked(rows, [key], order, "_nth").where(F.col("_nth") <= k)
    stance = strip(F.coalesce("stance", F.lit("")))
    stance = F.when(F.length(stance) > 120, F.concat(F.substring(stance, 1, 117), F.lit("…"))).otherwise(stance)
    cut = F.array_join(F.transform(F.slice("key_links", 1, 3), lambda u: F.substring(u, 1, 60)), ", ")
    links = F.when(F.size("key_links") > 0, F.concat(F.lit(" · links: "), cut)).otherwise("")
    line = F.concat(F.lit("- "), F.col("date").cast("string"), F.lit(" · "), F.col("title"), F.lit(" · "), stance, links)
    return newest.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_nth", line.alias("line"))))["line"], "\n").alias("digest"))


def resolve_topics(accounts: DataFrame, explicit: str, stored: DataFrame, default: list[str]) -> DataFrame:
    """Topics of each account: those asked for, else the stored list, else the default."""
    rows = accounts.join(stored.select("account", F.col("topics").alias("_stored")), "account", "left")
    given = lambda c: F.when(F.size(c) > 0, F.col(c))
    return rows.select("account", F.coalesce(given(explicit), given("_stored"), F.array(*[F.lit(d) for d in default])).alias("topics"))


def add_topic(topics: Column, topic: Column) -> Column:
    """The list with the stripped topic at its end, unless it is blank or there already."""
    name, known = strip(topic), F.coalesce(topics, F.array().cast("array<string>"))
    return F.when((name == "") | F.array_contains(known, name), known).otherwise(F.array_append(known, name))


def remove_topic(topics: Column, topic: Column) -> Column:
    return F.array_remove(F.coalesce(topics, F.array().cast("array<string>")), strip(topic))

