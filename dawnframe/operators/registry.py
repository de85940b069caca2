"""Registries, publish history and editorial plans as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnframe.durable import written
from dawnframe.functions.exprs import canonical_json, canonical_json_map, first_filled, short_digest
from dawnframe.operators.topk import first_k

#: The fields that identify an entity's content, hash version 1.
HASHED = ("slug", "role", "name", "expression", "mental_models", "heuristics", "antipatterns", "limits")
NEWEST_ROWS = 8
DIRECTION, PLANNED = "tech-first", "planned"
#: The lines of a topic's block and what each shows, and its closing line.
TOPIC_HEAD = "=== 本期主題指引（editorial plan） ==="
TOPIC_LINES = (("系列週次：W", "week"), ("主題提示：", "title_hint"), ("切入角度（angle）：", "angle"), ("觀察視角（lens）：", "lens"), ("方向：", "direction"))
TOPIC_QUESTION = "核心提問："
TOPIC_ADVICE = "請以上述主題提示和切入角度為本篇文章的主軸。從素材中選取與此角度相關的新聞，圍繞核心提問展開論述。"


def list_keys(base: DataFrame, key: str) -> DataFrame:
    return base.select(key).orderBy(key)


def record_history(history: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """``history`` with the batch appended; new ids follow the largest one in the batch's order.

    The batch is range-partitioned by its order, into the session's number of shuffle partitions; ids are the partition's offset plus the place in it, so no task sees
    the whole batch.  The numbered batch is written out, since a second range shuffle may cut elsewhere.  The offsets
    are one row for each partition.
    """
    dealt = batch.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    placed = written(dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "numbered")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_size"))
    before = counts.withColumn("_from", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.coalesce(history.agg(F.max("id")).scalar(), F.lit(0))
    new = placed.join(F.broadcast(before.select("_p", "_from")), "_p").withColumn("id", last + F.col("_from") + F.col("_n"))
    return history.unionByName(new.select(*history.columns))


def recent(history: DataFrame, persona: str | None = None, skill: str | None = None, stream: str | None = None, k: int = NEWEST_ROWS) -> DataFrame:
    """The newest ``k`` rows that match all given filters, newest first; persona or skill is required."""
    if persona is None and skill is None:
        raise ValueError("a persona or a skill is required")
    if k <= 0:
        raise ValueError("k must be positive")
    given = {"persona_slug": persona, "skill": skill, "stream": stream}
    tests = [F.col(c) == v for c, v in given.items() if v is not None]
    return history.where(reduce(Column.__and__, tests)).orderBy(F.col("date").desc(), F.col("id").desc()).limit(k)


def recent_of_all(history: DataFrame, key: str, k: int = NEWEST_ROWS, date: str = "date", row_id: str = "id") -> DataFrame:
    """The newest ``k`` rows of every key with their ``rank``."""
    if k <= 0:
        raise ValueError("k must be positive")
    return first_k(history, [key], [F.col(date).desc(), F.col(row_id).desc()], k, rank="rank")


def decode_links(text: Column) -> Column:
    """A JSON list as an array of texts; anything else is an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def list_plans(plans: DataFrame, skill: Column | None = None) -> DataFrame:
    rows = plans if skill is None else plans.where(skill)
    return rows.orderBy(F.col("month").desc(), "series_slug")


def with_defaults(topics: DataFrame) -> DataFrame:
    """New topics with the default direction and status where none is given."""
    return topics.withColumns({"direction": F.coalesce("direction", F.lit(DIRECTION)), "status": F.coalesce("status", F.lit(PLANNED))})


def next_planned(topics: DataFrame, plan: str, week: str, row_id: str, status: str = PLANNED) -> DataFrame:
    """The first planned topic of each plan by week."""
    return first_k(topics.where(F.col("status") == status), [plan], [F.col(week), F.col(row_id)], 1)


def topic_block(topic: Column) -> Column:
    """The text that hands a topic to a writer, its key question only if there is one; empty for a null topic.

    ``topic``: a struct of week, title_hint, angle, lens, direction and key_question; their nulls stand as empty texts.
    """
    shown = [F.concat(F.lit(label), F.coalesce(topic[field].cast("string"), F.lit(""))) for label, field in TOPIC_LINES]
    asked = F.when(F.coalesce(topic.key_question, F.lit("")) != "", F.concat(F.lit(TOPIC_QUESTION), topic.key_question))
    text = F.concat(F.concat_ws("\n", F.lit(TOPIC_HEAD), *shown, asked), F.lit(f"\n\n{TOPIC_ADVICE}\n\n"))
    return F.when(topic.isNull(), "").otherwise(text)


def plan_with_topics(plans: DataFrame, topics: DataFrame, key: str, child_key: str, order: str, fields: list[str]) -> DataFrame:
    """Each plan with its topics as an ordered array; a plan without topics has an empty one."""
    nested = topics.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("topics"))
    return plans.join(nested, key, "left").withColumn("topics", F.coalesce("topics", F.array().cast(nested.schema["topics"].dataType)))


def content_hash(fields: dict[str, Column], version: int = 1) -> Column:
    """Short digest of the identifying fields as sorted JSON."""
    if version != 1:
        raise ValueError(f"no hasher for version {version}")
    return short_digest(canonical_json({name: fields[name] for name in HASHED}))


def content_hash_any(entries: Column) -> Column:
    """The same over any map of texts, whatever its order."""
    return short_digest(canonical_json_map(entries))


def restore_layout(old: DataFrame, fields: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """Rows of the older layout: for each field its name, else its position's name, else a default; empty counts as missing."""
    return old.select(*[first_filled(F.col(f"`{name}`"), F.col(f"`{place}`"), F.lit(default).cast("string")).alias(field) for field, (name, place, default) in fields.items()])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()])


def mask_value(x: Column) -> Column:
    """Only the length and the first four characters of a secret."""
    return F.concat(F.lit("len="), F.length(x).cast("string"), F.lit(" prefix="), F.left(x, F.lit(4)), F.lit("..."))


def preview_state(content_at: Column, preview_at: Column) -> Column:
    return F.when(preview_at.isNull(), "missing").when(content_at > preview_at, "stale").otherwise("fresh")


def preview_backlog(rows: DataFrame, preview: str, by: str) -> DataFrame:
    """Rows without a preview, and all rows, of each group."""
    return rows.groupBy(by).agg(F.count_if(F.col(preview).isNull()).alias("pending"), F.count("*").alias("total"))


def scope_filter(rows: DataFrame, actors: DataFrame, owner: str) -> DataFrame:
    """What each actor may see: an admin everything, others their own rows.  ``actors``: (actor, role).

    Two joins rather than one condition with "or": own rows by an equi-join; admins, a small set, see all rows.
    """
    own = rows.join(actors.where("role <> 'admin'").select(F.col("actor"), F.col("actor").alias(owner)), owner)
    everyone = F.array_sort(F.collect_set("actor"))
    admins = actors.where("role = 'admin'").agg(everyone).scalar()  # the names of the admins
    return own.select(*rows.columns, "actor").unionByName(rows.select("*", F.explode(admins).alias("actor")))


def scope_flags(rows: DataFrame, actors: DataFrame, owner: str) -> DataFrame:
    """Each row once, with ``actor``, the author who may see it (or null), and ``admins``: whether there are admins, who see everything.

    For many rows and admins: ``scope_filter`` gives a row for each admin.
    """
    authors = actors.where("role <> 'admin'").select("actor", F.col("actor").alias("_owner")).distinct()
    any_admin = actors.where("role = 'admin'").agg(F.count("*") > 0).scalar()
    return rows.join(authors, rows[owner] == authors["_owner"], "left").select(*[rows[c] for c in rows.columns], "actor", any_admin.alias("admins"))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page by its offset; all pages before it are sorted too.  ``page_after`` goes on from a page's last row instead."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def write_paged(rows: DataFrame, path: str, order: list[tuple[str, bool]]) -> None:
    """Rows as Parquet, dealt to ranges of the order and sorted, so that files and row groups hold neighbours; ``order``: (column, falling)."""
    by = [F.col(c).desc_nulls_last() if falling else F.col(c).asc_nulls_last() for c, falling in order]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def page_after(rows: DataFrame, order: list[tuple[str, bool]], limit: int, last: tuple | None = None) -> DataFrame:
    """The ``limit`` rows that follow the row with the values ``last`` (None: the first page); nulls come last.

    The bound on the leading column reaches the scan: of a table written by ``write_paged`` only the row groups from the
    last row on are read, and the top rows are taken in each task, so a page costs the same wherever it is.
    """
    if last is not None:
        beyond = lambda c, falling, v: F.lit(False) if v is None else (F.col(c) < v if falling else F.col(c) > v) | F.col(c).isNull()
        after = F.lit(False)
        for (c, falling), v in reversed(list(zip(order, last, strict=True))):
            after = beyond(c, falling, v) | (F.col(c).eqNullSafe(F.lit(v)) & after)
        (c, falling), v = order[0], last[0]
        bound = F.col(c).isNull() if v is None else (F.col(c) <= v if falling else F.col(c) >= v) | F.col(c).isNull()
        rows = rows.where(bound & after)
    return rows.orderBy(*[F.col(c).desc_nulls_last() if falling else F.col(c).asc_nulls_last() for c, falling in order]).limit(limit)


def match_email(requests: DataFrame, invites: DataFrame) -> DataFrame:
    """Requests with an unused invite for the same address, case folded."""
    unused = invites.where(F.col("used_at").isNull()).select(F.lower("email").alias("_key"), "invite_id")
    return requests.withColumn("_key", F.lower("email")).join(unused, "_key").drop("_key")


def series_split(columns: DataFrame, streams: DataFrame, order: str) -> DataFrame:
    """The next planned item of each owner over finite columns and recurring streams; ``kind`` tells which it is."""
    both = columns.withColumn("kind", F.lit("column")).unionByName(streams.withColumn("kind", F.lit("stream")))
    return first_k(both.where(F.col("status") == PLANNED), ["owner"], [F.col(order), F.col("kind"), F.col("id")], 1)
