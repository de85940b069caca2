"""Queries of the registry, history and editorial operators, and of the text and JSON sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dawnframe.durable import shared_folder
from dawnframe.operators import keyed, registry, requests, series
from dawnframe.plans.registry import query
from dawnframe.plans.series_queries import CLOSES, EXTREMES, LAST, closes
from dawnframe.sources import logs
from dawnframe.tables import TABLES, table

OLD, NEW = "2024-01-01", "2024-02-02"


def _day(text):
    return F.lit(text).cast("date")


def entities(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    return rows.select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.lit("p").alias("preview_text"), _day(OLD).alias("created_at"), _day(OLD).alias("updated_at"))


def entity_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0")
    return rows.select(F.col("c_custkey").alias("slug"), F.concat(F.col("c_name"), F.lit("!")).alias("name"), F.lower("c_mktsegment").alias("role"), F.lit("q").alias("preview_text"))


ENTITY = f"""SELECT c_custkey AS slug, CASE WHEN c_custkey % 4 = 0 THEN c_name || '!' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS role,
  {{preview}} AS preview_text, CASE WHEN c_custkey % 3 <> 0 THEN '{OLD}' ELSE '{NEW}' END AS created_at, CASE WHEN c_custkey % 4 = 0 THEN '{NEW}' ELSE '{OLD}' END AS updated_at FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 = 0"""
STAMPS = ("created_at", "updated_at")


@query("r1_upsert_entity", ENTITY.format(preview="CASE WHEN c_custkey % 4 = 0 THEN 'q' ELSE 'p' END"), dates=STAMPS)
def r1(spark, sf_dir):
    return keyed.upsert_entity(entities(spark, sf_dir), entity_batch(spark, sf_dir), "slug", _day(NEW))


@query("r2_upsert_clearing_preview", ENTITY.format(preview="CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'p' END"), dates=STAMPS)
def r2(spark, sf_dir):
    return keyed.upsert_entity(entities(spark, sf_dir), entity_batch(spark, sf_dir), "slug", _day(NEW), cleared=("preview_text",))


@query("r3_get_entity", "SELECT o_custkey AS slug, CASE WHEN o_custkey % 3 <> 0 THEN c_name END AS name, o_custkey % 3 <> 0 AS found FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON c_custkey = o_custkey")
def r3(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug")).distinct()
    return keyed.lookup(keys, entities(spark, sf_dir).select("slug", "name"), "slug")


@query("r4_list_keys", "SELECT c_name FROM customer ORDER BY c_name")
def r4(spark, sf_dir):
    return registry.list_keys(table(spark, sf_dir, "customer"), "c_name")


@query("r5_delete_cascade", "SELECT 'customer' AS t, c_custkey AS k, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 2 UNION ALL SELECT 'orders', o_custkey, count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 GROUP BY 2")
def r5(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    parent, child = keyed.delete_cascade(customer, orders, customer.where("c_acctbal < 0"), "c_custkey", "o_custkey")
    size = lambda df, name, key: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "k", "n")
    return size(parent, "customer", "c_custkey").unionByName(size(child, "orders", "o_custkey"))


@query(
    "r6_partial_update",
    "SELECT c_custkey AS slug, CASE WHEN c_custkey % 6 = 0 THEN 'renamed' ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 2 THEN 'NEW' ELSE c_mktsegment END AS role, 'kept' AS state FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'renamed' END, CASE WHEN c_custkey % 6 = 2 THEN 'NEW' END, 'rejected' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 1",
)
def r6(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    base = customer.where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    patch = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("slug"), F.when(F.col("c_custkey") % 6 == 0, "renamed").alias("name"), F.when(F.col("c_custkey") % 6 == 2, "NEW").alias("role"))
    merged, rejected = keyed.partial_update(base, patch, "slug")
    return merged.withColumn("state", F.lit("kept")).unionByName(rejected.withColumn("state", F.lit("rejected")))


def history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("persona_slug"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("skill"), F.col("o_orderstatus").alias("stream"))


@query(
    "r7_record_history",
    """WITH h AS (SELECT o_orderkey AS id, o_orderkey AS source FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS source, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1)
    SELECT id, source FROM h UNION ALL SELECT (SELECT max(id) FROM h) + n, source FROM b""",
)
def r7(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source"))
    return registry.record_history(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").drop("id"), ["source"])


@query("r8_recent", "SELECT id, persona_slug, CAST(date AS VARCHAR) AS date, rank FROM (SELECT o_orderkey AS id, o_custkey AS persona_slug, CAST(o_orderdate AS DATE) AS date, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 8")
def r8(spark, sf_dir):
    found = registry.recent_of_all(history(spark, sf_dir), "persona_slug")
    return found.select("id", "persona_slug", F.col("date").cast("string").alias("date"), "rank")


@query("r9_update_by_id", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE o_custkey END AS remote_id, CASE WHEN o_orderkey % 5 = 0 THEN 'u' || o_orderkey ELSE o_orderpriority END AS remote_url FROM orders")
def r9(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("remote_id"), F.col("o_orderpriority").alias("remote_url"))
    updates = base.where("id % 5 = 0").select("id", F.lit(7).cast("long").alias("remote_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("remote_url"))
    return keyed.update_by_id(base, updates, "id", ["remote_id", "remote_url"])


@query("r10_decode_links", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a ' || event_type ELSE '' END AS links FROM events")
def r10(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(F.lit("a"), F.col("event_type")))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("[broken")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(registry.decode_links(text), " ").alias("links"))


@query(
    "r11_create_plan",
    """WITH n AS (SELECT p_partkey, 's' || p_partkey // 3 AS slug, p_partkey % 2 AS late, p_size FROM part), r AS (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS nth FROM n WHERE late = 1)
    SELECT p_partkey, CASE WHEN nth = 1 AND slug NOT IN (SELECT slug FROM n WHERE late = 0 AND p_size < 25) THEN 'created' ELSE 'rejected' END AS outcome FROM r""",
)
def r11(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("s"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("slug"), "p_size")
    there, new = rows.where("p_partkey % 2 = 0 and p_size < 25").select("slug").distinct(), rows.where("p_partkey % 2 = 1").drop("p_size")
    created, rejected = keyed.create(there, new, ["slug"], ["p_partkey"])
    return created.select("p_partkey", F.lit("created").alias("outcome")).unionByName(rejected.select("p_partkey", F.lit("rejected").alias("outcome")))


@query("r12_list_plans", "SELECT p_partkey AS series_slug, p_type AS skill, p_size AS month FROM part WHERE p_type = 'ECONOMY'")
def r12(spark, sf_dir):
    plans = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("series_slug"), F.col("p_type").alias("skill"), F.col("p_size").alias("month"))
    return registry.list_plans(plans, F.col("skill") == "ECONOMY")


@query(
    "r13_add_topic",
    """SELECT l_orderkey AS plan_id, l_linenumber AS week, o_orderkey IS NOT NULL AS accepted, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE 'tech-first' END AS direction, count(*) AS n
    FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def r13(spark, sf_dir):
    plans = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    topics = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("week"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("direction"), F.lit(None).cast("string").alias("status"))
    judged = keyed.has_parent(registry.with_defaults(topics), plans, "plan_id", "o_orderkey", "accepted")
    return judged.groupBy("plan_id", "week", "accepted", "direction").agg(F.count("*").alias("n"))


@query("r14_next_planned", "SELECT o_custkey AS plan_id, CAST(CAST(arg_min(o_orderdate, {'d': o_orderdate, 'k': o_orderkey}) AS DATE) AS VARCHAR) AS week, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def r14(spark, sf_dir):
    topics = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), F.to_date("o_orderdate").alias("week"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return registry.next_planned(topics, "plan_id", "week", "id", "O").select("plan_id", F.col("week").cast("string").alias("week"), "id")


@query(
    "r14_topic_block",
    """WITH n AS (SELECT o_custkey, arg_min(o, o) AS o FROM (SELECT o_custkey, {'d': o_orderdate, 'k': o_orderkey, 'p': o_orderpriority} AS o FROM orders WHERE o_orderstatus = 'O') GROUP BY 1)
    SELECT c_custkey AS plan_id, CASE WHEN o IS NULL THEN '' ELSE '=== 本期主題指引（editorial plan） ===' || chr(10) || '系列週次：W' || week(o.d) || chr(10) || '主題提示：' || o.p || chr(10) || '切入角度（angle）：' || c_mktsegment || chr(10) || '觀察視角（lens）：'
      || chr(10) || '方向：tech-first' || chr(10) || CASE WHEN o.k % 2 = 0 THEN '核心提問：why ' || o.k || '?' || chr(10) ELSE '' END
      || chr(10) || '請以上述主題提示和切入角度為本篇文章的主軸。從素材中選取與此角度相關的新聞，圍繞核心提問展開論述。' || chr(10) || chr(10) END AS block
    FROM customer LEFT JOIN n ON o_custkey = c_custkey""",
)
def r14_block(spark, sf_dir):
    """Every customer is a plan; some have no planned topic, none has a lens, and every other question is empty."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), F.to_date("o_orderdate").alias("day"), k.alias("id"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    topics = registry.with_defaults(registry.next_planned(orders, "plan_id", "day", "id", "O").withColumn("direction", F.lit(None).cast("string")))
    plans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plan_id"), "c_mktsegment").join(topics, "plan_id", "left")
    question = F.when(F.col("id") % 2 == 0, F.concat(F.lit("why "), F.col("id").cast("string"), F.lit("?"))).otherwise("")
    fields = [F.weekofyear("day").alias("week"), F.col("o_orderpriority").alias("title_hint"), F.col("c_mktsegment").alias("angle"), F.lit(None).cast("string").alias("lens"), "direction", question.alias("key_question")]
    return plans.select("plan_id", registry.topic_block(F.when(F.col("id").isNotNull(), F.struct(*fields))).alias("block"))


@query(
    "r15_transition",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'published' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 1 THEN 'skipped' WHEN o_orderstatus = 'O' THEN 'planned' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN o_custkey END AS history_id, 'topic' AS kind FROM orders
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'published' ELSE 'skipped' END, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, 'refused' FROM orders WHERE o_orderkey % 3 < 2 AND o_orderstatus <> 'O'""",
)
def r15(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    topics = orders.select(key.alias("id"), F.when(F.col("o_orderstatus") == "O", "planned").otherwise(F.col("o_orderstatus")).alias("status"), F.lit(None).cast("long").alias("history_id"))
    asked = orders.where("o_orderkey % 3 < 2").select(key.alias("id"), F.when(key % 3 == 0, "published").otherwise("skipped").alias("new_status"), F.when(key % 3 == 0, F.col("o_custkey")).alias("history_id"))
    moved, refused = keyed.transition(topics, asked, "id", "planned")
    return moved.withColumn("kind", F.lit("topic")).unionByName(refused.select("id", F.col("new_status").alias("status"), "history_id", F.lit("refused").alias("kind")))


SEVERAL = "CASE WHEN n % 3 = 0 THEN 2 + n % 2 ELSE 1 END"


def _changes(spark, sf_dir, name, number):
    """A change for each row of a table, and two or three for a third of them; ``seq`` is their order."""
    n = F.col(number)
    copies = F.when(n % 3 == 0, 2 + n % 2).otherwise(1).cast("int")
    return table(spark, sf_dir, name).withColumn("seq", F.explode(F.sequence(F.lit(1), copies)))


ENTITY_CHANGES = f"""WITH c AS (SELECT c_custkey AS n, * FROM customer), x AS (SELECT n, {SEVERAL} AS k, c_name, c_mktsegment FROM c)"""


@query(
    "r1_upsert_several_changes",
    f"""{ENTITY_CHANGES} SELECT n AS slug, CASE WHEN n % 2 = 0 THEN c_name || k ELSE c_name END AS name, CASE WHEN n % 2 = 0 THEN NULL ELSE 'p' END AS preview_text, CASE WHEN n % 5 = 0 THEN '{NEW}' ELSE '{OLD}' END AS created_at, CASE WHEN n % 2 = 0 THEN '{NEW}' ELSE '{OLD}' END AS updated_at
    FROM x WHERE n % 2 = 0 OR n % 5 <> 0""",
    dates=STAMPS,
)
def r1_several(spark, sf_dir):
    """The last of a key's changes counts, its preview goes; keys stay unique."""
    base = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), F.lit("p").alias("preview_text"), _day(OLD).alias("created_at"), _day(OLD).alias("updated_at"))
    batch = _changes(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("slug"), F.concat("c_name", F.col("seq").cast("string")).alias("name"), F.lit("q").alias("preview_text"), "seq")
    return keyed.upsert_entity(base, batch, "slug", _day(NEW), cleared=("preview_text",), order=["seq"])


@query(
    "r6_partial_update_several_changes",
    f"""{ENTITY_CHANGES} SELECT n AS slug, CASE WHEN n % 2 = 0 THEN 'name1' ELSE c_name END AS name, CASE WHEN n % 2 = 0 AND k > 1 THEN 'role' || k ELSE c_mktsegment END AS role, 0 AS rejected FROM x WHERE n % 5 <> 0
    UNION ALL SELECT n, NULL, NULL, k FROM x WHERE n % 5 = 0 AND n % 2 = 0""",
)
def r6_several(spark, sf_dir):
    """The first patch of a key sets its name, later ones its role: each field takes the last that is set."""
    base = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    text = F.col("seq").cast("string")
    patch = _changes(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("slug"), F.when(F.col("seq") == 1, F.concat(F.lit("name"), text)).alias("name"), F.when(F.col("seq") > 1, F.concat(F.lit("role"), text)).alias("role"), "seq")
    merged, rejected = keyed.partial_update(base, patch, "slug", ["seq"])
    none = F.lit(None).cast("string")
    refused = rejected.groupBy("slug").agg(F.count("*").cast("int").alias("rejected")).select("slug", none.alias("name"), none.alias("role"), "rejected")
    return merged.withColumn("rejected", F.lit(0)).unionByName(refused)


ORDER_CHANGES = f"WITH c AS (SELECT o_orderkey AS n, * FROM orders), x AS (SELECT *, {SEVERAL} AS k FROM c)"


@query("r9_update_by_id_several_changes", f"{ORDER_CHANGES} SELECT n AS id, CASE WHEN n % 5 = 0 THEN CASE WHEN k = 3 THEN NULL ELSE k END ELSE o_custkey END AS remote_id FROM x")
def r9_several(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("remote_id"))
    updates = _changes(spark, sf_dir, "orders", "o_orderkey").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("seq") < 3, F.col("seq").cast("long")).alias("remote_id"), "seq")
    return keyed.update_by_id(base, updates, "id", ["remote_id"], ["seq"])


@query(
    "r15_transition_several_requests",
    f"""{ORDER_CHANGES}, r AS (SELECT n, o_orderstatus, unnest(range(1, k + 1)) AS seq FROM x)
    SELECT n AS id, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN n % 2 = 0 THEN 'published' ELSE 'skipped' END ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN 10 * n + 1 END AS history_id, 'topic' AS kind FROM x
    UNION ALL SELECT n, CASE WHEN (n + seq) % 2 = 1 THEN 'published' ELSE 'skipped' END, 10 * n + seq, 'refused' FROM r WHERE o_orderstatus <> 'O' OR seq > 1""",
)
def r15_several(spark, sf_dir):
    """A planned topic moves by its first request; what comes after it is refused."""
    topics = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "planned").otherwise(F.col("o_orderstatus")).alias("status"), F.lit(None).cast("long").alias("history_id"))
    status = F.when((F.col("o_orderkey") + F.col("seq")) % 2 == 1, "published").otherwise("skipped")
    asked = _changes(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id"), status.alias("new_status"), (F.col("o_orderkey") * 10 + F.col("seq")).alias("history_id"), "seq")
    moved, refused = keyed.transition(topics, asked, "id", "planned", ["seq"])
    return moved.withColumn("kind", F.lit("topic")).unionByName(refused.select("id", F.col("new_status").alias("status"), "history_id", F.lit("refused").alias("kind")))


MOVES = [("planned", "published"), ("planned", "skipped"), ("skipped", "planned")]
GRANTED = " OR ".join(f"(s = '{a}' AND want = '{b}')" for a, b in MOVES)


@query(
    "r15_request_fold",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'published' WHEN 'view' THEN 'planned' ELSE 'skipped' END AS want, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, 0 AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS want, false AS granted, CASE user_id % 5 WHEN 0 THEN 'published' WHEN 1 THEN 'draft' ELSE 'planned' END AS s FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 7 <> 0
      UNION ALL SELECT e.user_id, e.i, e.event_id, f.s, e.want, ({GRANTED.replace("want", "e.want")}), CASE WHEN {GRANTED.replace("want", "e.want")} THEN e.want ELSE f.s END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, event_id, before, granted, s AS after FROM f WHERE i > 0 UNION ALL SELECT user_id, event_id, NULL, false, NULL FROM e WHERE user_id % 7 = 0
    UNION ALL SELECT user_id, NULL, NULL, NULL, s FROM f WHERE i = (SELECT max(i) FROM e WHERE e.user_id = f.user_id)""",
)
def r15_fold(spark, sf_dir):
    """A topic for each user, that can be skipped and planned again until it is published; each event is a request."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    begin = F.when(F.col("user_id") % 5 == 0, "published").when(F.col("user_id") % 5 == 1, "draft").otherwise("planned")
    rows = users.where("user_id % 7 <> 0").withColumn("status", begin)
    want = F.when(F.col("event_type") == "purchase", "published").when(F.col("event_type") == "view", "planned").otherwise("skipped")
    asked = table(spark, sf_dir, "events").select("user_id", "event_id", want.alias("new_status"))
    after, told = requests.fold(rows, asked, "user_id", ["event_id"], MOVES)
    none = lambda kind: F.lit(None).cast(kind)
    ends = after.select("user_id", none("long").alias("event_id"), none("string").alias("before"), none("boolean").alias("granted"), F.col("status").alias("after"))
    return told.select("user_id", "event_id", "before", "granted", "after").unionByName(ends)


@query(
    "r16_plan_with_topics",
    """WITH t AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS topics, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(n, 0) AS n_topics, coalesce(topics, '') AS topics FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""",
)
def r16(spark, sf_dir):
    plans = table(spark, sf_dir, "orders").select("o_orderkey")
    found = registry.plan_with_topics(plans, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey"])
    line = F.transform("topics", lambda t: F.concat_ws(":", t.l_linenumber.cast("string"), t.l_partkey.cast("string"), t.l_suppkey.cast("string")))
    return found.select("o_orderkey", F.size("topics").cast("long").alias("n_topics"), F.array_join(line, " ").alias("topics"))


@query(
    "r17_content_hash",
    """SELECT c_custkey, 'sha256:' || substr(sha256('{"antipatterns": null, "expression": "a \\"quoted\\" ' || c_mktsegment || '\\nsecond", "heuristics": null, "limits": null, "mental_models": null, "name": null, "role": "作家", "slug": "' || c_name || '"}'), 1, 16) AS hash FROM customer""",
)
def r17(spark, sf_dir):
    none = F.lit(None).cast("string")
    fields = dict.fromkeys(registry.HASHED, none) | {"slug": F.col("c_name"), "role": F.lit("作家"), "expression": F.concat(F.lit('a "quoted" '), F.col("c_mktsegment"), F.lit("\nsecond"))}
    return table(spark, sf_dir, "customer").select("c_custkey", registry.content_hash(fields).alias("hash"))


@query("r18_content_hash_any", """SELECT event_id, 'sha256:' || substr(sha256('{"a": "' || user_id || '", "type": "' || event_type || '"}'), 1, 16) AS hash FROM events""")
def r18(spark, sf_dir):
    entries = F.create_map(F.lit("type"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", registry.content_hash_any(entries).alias("hash"))


@query("r19_restore_layout", "SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'untitled' END AS title FROM customer")
def r19(spark, sf_dir):
    kind = F.col("c_custkey") % 3
    old = table(spark, sf_dir, "customer").select(F.when(kind == 0, F.col("c_name")).otherwise("").alias("title"), F.when(kind < 2, F.col("c_mktsegment")).alias("6"))
    return registry.restore_layout(old, {"title": ("title", "6", "untitled")})


@query("r20_table_counts", " UNION ALL ".join(f'SELECT \'{t}\' AS "table", count(*) AS n FROM {t}' for t in TABLES))
def r20(spark, sf_dir):
    return registry.table_counts({t: table(spark, sf_dir, t) for t in TABLES})


@query("r21_mask_value", "SELECT c_custkey, 'len=' || length(c_name) || ' prefix=' || left(c_name, 4) || '...' AS masked FROM customer")
def r21(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", registry.mask_value(F.col("c_name")).alias("masked"))


@query("r22_preview_state", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'stale' ELSE 'fresh' END AS state FROM orders")
def r22(spark, sf_dir):
    preview = F.when(F.col("o_orderstatus") != "P", F.lit("1998-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", registry.preview_state(F.col("o_orderdate"), preview).alias("state"))


@query("r23_preview_backlog", "SELECT lang, count(*) FILTER (quality IS NULL) AS pending, count(*) AS total FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY lang")
def r23(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return registry.preview_backlog(rows, "quality", "lang")


@query(
    "r24_scope_filter",
    "WITH a AS (SELECT n_nationkey AS actor, CASE WHEN n_nationkey < 2 THEN 'admin' ELSE 'author' END AS role FROM nation) SELECT c_custkey, c_nationkey AS owner, actor FROM customer JOIN a ON role = 'admin' OR actor = c_nationkey",
)
def r24(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("owner"))
    actors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("actor"), F.when(F.col("n_nationkey") < 2, "admin").otherwise("author").alias("role"))
    return registry.scope_filter(rows, actors, "owner")


@query("r24_scope_flags", "SELECT c_custkey, c_nationkey AS owner, CASE WHEN c_nationkey >= 2 THEN c_nationkey END AS actor, true AS admins FROM customer")
def r24_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("owner"))
    actors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("actor"), F.when(F.col("n_nationkey") < 2, "admin").otherwise("author").alias("role"))
    return registry.scope_flags(rows, actors, "owner")


@query("r25_page", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def r25(spark, sf_dir):
    found = registry.page(table(spark, sf_dir, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 50, 100)
    return found.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


PAGED = [("o_orderdate", True), ("o_orderkey", True)]


@query("r25_page_after", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def r25_after(spark, sf_dir):
    """The third page, each from the last row of the one before."""
    path = _folder(spark, "paged")
    registry.write_paged(table(spark, sf_dir, "orders"), path, PAGED)
    rows, last = spark.read.parquet(path), None
    for _ in range(2):
        found = registry.page_after(rows.select("o_orderdate", "o_orderkey"), PAGED, 50, last)
        ends = found.agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("last")).first()  # the last row of a page
        last = tuple(ends["last"]) if ends["last"] else last
    return registry.page_after(rows, PAGED, 50, last).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("r26_match_email", "SELECT c_custkey AS request_id, upper(c_name) AS email, c_custkey AS invite_id FROM customer WHERE c_custkey % 3 <> 0")
def r26(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    invites = rows.select(F.lower("c_name").alias("email"), F.col("c_custkey").alias("invite_id"), F.when(F.col("c_custkey") % 3 == 0, _day(OLD)).alias("used_at"))
    return registry.match_email(rows.select(F.col("c_custkey").alias("request_id"), F.upper("c_name").alias("email")), invites)


@query(
    "r27_audit_rows",
    """WITH b AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)
    SELECT c_custkey, CASE WHEN b.c_name IS NULL THEN 'create' WHEN a.c_name IS NULL THEN 'delete' ELSE 'update' END AS action,
    CASE WHEN b.c_name IS NULL THEN '{"c_name":"' || a.c_name || '","c_mktsegment":"' || a.c_mktsegment || '"}' WHEN a.c_name IS NULL THEN '{"c_name":"","c_mktsegment":""}' ELSE '{"c_name":"' || a.c_name || '"}' END AS diff_json
    FROM b FULL JOIN a USING (c_custkey) WHERE a.c_name IS DISTINCT FROM b.c_name""",
)
def r27(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    before = rows.where("c_custkey % 5 <> 0")
    after = rows.where("c_custkey % 7 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit("!"))).otherwise(F.col("c_name")))
    return keyed.audit(before, after, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "r27_audit_stored",
    """SELECT c_custkey, CASE c_custkey % 997 WHEN 1 THEN 'delete' WHEN 2 THEN 'create' ELSE 'update' END AS action,
    CASE c_custkey % 997 WHEN 1 THEN '{"c_name":"","c_mktsegment":""}' WHEN 2 THEN '{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' ELSE '{"c_name":"' || c_name || '!"}' END AS diff_json
    FROM customer WHERE c_custkey % 997 IN (1, 2, 3)""",
)
def r27_stored(spark, sf_dir):
    """Two stored versions that differ in a few rows: equal buckets aren't read."""
    rows, kind = table(spark, sf_dir, "customer"), F.col("c_custkey") % 997
    after = rows.where(kind != 1).withColumn("c_name", F.when(kind == 3, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    fields, paths = ["c_name", "c_mktsegment"], [_folder(spark, "version") for _ in range(2)]
    for version, path in zip((rows.where(kind != 2), after), paths, strict=True):
        keyed.store_bucketed(version, path, "c_custkey", fields, buckets=32)
    return keyed.audit_stored(spark, *paths, "c_custkey", fields)


@query(
    "r28_guarded_write",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'NEW' ELSE o_orderstatus END AS status, 'row' AS kind FROM orders UNION ALL SELECT o_orderkey, 'NEW', 'skipped' FROM orders WHERE o_orderkey % 4 = 2""",
)
def r28(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("updated_at"))
    seen = F.when(F.col("id") % 4 == 0, F.col("updated_at")).otherwise(F.date_sub("updated_at", 1))
    writes = base.where("id % 2 = 0").select("id", F.lit("NEW").alias("status"), seen.alias("updated_at"))
    applied, skipped = keyed.guarded_write(base, writes, "id", "updated_at", ["status"])
    return applied.select("id", "status", F.lit("row").alias("kind")).unionByName(skipped.select("id", "status", F.lit("skipped").alias("kind")))


@query(
    "r28_guarded_write_several_writes",
    f"""{ORDER_CHANGES}, r AS (SELECT n, k, unnest(range(1, k + 1)) AS seq FROM x)
    SELECT n AS id, CASE WHEN n % 4 = 0 OR k = 3 THEN 'NEW' || CASE WHEN n % 4 = 0 THEN 1 ELSE 2 END ELSE o_orderstatus END AS status, 'row' AS kind FROM x
    UNION ALL SELECT n, 'NEW' || seq, 'skipped' FROM r WHERE CASE WHEN n % 4 = 0 THEN seq > 1 WHEN k = 3 THEN seq <> 2 ELSE true END""",
)
def r28_several(spark, sf_dir):
    """Every write of each fourth row saw its version: the first wins.  Elsewhere the second of three did."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("updated_at"))
    n, seq, day = F.col("o_orderkey"), F.col("seq"), F.to_date("o_orderdate")
    three = (n % 3 == 0) & (n % 2 == 1)
    seen = F.when((n % 4 == 0) | (three & (seq == 2)), day).otherwise(F.date_sub(day, 1))
    writes = _changes(spark, sf_dir, "orders", "o_orderkey").select(n.alias("id"), F.concat(F.lit("NEW"), seq.cast("string")).alias("status"), seen.alias("updated_at"), "seq")
    applied, skipped = keyed.guarded_write(base, writes, "id", "updated_at", ["status"], ["seq"])
    return applied.select("id", "status", F.lit("row").alias("kind")).unionByName(skipped.select("id", "status", F.lit("skipped").alias("kind")))


@query(
    "r29_series_split",
    """WITH t AS (SELECT o_custkey AS owner, o_orderkey AS id, o_orderdate AS due, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'column' ELSE 'stream' END AS kind FROM orders WHERE o_orderstatus = 'O'),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY due, kind, id) AS n FROM t) SELECT owner, id, kind FROM r WHERE n = 1""",
)
def r29(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "planned").otherwise(F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due"), status.alias("status"), "o_orderpriority")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return registry.series_split(rows.where(urgent), rows.where(~urgent), "due").select("owner", "id", "kind")


def _folder(spark, name):
    return f"{shared_folder(spark)}/dawnframe/{name}-{uuid.uuid4().hex}"


@query("a6_dump_restore", "SELECT * FROM orders", dates=("o_orderdate",))
def a6(spark, sf_dir):
    rows, path = table(spark, sf_dir, "orders"), _folder(spark, "dump")
    logs.table_dump(rows, path, packed=True)
    return logs.restore(spark, path, rows.schema)


@query("a6_dump_all", " UNION ALL ".join(f'SELECT \'{t}\' AS "table", count(*) AS n, true AS intact FROM {t}' for t in TABLES))
def a6_all(spark, sf_dir):
    """All tables dumped, read back and compared with the manifest."""
    path = _folder(spark, "dump-all")
    logs.dump_all({t: table(spark, sf_dir, t) for t in TABLES}, path, packed=True)
    return logs.verify_dump(spark, path)


LOGGED = f"""WITH {CLOSES}, {LAST}, {EXTREMES} SELECT symbol, round(current_close, 2) AS close, round(hi.c, 2) AS high, CAST(hi.d AS VARCHAR) AS high_day, round(lo.c, 2) AS low, CAST(lo.d AS VARCHAR) AS low_day FROM x"""


def _log(spark, sf_dir):
    found = series.metrics(series.window_last_n(closes(spark, sf_dir)))
    line = logs.snapshot_line(F.lit("2024-01-15 08:00:00").cast("timestamp"), *[F.col(c) for c in ("symbol", "current_close", "high_close", "high_day", "low_close", "low_day")])
    path = _folder(spark, "log")
    logs.append_log(found.select(line.alias("value")), path)
    return spark.read.text(path)


@query(
    "a7_append_log",
    f"SELECT '2024-01-15 08:00:00  ' || symbol || ' close ' || printf('%.2f', close) || '  high ' || printf('%.2f', high) || '@' || high_day || '  low ' || printf('%.2f', low) || '@' || low_day AS value FROM ({LOGGED})",
)
def a7(spark, sf_dir):
    return _log(spark, sf_dir)


@query("a8_parse_log", LOGGED)
def a8(spark, sf_dir):
    found = logs.parse_log(_log(spark, sf_dir))
    return found.select("symbol", "close", "high", F.col("high_day").cast("string").alias("high_day"), "low", F.col("low_day").cast("string").alias("low_day"))


@query(
    "a9_validate_records",
    """WITH r AS (SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 11 = 0 THEN 'forbidden key' END, CASE WHEN c_custkey % 13 = 0 THEN 'unknown key' END, CASE WHEN c_custkey % 7 = 0 THEN 'bad slug' END,
      CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 'slug differs from its source' END, CASE WHEN c_acctbal < 0 THEN 'role is missing' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM customer)
    SELECT c_custkey, reasons = '' AS valid, reasons FROM r""",
)
def a9(spark, sf_dir):
    key = F.col("c_custkey")
    good = F.concat(F.lit("c-"), key.cast("string"))
    keys = F.array_compact(F.array(F.lit("slug"), F.lit("role"), F.when(key % 11 == 0, "secrets"), F.when(key % 13 == 0, "nickname")))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 7 == 0, F.upper(good)).otherwise(good).alias("slug"), F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_mktsegment")).alias("role"),
        keys.alias("keys"), F.when(key % 5 == 0, "other").otherwise(good).alias("stem"),
    )
    valid, rejected = logs.validate_records(rows, logs.record_rules(F.col("stem"), ["slug", "role", "name"]))
    both = valid.withColumn("reasons", F.array().cast("array<string>")).unionByName(rejected)
    return both.select("c_custkey", (F.size("reasons") == 0).alias("valid"), F.array_join("reasons", "; ").alias("reasons"))
