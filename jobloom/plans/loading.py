"""Queries of loading, change tracking and validation, over versions made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import load, stats
from jobloom.plans.base import query, sql_slug
from jobloom.plans.streams import scratch
from jobloom.sources import tables

NOW = "timestamp_ntz'2024-06-01 12:00:00'"
SQL_NOW = "TIMESTAMP '2024-06-01 12:00:00'"


def target(t):
    """Companies loaded before: two thirds of the table."""
    return t.raw("customer").where("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("country_id"), F.col("c_mktsegment").alias("url"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("created_at"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("updated_at"))


SQL_TARGET = "tgt AS (SELECT c_name AS name, c_nationkey AS country_id, c_mktsegment AS url, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at FROM customer WHERE c_custkey % 3 <> 0)"
SQL_UPDATES = "upd AS (SELECT c_name AS name, c_nationkey AS country_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'u' || c_custkey END AS url FROM customer WHERE c_custkey % 2 = 0)"


def updates(t):
    return t.raw("customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("country_id"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("u"), "c_custkey")).alias("url"))


def _upsert_sql(value: str) -> str:
    return f"""WITH {SQL_TARGET}, {SQL_UPDATES} SELECT coalesce(t.name, u.name) AS name, coalesce(t.country_id, u.country_id) AS country_id,
  CASE WHEN u.name IS NULL THEN t.url ELSE {value} END AS url, coalesce(t.created_at, {SQL_NOW}) AS created_at, CASE WHEN u.name IS NULL THEN t.updated_at ELSE {SQL_NOW} END AS updated_at
FROM tgt t FULL OUTER JOIN upd u ON t.name = u.name AND t.country_id = u.country_id"""


@query("upsert_companies", _upsert_sql("u.url"))
def _(t):
    return load.upsert(target(t), updates(t), ["name", "country_id"], ["url"], F.expr(NOW))


@query("latest_state", _upsert_sql("coalesce(u.url, t.url)"))
def _(t):
    return load.upsert(target(t), updates(t), ["name", "country_id"], ["url"], F.expr(NOW), keep_old=True)


@query("replace_positions", "SELECT id, company_id FROM position WHERE company_id % 5 <> 0 UNION ALL SELECT l_orderkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 = 0 AND l_linenumber = 1")
def _(t):
    new = t.raw("lineitem").where("l_linenumber = 1").join(t.raw("orders").where("o_custkey % 5 = 0"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("company_id"))
    gone = t.raw("orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"))
    kept = load.replace_by_key(t.position.select("id", "company_id"), new, "company_id")
    # companies whose new load is empty are in the run too
    return kept.join(gone.select("company_id").distinct().join(new.select("company_id"), "company_id", "left_anti"), "company_id", "left_anti")


FACTS = """facts AS (SELECT o_custkey AS company_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS english FROM orders GROUP BY 1),
snaps AS (SELECT company_id, total - 1 AS total, english, CASE WHEN company_id % 2 = 0 THEN TIMESTAMP '2024-06-01 03:00:00' ELSE TIMESTAMP '2024-05-31 23:00:00' END AS snapshotted_at FROM facts WHERE company_id % 3 = 0)"""


@query("snapshot_once", f"WITH {FACTS} SELECT * FROM snaps UNION ALL SELECT company_id, total, english, TIMESTAMP '2024-06-01' FROM facts WHERE company_id NOT IN (SELECT company_id FROM snaps WHERE CAST(snapshotted_at AS DATE) = DATE '2024-06-01')")
def _(t):
    facts = t.position.groupBy("company_id").agg(F.count("*").alias("total"), F.count_if(stats.english()).alias("english"))
    at = F.when(F.col("company_id") % 2 == 0, F.expr("timestamp_ntz'2024-06-01 03:00:00'")).otherwise(F.expr("timestamp_ntz'2024-05-31 23:00:00'"))
    snaps = facts.where("company_id % 3 = 0").withColumns({"total": F.col("total") - 1, "snapshotted_at": at})
    return load.snapshot_once(snaps, facts, ["company_id"], F.expr("date'2024-06-01'"))


@query("insert_ignore", "WITH a AS (SELECT l_suppkey AS k1, l_linenumber AS k2, min(l_partkey) AS v FROM lineitem GROUP BY ALL) SELECT k1, k2, CASE WHEN k1 % 4 = 0 THEN -1 ELSE v END AS v FROM a")
def _(t):
    x = t.raw("lineitem").select(F.col("l_suppkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("v"))
    old = x.where("k1 % 4 = 0").select("k1", "k2").distinct().withColumn("v", F.lit(-1).cast("long"))
    return load.insert_ignore(old, x, ["k1", "k2"])


@query("change_append", "SELECT change_id, entity_type, action FROM change UNION ALL SELECT -change_id, entity_type, NULL FROM change WHERE change_id % 9 = 0")
def _(t):
    new = t.change.where("change_id % 9 = 0").select((-F.col("change_id")).alias("change_id"), "entity_type")
    return load.append_changes(t.change.select("change_id", "entity_type", "action"), new)


CASCADE = "WITH gone AS (SELECT id FROM country WHERE region_id = 2), c AS (SELECT * FROM company WHERE country_id NOT IN (SELECT id FROM gone)), p AS (SELECT * FROM position WHERE company_id IN (SELECT id FROM c))"


@query("cascade_delete", CASCADE + " SELECT 'country' AS t, count(*) AS n FROM country WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'company', count(*) FROM c UNION ALL SELECT 'position', count(*) FROM p")
def _(t):
    tables = {"country": t.country, "company": t.company, "position": t.position}
    out = load.delete_cascade(tables, "country", t.country.where("region_id = 2").select("id"), {"country": [("company", "country_id")], "company": [("position", "company_id")]})
    n = [x.agg(F.lit(k).alias("t"), F.count("*").alias("n")) for k, x in out.items()]
    return n[0].unionByName(n[1]).unionByName(n[2])


PRUNE = """WITH tgt AS (SELECT DISTINCT c_mktsegment AS parent, c_nationkey AS child FROM customer), keep AS (SELECT DISTINCT c_mktsegment AS parent, c_nationkey AS child FROM customer WHERE c_nationkey % 2 = 0 AND c_mktsegment <> 'BUILDING'),
m AS (SELECT DISTINCT parent FROM keep) SELECT * FROM tgt WHERE parent NOT IN (SELECT parent FROM m) OR (parent, child) IN (SELECT parent, child FROM keep)"""


@query("prune_stale", PRUNE)
def _(t):
    tgt = t.raw("customer").select(F.col("c_mktsegment").alias("parent"), F.col("c_nationkey").alias("child")).distinct()
    return load.prune_children(tgt, tgt.select("parent"), tgt.where("child % 2 = 0 and parent <> 'BUILDING'"), "parent", "child").select("parent", "child")


PATCH = """WITH p AS (SELECT id, CASE WHEN id % 4 = 0 THEN '5-low' WHEN id % 4 = 1 THEN 'nope' END AS category_slug, CASE WHEN id % 6 = 0 THEN -1.0 END AS score FROM position WHERE id % 2 = 0 OR id % 4 = 1),
r AS (SELECT p.*, c.id AS cat FROM p LEFT JOIN category c ON c.slug = p.category_slug)"""


def _patches(t):
    k = F.col("id")
    return t.position.where("id % 2 = 0 or id % 4 = 1").select("id", F.when(k % 4 == 0, "5-low").when(k % 4 == 1, "nope").alias("category_slug"), F.when(k % 6 == 0, F.lit(-1.0)).alias("score"))


@query("patch_rows", PATCH + " SELECT x.id, coalesce(r.cat, x.category_id) AS category_id, coalesce(r.score, x.score) AS score FROM position x LEFT JOIN (SELECT * FROM r WHERE category_slug IS NULL OR cat IS NOT NULL) r ON r.id = x.id")
def _(t):
    return load.patch_rows(t.position.select("id", "category_id", "score"), _patches(t), "id", t.category)[0]


@query("patch_rejects", PATCH + " SELECT id, 'unknown_category' AS reason FROM r WHERE category_slug IS NOT NULL AND cat IS NULL")
def _(t):
    return load.patch_rows(t.position.select("id", "category_id", "score"), _patches(t), "id", t.category)[1]


@query("remap_dim", "SELECT CASE name WHEN '5-LOW' THEN '5-NONE' ELSE name END AS name, id FROM category UNION ALL SELECT 'support', 9")
def _(t):
    m = t.spark.createDataFrame([("5-LOW", "5-NONE"), ("x", "y")], "old string, new string")
    new = t.spark.createDataFrame([("support", 9), ("2-HIGH", 8)], "name string, id int")
    return load.remap_dim(t.category.select("name", "id"), m, new)


@query("flag_in", "SELECT p_partkey AS id, p_brand IN ('Brand#1', 'Brand#11', 'Brand#22') AS is_legacy FROM part")
def _(t):
    return load.flag_in(t.raw("part").select(F.col("p_partkey").alias("id"), "p_brand"), "p_brand", ["Brand#1", "Brand#11", "Brand#22"], "is_legacy").drop("p_brand")


@query("orphan_dim", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def _(t):
    return load.orphan_rows(t.raw("part", "p_partkey"), t.raw("lineitem").where("l_returnflag = 'A'"), "p_partkey", "l_partkey")


@query(
    "sitemap_rows",
    f"""WITH s AS (SELECT '/' AS path, '1.0' AS priority UNION ALL SELECT '/companies', '0.8' UNION ALL SELECT '/' || slug, '0.9' FROM country
UNION ALL SELECT DISTINCT '/company/' || {sql_slug("segment")}, '0.7' FROM company UNION ALL SELECT DISTINCT '/' || c.slug || '/' || {sql_slug("segment")}, '0.6' FROM company co JOIN country c ON c.id = co.country_id)
SELECT path, priority, '<url><loc>https://jobs.example.org' || path || '</loc><lastmod>2024-06-01</lastmod><priority>' || priority || '</priority></url>' AS line FROM s""",
)
def _(t):
    from jobloom.operators.sitemap import sitemap_rows

    return sitemap_rows(t.country, t.brand, "https://jobs.example.org", F.expr("date'2024-06-01'")).select("path", "priority", "line")


@query("replace_partitions", "SELECT id, company_id FROM position WHERE company_id % 5 <> 0 UNION ALL SELECT l_orderkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 = 0 AND l_linenumber = 1")
def _(t):
    """A table by buckets of the company; the load of some companies writes their buckets alone."""
    at = f"{scratch(t)}/positions"
    tables.replace_partitions(t.position.select("id", "company_id"), at, "company_id")
    new = t.raw("lineitem").where("l_linenumber = 1").join(t.raw("orders").where("o_custkey % 5 = 0"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("company_id"))
    tables.replace_partitions(new, at, "company_id", t.company.where("id % 5 = 0").select(F.col("id").alias("company_id")))
    return t.spark.read.parquet(at).select("id", "company_id")


@query("run_counters", f"SELECT unnest(['all', 'cached', 'not_tracked', 'required', 'welcome']) AS counter, unnest([count(*), count(*) FILTER ({{HIT}}), count(*) FILTER (p_size % 3 = 0), count(*) FILTER (p_brand = 'Brand#1'), count(*) FILTER (p_brand = 'Brand#2')]) AS n FROM part".replace("{HIT}", "p_size <= 14 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0"))
def _(t):
    """Counters of a run, gathered in the pass that writes its rows: cache hits, postings that are skipped, and phases."""
    jobs = t.raw("part").select(F.col("p_partkey").cast("string").alias("url"), F.lit("FI").alias("country_code"), F.left(F.md5(F.col("p_name").cast("binary")), F.lit(8)).alias("title_hash"), (F.col("p_size") % 3 != 0).alias("tracked"), "p_brand")
    hits = load.reuse_outcomes(jobs, _cache(t), F.expr(NOW), "v2").select("url", "hit")
    rows = jobs.join(hits, "url")
    counted = tables.write_counted(rows, f"{scratch(t)}/run", {"all": F.lit(True), "cached": F.col("hit"), "not_tracked": ~F.col("tracked"), "required": F.col("p_brand") == "Brand#1", "welcome": F.col("p_brand") == "Brand#2"})
    return t.spark.createDataFrame(list(counted.items()), "counter string, n long")


@query("run_report", "SELECT c.name AS country, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'P' THEN 'advantage' ELSE 'required' END AS status, o_orderpriority AS category, count(*) AS n FROM orders JOIN company co ON co.id = o_custkey JOIN country c ON c.id = co.country_id GROUP BY ALL")
def _(t):
    co = t.company.select(F.col("id").alias("company_id"), "country_id").join(t.country.select(F.col("id").alias("country_id"), F.col("name").alias("country")), "country_id")
    x = t.position.join(t.category.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id").join(co, "company_id")
    return stats.run_report(x, ["country", "category"])


@query(
    "nested_payload",
    """WITH d AS (SELECT company_id, count(*) AS total, string_agg(p.id || ':' || p.category_id || ':' || CASE WHEN p.id % 2 = 0 THEN CAST(CAST(floor(p.score) AS BIGINT) AS VARCHAR) ELSE '' END, ',' ORDER BY p.id) AS positions FROM position p GROUP BY 1)
SELECT c.id AS company_id, n.name AS country, CAST(coalesce(total, 0) AS INTEGER) AS total, coalesce(positions, '') AS positions FROM company c JOIN country n ON n.id = c.country_id LEFT JOIN d ON d.company_id = c.id""",
)
def _(t):
    co = t.company.join(t.country.select(F.col("id").alias("country_id"), F.col("name").alias("country")), "country_id")
    p = t.position.withColumn("score", F.when(F.col("id") % 2 == 0, F.floor("score")))
    x = load.nested_upload(co, p, ["category_id", "score"])
    one = lambda r: F.concat_ws(":", r["id"].cast("string"), r["category_id"].cast("string"), F.coalesce(r["score"].cast("string"), F.lit("")))
    return x.withColumn("positions", F.array_join(F.transform("positions", one), ","))


# -- incremental runs ------------------------------------------------------------------------------------------------------

CACHE = """cache AS (SELECT p_partkey % 500 AS pk, left(md5(CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_name END), 8) AS h, CASE WHEN p_partkey % 11 = 0 THEN 'v1' ELSE 'v2' END AS v, TIMESTAMP '2024-06-01 12:00:00' - to_days(CAST(p_size AS INTEGER)) AS at, p_partkey FROM part)"""
HIT = f"(p_size <= 14 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0)"


def _cache(t):
    k = F.col("p_partkey")
    return t.raw("part").select(k.cast("string").alias("url"), F.lit("FI").alias("country_code"), F.left(F.md5(F.when(k % 7 == 0, "x").otherwise(F.col("p_name")).cast("binary")), F.lit(8)).alias("title_hash"), F.when(k % 11 == 0, "v1").otherwise("v2").alias("version"), F.expr(f"{NOW} - make_dt_interval(p_size)").alias("cached_at"), F.col("p_type").alias("outcome"))


@query("cache_lookup", f"SELECT CAST(p_partkey AS VARCHAR) AS url, {HIT} AS hit, CASE WHEN {HIT} THEN p_type END AS outcome FROM part")
def _(t):
    jobs = t.raw("part").select(F.col("p_partkey").cast("string").alias("url"), F.lit("FI").alias("country_code"), F.left(F.md5(F.col("p_name").cast("binary")), F.lit(8)).alias("title_hash"))
    return load.reuse_outcomes(jobs, _cache(t), F.expr(NOW), "v2").select("url", "hit", "outcome")


@query("cached_urls", "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS url FROM part WHERE p_size <= 14")
def _(t):
    return load.cached_urls(_cache(t), F.expr(NOW))


LOADS = """WITH a AS (SELECT l_suppkey AS k, count(*) AS n, sum(l_linenumber) AS s FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS l_suppkey, a.n AS before_rows, b.n AS after_rows, CASE WHEN a.k IS NULL THEN 'created' WHEN b.k IS NULL THEN 'deleted' WHEN b.k % 3 = 0 THEN 'updated' ELSE 'none' END AS action FROM a FULL OUTER JOIN b ON a.k = b.k"""


@query("load_changes", LOADS)
def _(t):
    x = t.raw("lineitem", "l_suppkey", "l_orderkey", "l_linenumber")
    after = x.where("l_suppkey % 4 <> 0").withColumn("l_linenumber", F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")))
    return load.load_changes(x.where("l_suppkey % 5 <> 0"), after, "l_suppkey", ["l_orderkey", "l_linenumber"]).select("l_suppkey", "before_rows", "after_rows", "action")


def _builds(t):
    k = F.col("event_id")
    state = F.when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "click", "building").otherwise("error")
    return t.raw("events").select(k.alias("build_id"), state.alias("state"), F.col("ts").alias("created_at"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"))


@query(
    "publish_state",
    """WITH b AS (SELECT event_id AS build_id, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'click' THEN 'building' ELSE 'error' END AS state, ts FROM events), l AS (SELECT * FROM b ORDER BY ts DESC, build_id DESC LIMIT 5)
SELECT (SELECT coalesce(arg_max(ts, (ts, build_id)), TIMESTAMP '2020-01-01') FROM b WHERE state = 'ready') AS since, (SELECT coalesce(bool_or(state = 'building' AND ts >= TIMESTAMP '1990-01-01'), false) FROM l) AS in_flight""",
)
def _(t):
    return load.publish_state(_builds(t), F.expr("timestamp_ntz'1990-01-01 00:25:00'"), F.expr("timestamp_ntz'2020-01-01 00:00:00'"))


@query("map_events", "SELECT event_id AS build_id, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'click' THEN 'building' ELSE 'error' END AS state, CASE WHEN event_type = 'click' THEN ts END AS started_at, CASE WHEN event_type <> 'click' THEN ts END AS finished_at FROM events WHERE event_id % 3 <> 0 AND event_type IN ('purchase', 'click', 'view')")
def _(t):
    raw = F.when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "click", "enqueued").when(F.col("event_type") == "view", "failed").otherwise("unknown")
    x = t.raw("events").select(F.col("event_id").alias("id"), raw.alias("raw_state"), F.when(F.col("event_id") % 3 == 0, "preview").otherwise("production").alias("context"), F.col("ts").alias("at"))
    return load.map_events(x)


# -- validation -------------------------------------------------------------------------------------------------------------


def rules():
    return {"balance": F.col("c_acctbal") >= 0, "name": F.length(F.trim("c_name")) > 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}


BROKEN = "concat_ws('|', CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT length(trim(c_name)) > 0 THEN 'name' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END)"


@query("violations", f"SELECT c_custkey, {BROKEN} AS violations FROM customer")
def _(t):
    return t.raw("customer").select("c_custkey", F.array_join(load.violations(rules()), "|").alias("violations"))


@query("split_valid", f"SELECT c_custkey FROM customer WHERE {BROKEN} = ''")
def _(t):
    return load.split_valid(t.raw("customer"), rules())[0].select("c_custkey")


@query("apply_defaults", "SELECT c_custkey, c_custkey % 2 = 0 AS flag, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS tags FROM customer")
def _(t):
    k = F.col("c_custkey")
    x = t.raw("customer").select(k, F.when(k % 2 == 0, True).alias("flag"), F.when(k % 3 != 0, F.array("c_name")).alias("tags"))
    return load.apply_defaults(x).withColumn("tags", F.array_join("tags", "|"))


@query(
    "audit",
    """SELECT 'unique lineitem(l_orderkey)' AS constraint, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'not_null customer.c_name', count(*) FILTER (WHERE c_name IS NULL) FROM customer
UNION ALL SELECT 'foreign orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'enum orders.o_orderstatus', count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) FROM orders""",
)
def _(t):
    tables = {"lineitem": t.raw("lineitem", "l_orderkey"), "customer": t.raw("customer"), "orders": t.raw("orders"), "good": t.raw("customer").where("c_acctbal > 0")}
    return load.audit(tables, [("lineitem", ["l_orderkey"])], [("customer", "c_name")], [("orders", "o_custkey", "good", "c_custkey")], [("orders", "o_orderstatus", ["O", "F"])])
