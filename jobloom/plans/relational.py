"""Queries of the relational core: aggregates, joins, filters, windows, shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import shape, stats
from jobloom.operators.load import duplicate_report
from jobloom.plans.base import query, sql_share, sql_slug

# -- aggregates --------------------------------------------------------------------------------------------------------

COUNTRY_STATS = f"""SELECT c.id AS country_id, c.name, c.slug, c.sort_order, count(p.id) AS total_positions,
  count(p.id) FILTER (WHERE NOT p.requires_native_language) AS english_positions,
  {sql_share("count(p.id) FILTER (WHERE NOT p.requires_native_language)", "count(p.id)", 1)} AS english_percentage, max(co.updated_at) AS last_updated
FROM country c LEFT JOIN company co ON co.country_id = c.id LEFT JOIN position p ON p.company_id = co.id GROUP BY ALL"""


@query("country_stats", COUNTRY_STATS)
def _(t):
    return stats.country_stats(t.country, t.company, t.position)


@query("country_stats_sorted", COUNTRY_STATS + " ORDER BY english_percentage DESC NULLS LAST, c.name")
def _(t):
    return stats.country_stats(t.country, t.company, t.position).orderBy(F.desc_nulls_last("english_percentage"), "name")


@query(
    "company_stats",
    f"""SELECT co.id AS company_id, co.name, co.country_id, co.updated_at, count(p.id) AS total_positions,
  count(p.id) FILTER (WHERE NOT p.requires_native_language) AS english_positions,
  {sql_share("count(p.id) FILTER (WHERE NOT p.requires_native_language)", "count(p.id)", 1)} AS english_percentage,
  array_to_string(list_sort(array_agg(DISTINCT cat.name) FILTER (WHERE cat.name IS NOT NULL)), '|') AS categories
FROM company co LEFT JOIN position p ON p.company_id = co.id LEFT JOIN category cat ON cat.id = p.category_id GROUP BY ALL""",
)
def _(t):
    return stats.company_stats(t.company, t.position, t.category).withColumn("categories", F.array_join("categories", "|"))


@query("distinct_companies", "SELECT count(DISTINCT name) AS n_companies FROM brand")
def _(t):
    return stats.count_distinct_companies(t.brand)


PAIRS = """pairs AS (SELECT co.name, co.country_id, c.slug AS country_slug, count(p.id) AS total,
  count(p.id) FILTER (WHERE NOT p.requires_native_language) AS english
  FROM brand co JOIN country c ON c.id = co.country_id LEFT JOIN position p ON p.company_id = co.id GROUP BY ALL)"""
BEST = ", best AS (SELECT name, country_slug FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY english DESC, country_slug) AS rn FROM pairs) WHERE rn = 1)"


@query(
    "top_companies",
    f"""WITH {PAIRS}{BEST}, g AS (SELECT name, CAST(sum(total) AS BIGINT) AS total_positions, CAST(sum(english) AS BIGINT) AS english_positions, count(*) AS country_count
  FROM pairs GROUP BY name ORDER BY english_positions DESC, name LIMIT 5)
SELECT g.name, total_positions, english_positions, country_count, {sql_share("english_positions", "total_positions")} AS english_percentage, country_slug AS primary_country_slug FROM g JOIN best USING (name)""",
)
def _(t):
    return stats.top_companies(t.brand, t.country, t.position, 5)


@query("best_country", f"WITH {PAIRS}{BEST} SELECT * FROM best")
def _(t):
    return stats.best_country(stats.per_company_country(t.brand, t.country, t.position)).select("name", "country_slug")


@query(
    "global_stats",
    f"""WITH p AS (SELECT count(*) AS total_positions, count(*) FILTER (WHERE NOT requires_native_language) AS english_positions FROM position)
SELECT (SELECT count(*) FROM country) AS n_countries, (SELECT count(DISTINCT name) FROM company) AS n_companies, total_positions, english_positions,
  {sql_share("english_positions", "total_positions")} AS english_percentage FROM p""",
)
def _(t):
    return stats.global_stats(t.country, t.company, t.position)


def _breakdown(by: str) -> str:
    return f"""SELECT {by}, cat.name AS category, count(p.id) AS total_positions, count(p.id) FILTER (WHERE NOT p.requires_native_language) AS english_positions,
  {sql_share("count(p.id) FILTER (WHERE NOT p.requires_native_language)", "count(p.id)")} AS english_percentage
FROM position p JOIN category cat ON cat.id = p.category_id JOIN company co ON co.id = p.company_id GROUP BY ALL"""


@query("category_breakdown_country", _breakdown("co.country_id"))
def _(t):
    co = t.company.select(F.col("id").alias("company_id"), "country_id")
    return stats.category_breakdown(t.position.join(co, "company_id"), t.category, ["country_id"]).orderBy("country_id", F.desc("english_positions"), "category")


@query("category_breakdown_company", _breakdown("p.company_id"))
def _(t):
    return stats.category_breakdown(t.position, t.category, ["company_id"])


@query("company_counts", "SELECT country_id, count(*) AS n_companies FROM company GROUP BY 1")
def _(t):
    return stats.company_counts(t.company)


@query(
    "company_profile_totals",
    f"""WITH {PAIRS}, u AS (SELECT name, max(updated_at) AS updated_at FROM brand GROUP BY 1)
SELECT name, CAST(sum(total) AS BIGINT) AS total_positions, CAST(sum(english) AS BIGINT) AS english_positions, max(u.updated_at) AS updated_at FROM pairs JOIN u USING (name) GROUP BY name""",
)
def _(t):
    return stats.company_profile(t.brand, t.country, t.position).drop("countries")


@query(
    "company_profile_nested",
    f"""WITH {PAIRS} SELECT name, string_agg(country_slug || ':' || total || ':' || english, '|' ORDER BY english DESC, country_slug) AS countries FROM pairs GROUP BY name""",
)
def _(t):
    x = stats.company_profile(t.brand, t.country, t.position)
    return x.select("name", F.array_join(F.transform("countries", lambda e: F.concat_ws(":", e["slug"], e["total"], e["english"])), "|").alias("countries"))


@query("group_rows", "SELECT company_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY extracted_at, id) AS rows FROM position GROUP BY 1")
def _(t):
    p = t.position.withColumn("at", F.struct("extracted_at", "id"))
    return stats.group_rows(p, "company_id", "at", "id").select("company_id", F.array_join("rows", ",").alias("rows"))


@query(
    "rollup_by_name",
    """WITH r AS (SELECT b.name, b.id AS ord, b.updated_at, count(p.id) AS total, count(p.id) FILTER (WHERE NOT p.requires_native_language) AS english,
    CASE WHEN b.id % 3 <> 0 THEN 'https://example.org/' || b.id END AS url FROM brand b LEFT JOIN position p ON p.company_id = b.id GROUP BY ALL)
SELECT name, CAST(sum(total) AS BIGINT) AS total, CAST(sum(english) AS BIGINT) AS english, max(updated_at) AS updated_at, arg_min(url, ord) FILTER (WHERE url IS NOT NULL) AS url, count(*) AS members FROM r GROUP BY name""",
)
def _(t):
    return stats.rollup_by_name(_company_rows(t))


def _company_rows(t):
    p = t.position.groupBy("company_id").agg(F.count("id").alias("total"), F.count_if(stats.english()).alias("english"))
    x = t.brand.withColumnRenamed("id", "ord").join(p, F.col("ord") == F.col("company_id"), "left")
    url = F.when(F.col("ord") % 3 != 0, F.concat(F.lit("https://example.org/"), F.col("ord")))
    return x.select("name", "ord", "updated_at", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("english", F.lit(0)).alias("english"), url.alias("url"), F.col("country_id").alias("country"))


@query(
    "country_totals",
    """SELECT b.country_id AS country, count(p.id) AS total, count(p.id) FILTER (WHERE NOT p.requires_native_language) AS english, count(DISTINCT b.id) AS companies
FROM brand b LEFT JOIN position p ON p.company_id = b.id GROUP BY 1""",
)
def _(t):
    return stats.country_totals(_company_rows(t))


@query(
    "skill_snapshot",
    """WITH sk AS (SELECT s AS name, row_number() OVER (ORDER BY s) AS id FROM (SELECT DISTINCT p_type AS s FROM part) WHERE s NOT LIKE '%BRASS%'),
l AS (SELECT CAST(l_shipdate AS DATE) AS captured_at, l_suppkey AS company_id, s_nationkey AS country_id, l_returnflag AS category, p_type AS skill
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
SELECT captured_at, company_id, country_id, CASE WHEN category IN ('A', 'N') THEN category ELSE 'other' END AS category, sk.id AS skill_id, count(*) AS position_count
FROM l JOIN sk ON sk.name = l.skill GROUP BY ALL""",
)
def _(t):
    sup = t.raw("supplier").select("s_suppkey", F.col("s_nationkey").alias("country_id"))
    part = t.raw("part").select("p_partkey", "p_type")
    x = t.raw("lineitem", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    x = x.select(F.col("l_suppkey").alias("company_id"), "country_id", F.col("l_returnflag").alias("category"), F.array("p_type").alias("skills"), "l_shipdate")
    names = part.select(F.col("p_type").alias("name")).distinct().where("name not like '%BRASS%'")
    skills = stats.ranked(names, [F.asc("name")], 10_000).withColumn("id", F.col("rank").cast("long"))
    cats = t.spark.createDataFrame([("A",), ("N",)], "name string")
    return stats.skill_snapshot(x, skills, cats, F.to_date("l_shipdate"))


NET = """WITH n AS (SELECT entity_type, entity_id, arg_min_null(before_state, {at}) AS before, arg_max_null(after_state, {at}) AS after, count(*) AS n_changes FROM change GROUP BY ALL),
a AS (SELECT *, CASE WHEN before IS NOT DISTINCT FROM after THEN 'none' WHEN before IS NULL THEN 'created' WHEN after IS NULL THEN 'deleted' ELSE 'updated' END AS action FROM n)""".format(at="(changed_at, change_id)")


@query("net_changes", NET + " SELECT * FROM a")
def _(t):
    return stats.net_changes(t.change)


@query("change_counts", NET + " SELECT entity_type, action, count(*) AS n FROM a WHERE action <> 'none' GROUP BY ALL")
def _(t):
    return stats.change_counts(stats.net_changes(t.change).where("action <> 'none'"))


@query("net_actions", "SELECT entity_type, entity_id, bool_or(action = 'created') AS created_in_window, arg_max(action, (changed_at, change_id)) AS last_action FROM change GROUP BY ALL")
def _(t):
    return stats.net_actions(t.change)


@query(
    "run_quality",
    """WITH r AS (SELECT s_suppkey AS source, l.l_orderkey, s_nationkey AS country, s_suppkey % 5 * 200 AS min_positions FROM supplier LEFT JOIN lineitem l ON l_suppkey = s_suppkey AND l_returnflag = 'R')
SELECT source, count(l_orderkey) AS positions, count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN country END) AS n_countries, min_positions,
  CASE WHEN count(l_orderkey) = 0 AND min_positions = 0 THEN 'warning' WHEN count(l_orderkey) < min_positions THEN 'fail' ELSE 'ok' END AS status FROM r GROUP BY source, min_positions""",
)
def _(t):
    s = t.raw("supplier").select(F.col("s_suppkey").alias("source"), "s_nationkey", (F.col("s_suppkey") % 5 * 200).alias("min_positions"))
    found = t.raw("lineitem", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'").withColumnRenamed("l_suppkey", "source").join(s.select("source", F.col("s_nationkey").alias("country")), "source")
    return stats.run_quality(found, s.drop("s_nationkey"))


@query(
    "strict_majority",
    """WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS total, max(n) AS top FROM v GROUP BY 1)
SELECT v.user_id, v.event_type, v.n AS votes, CAST(t.total AS BIGINT) AS total FROM v JOIN t USING (user_id) WHERE 2 * v.n > t.total""",
)
def _(t):
    return stats.strict_majority(t.raw("events", "user_id", "event_type"), "user_id", "event_type")


@query(
    "allocate_dims",
    """WITH d AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 25), n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part)
SELECT name, (SELECT max(sort_order) FROM country) + CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS sort_order FROM n WHERE name NOT IN (SELECT name FROM country)""",
)
def _(t):
    p = t.raw("part", "p_type", "p_brand")
    return stats.allocate_dims(t.country, p.select(F.col("p_type").alias("name")).unionByName(p.select(F.col("p_brand").alias("name"))))


# -- windows, order, limits ---------------------------------------------------------------------------------------------


@query("keep_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def _(t):
    return stats.keep_first(t.raw("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("duplicate_report", "SELECT l_orderkey, count(*) AS n, count(*) - 1 AS removed FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return duplicate_report(t.raw("lineitem", "l_orderkey"), ["l_orderkey"])


@query(
    "top_countries",
    f"""WITH s AS ({COUNTRY_STATS}) SELECT country_id, name, english_positions, CAST(row_number() OVER (ORDER BY english_positions DESC, name) AS INTEGER) AS rank FROM s ORDER BY english_positions DESC, name LIMIT 5""",
)
def _(t):
    s = stats.country_stats(t.country, t.company, t.position).select("country_id", "name", "english_positions")
    return stats.ranked(s, [F.desc("english_positions"), F.asc("name")], 5)


@query("latest_rows", "SELECT change_id, entity_type, changed_at FROM change WHERE action = 'created' ORDER BY changed_at DESC, change_id DESC LIMIT 5")
def _(t):
    return stats.latest(t.change, 5, [F.desc("changed_at"), F.desc("change_id")], F.col("action") == "created").select("change_id", "entity_type", "changed_at")


@query("sort_grid", "SELECT id, name, country_id FROM company ORDER BY name DESC, id")
def _(t):
    return stats.sort_grid(t.company.select("id", "name", "country_id"), "name", True)


@query("slice_of", "SELECT id, name FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS no FROM company) WHERE no % 4 = 1")
def _(t):
    return stats.slice_of(t.company.select("id", "name"), "id", 1, 4)


@query("slice_of_ties", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, o_orderkey) - 1 AS no FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 2 END AS k FROM orders)) WHERE no % 5 = 2")
def _(t):
    # null keys and two keys that hold a third of the rows each
    k = t.raw("orders", "o_orderkey", "o_custkey").withColumn("k", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 2))
    return stats.slice_of(k, "k", 2, 5, ["o_orderkey"]).drop("k")


@query("page_assign", "SELECT id, company_id, CAST((row_number() OVER (ORDER BY id) - 1) // 1000 AS BIGINT) AS page FROM position")
def _(t):
    return stats.with_page(t.position.select("id", "company_id"), "id", 1000)


@query("scan_sorted_dim", "SELECT id, name, slug, sort_order FROM country ORDER BY sort_order")
def _(t):
    return t.country.select("id", "name", "slug", "sort_order").orderBy("sort_order")


# -- filters and joins -----------------------------------------------------------------------------------------------------


@query(
    "position_detail",
    """SELECT p.id, p.company_id, coalesce(c.name, 'Other') AS category_name, coalesce(requires_native_language, false) AS requires_native_language, coalesce(local_language_advantage, false) AS local_language_advantage
FROM position p LEFT JOIN (SELECT * FROM category WHERE id <> 5) c ON c.id = p.category_id""",
)
def _(t):
    x = shape.position_detail(t.position, t.category.where("id <> 5"))
    return x.select("id", "company_id", "category_name", "requires_native_language", "local_language_advantage")


@query("english_only", "SELECT id, company_id FROM position WHERE NOT requires_native_language")
def _(t):
    return t.position.where(stats.english()).select("id", "company_id")


@query("by_slug", "SELECT id, name, slug FROM country WHERE slug = 'nation-7' OR slug = 'germany'")
def _(t):
    names = t.country.select("id", "name", "slug")
    return shape.by_slug(names, "nation-7").unionByName(shape.by_slug(names, "germany")).unionByName(shape.by_slug(names, "Not a slug"))


@query("semi_in", "SELECT id, company_id FROM position WHERE company_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    return shape.where_in(t.position.select("id", "company_id"), "company_id", t.raw("customer").where("c_acctbal < 0").select("c_custkey"))


@query("search_name", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring')")
def _(t):
    return shape.search_name(t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), " RING ")


@query("search_any", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_type), 'small') OR contains(lower(p_brand), 'small')")
def _(t):
    x = t.raw("part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", F.array("p_brand").alias("tags"))
    return shape.search_any(x, "small", ["p_name", "p_type"], ["tags"]).select("id")


@query("lang_status", "SELECT id, CASE o_orderstatus WHEN 'O' THEN 'neither' ELSE 'required' END AS status FROM position JOIN orders ON o_orderkey = id")
def _(t):
    return t.position.select("id", shape.lang_status().alias("status"))


TRACKED = "tracked AS (SELECT * FROM country WHERE region_id IN (1, 3))"


@query("split_tracked", f"WITH {TRACKED} SELECT co.id, co.country_id FROM company co WHERE country_id IN (SELECT id FROM tracked)")
def _(t):
    x, _counts = shape.split_tracked(t.company.select("id", F.col("country_id").alias("country_code")), t.country.where("region_id in (1, 3)").select("id"))
    return x.select("id", F.col("country_code").alias("country_id"))


@query(
    "tracked_counters",
    f"""WITH {TRACKED}, c AS (SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE country_id END AS code FROM company)
SELECT count(*) FILTER (WHERE code IN (SELECT id FROM tracked)) AS tracked, count(*) FILTER (WHERE code IS NULL) AS skipped_unknown,
  count(*) FILTER (WHERE code IS NOT NULL AND code NOT IN (SELECT id FROM tracked)) AS skipped_untracked FROM c""",
)
def _(t):
    x = t.company.select("id", F.when(F.col("id") % 10 != 0, F.col("country_id")).alias("country_code"))
    return shape.split_tracked(x, t.country.where("region_id in (1, 3)").select("id"))[1]


@query(
    "enrichment_targets",
    """SELECT page_id, url FROM pages WHERE url IS NOT NULL AND NOT regexp_matches(regexp_extract(html, '<title>([^<]*)</title>', 1), '[À-ÖØ-öø-ɏͰ-ӿ]')
  AND NOT contains(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'und ') AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)""",
)
def _(t):
    from jobloom.functions.columns import looks_non_english

    p = t.raw("pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("").alias("description"))
    return shape.enrichment_targets(p, t.raw("pages").where("page_id % 2 = 0"), looks_non_english(F.col("title"), ["und "])).select("page_id", "url")


@query("drop_gone", "SELECT id FROM position WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    return shape.drop_gone(t.position.select("id"), t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "id")


RULES = [("blog.", "blog"), ("m.", "mobile"), (".org", "org"), ("example", "site")]


@query("match_rules", "SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(url), '{a}') THEN '{b}'" for a, b in RULES) + " END AS rule FROM pages")
def _(t):
    return t.raw("pages").select("page_id", shape.match_rules(RULES, "url").alias("rule"))


@query("positions_in_country", "SELECT p.id, p.company_id, co.name AS company FROM position p JOIN company co ON co.id = p.company_id WHERE co.country_id = 7")
def _(t):
    return shape.positions_in_country(t.position.select("id", "company_id"), t.company, 7)


@query(
    "admin_positions",
    """SELECT p.id, coalesce(co.name, '—') AS company, coalesce(c.name, '—') AS country FROM position p LEFT JOIN company co ON co.id = p.company_id AND co.id % 11 <> 0 LEFT JOIN country c ON c.id = co.country_id""",
)
def _(t):
    return shape.admin_positions(t.position.select("id", "company_id"), t.company.where("id % 11 <> 0"), t.country).select("id", "company", "country")


@query(
    "resolve_keys",
    f"SELECT l.l_orderkey AS id, l.l_linenumber AS n, coalesce(c.id, (SELECT id FROM category WHERE slug = '5-low')) AS category_id FROM lineitem l LEFT JOIN category c ON c.slug = {sql_slug('l.l_returnflag')} || '-urgent'",
)
def _(t):
    x = t.raw("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.concat(F.lower("l_returnflag"), F.lit("-urgent")).alias("category"))
    return shape.resolve_keys(x, t.category, "5-low").select("id", "n", "category_id")


@query(
    "merge_sources",
    """WITH s AS (SELECT o_custkey AS id, CASE WHEN count(*) > 12 THEN NULL ELSE max(o_orderpriority) END AS segment, CAST(count(*) AS DOUBLE) AS balance FROM orders GROUP BY 1)
SELECT coalesce(s.id, c.c_custkey) AS id, coalesce(s.segment, c.c_mktsegment) AS segment, coalesce(s.balance, c.c_acctbal) AS balance
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c FULL OUTER JOIN s ON s.id = c.c_custkey""",
)
def _(t):
    p = t.raw("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    n = F.count("*")
    s = t.raw("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.when(n > 12, None).otherwise(F.max("o_orderpriority")).alias("segment"), n.cast("double").alias("balance"))
    return shape.merge_sources(p, s, "id")


@query(
    "enrich_join",
    """WITH d AS (SELECT l_partkey AS url, arg_min_null(l_returnflag, (l_orderkey, l_linenumber)) AS f, arg_min_null(l_linestatus, (l_orderkey, l_linenumber)) AS city, arg_min_null(CAST(l_linenumber AS VARCHAR), (l_orderkey, l_linenumber)) AS extra FROM lineitem GROUP BY 1)
SELECT p_partkey AS url, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, d.f) AS function,
  concat_ws('|', d.city, CASE WHEN p_type IS DISTINCT FROM d.city THEN p_type END) AS cities, concat_ws(chr(10), p_name, d.extra) AS description
FROM part LEFT JOIN d ON d.url = p_partkey""",
)
def _(t):
    jobs = t.raw("part").select(F.col("p_partkey").alias("url"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("function"), F.array("p_type").alias("cities"), F.col("p_name").alias("description"))
    # null keys come last; of lines that are equal in both keys the first of the table counts
    first = F.struct(F.isnull("l_orderkey"), "l_orderkey", F.isnull("l_linenumber"), "l_linenumber", "_metadata.file_path", "_metadata.row_index")
    d = t.raw("lineitem").select(F.col("l_partkey").alias("url"), F.col("l_returnflag").alias("function"), F.col("l_linestatus").alias("city"), F.col("l_linenumber").cast("string").alias("extra"), first.alias("ord"))
    return shape.enrich(jobs, d).withColumn("cities", F.array_join("cities", "|"))


# -- unions and fan-outs ---------------------------------------------------------------------------------------------------

CITIES = [("Berlin", "DE"), ("Hamburg", "DE"), ("Paris", "FR"), ("Lyon", "FR"), ("Madrid", "ES")]
SQL_CITIES = "cities AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CITIES) + ") v(city, code))"


def cities(t):
    return t.spark.createDataFrame(CITIES, "city string, code string")


#: A location text for each supplier, from packaged cities by its key.
LOC = "(['Berlin','Paris or Hamburg','Lyon/Madrid','Nowhere','Hamburg or Berlin/Paris'])[CAST(s_suppkey % 5 AS INTEGER) + 1]"


def loc(t):
    names = F.array(*[F.lit(x) for x in ("Berlin", "Paris or Hamburg", "Lyon/Madrid", "Nowhere", "Hamburg or Berlin/Paris")])
    return t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("location"))


@query(
    "fan_out_text",
    f"""WITH {SQL_CITIES}, p AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, regexp_split_to_array({LOC}, '\\s+or\\s+|/') AS parts FROM supplier),
x AS (SELECT id, trim(unnest(parts)) AS city, unnest(range(len(parts))) AS pos FROM p)
SELECT id, code AS country_code, arg_min(city, pos) AS city FROM x JOIN cities USING (city) WHERE code IN ('DE', 'FR') GROUP BY ALL""",
)
def _(t):
    return shape.fan_out_text(loc(t), cities(t), ["DE", "FR"])


@query(
    "tag_and_union",
    f"""WITH {SQL_CITIES}, p AS (SELECT s_suppkey AS id, 'DE' AS country_code FROM supplier UNION ALL SELECT s_suppkey, 'FR' FROM supplier WHERE s_suppkey % 2 = 0),
x AS (SELECT p.id, p.country_code, u.city, u.pos FROM p, (VALUES ('Berlin', 0), ('Paris', 1), ('Hamburg', 2)) u(city, pos) WHERE EXISTS (SELECT 1 FROM cities c WHERE c.city = u.city AND c.code = p.country_code))
SELECT id || '-' || lower(country_code) AS id, country_code, string_agg(city, '|' ORDER BY pos) AS cities FROM x GROUP BY x.id, country_code""",
)
def _(t):
    s = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.array(F.lit("Berlin"), F.lit("Paris,Ile,France"), F.lit("Hamburg")).alias("cities"))
    return shape.tag_and_union([("DE", s), ("FR", s.where("id % 2 = 0"))], cities(t)).select("id", "country_code", F.array_join("cities", "|").alias("cities"))


@query(
    "fan_out_country",
    """WITH b AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'N' || c_nationkey AS country_code, [ 'N' || (c_nationkey + 1), 'N' || c_nationkey, 'N' || (c_custkey % 4) ] AS secondary FROM customer),
s AS (SELECT DISTINCT id, country_code, unnest(secondary) AS c FROM b)
SELECT id, country_code FROM b UNION ALL SELECT id || '-' || lower(c), c FROM s WHERE c <> country_code""",
)
def _(t):
    n = lambda c: F.concat(F.lit("N"), c.cast("string"))
    b = t.raw("customer").select(F.col("c_custkey").cast("string").alias("id"), n(F.col("c_nationkey")).alias("country_code"), F.array(n(F.col("c_nationkey") + 1), n(F.col("c_nationkey")), n(F.col("c_custkey") % 4)).alias("secondary"))
    return shape.fan_out_country(b).select("id", "country_code")


@query("fan_out_city", "SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 2 = 0 THEN '|' || c_mktsegment ELSE '' END AS cities FROM customer")
def _(t):
    x = t.raw("customer").select(F.col("c_custkey").alias("id"), F.array("c_name").alias("cities"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).alias("secondary_cities"))
    return x.select("id", F.array_join(shape.fan_out_city(), "|").alias("cities"))


@query(
    "fan_out_parallel",
    """WITH b AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS city, CASE s_suppkey % 3 WHEN 0 THEN ['DE', 'FR'] WHEN 1 THEN ['ES'] END AS countries FROM supplier)
SELECT CASE WHEN pos = 0 THEN id ELSE id || '-' || lower(code) END AS id, city, code AS country_code FROM (SELECT id, city, unnest(countries) AS code, unnest(range(len(countries))) AS pos FROM b WHERE countries IS NOT NULL)
UNION ALL SELECT id, city, NULL FROM b WHERE countries IS NULL""",
)
def _(t):
    k = F.col("s_suppkey") % 3
    b = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("city"), F.when(k == 0, F.array(F.lit("DE"), F.lit("FR"))).when(k == 1, F.array(F.lit("ES"))).alias("countries"))
    return shape.fan_out_parallel(b)


@query(
    "expand_multi",
    """WITH d AS (SELECT s_suppkey AS id, s_suppkey % 4 = 0 AS multi, 'main' AS location FROM supplier)
SELECT d.id, coalesce(CASE WHEN multi THEN r_name END, location) AS location, CASE WHEN multi THEN CAST(row_number() OVER (PARTITION BY d.id ORDER BY r_regionkey) - 1 AS INTEGER) END AS part
FROM d LEFT JOIN region ON multi""",
)
def _(t):
    from jobloom.operators.stats import group_rows

    d = t.raw("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4 == 0).alias("multi"), F.lit("main").alias("location"))
    regions = group_rows(t.raw("region").withColumn("k", F.lit(1)), "k", "r_regionkey", "r_name")
    details = t.raw("supplier").select(F.col("s_suppkey").alias("id")).crossJoin(F.broadcast(regions.select(F.col("rows").alias("locations"))))  # one row
    return shape.expand_multi(d, details).select("id", "location", "part")


@query(
    "per_country",
    """WITH b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'FR' END AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'Lyon' END AS city FROM supplier)
SELECT id, c AS country_code, coalesce(city, 'Berlin|Paris') AS cities, CASE WHEN id % 4 = 0 THEN 'remote' ELSE 'hybrid' END AS work_model
FROM (SELECT id, city, unnest(CASE WHEN code IS NOT NULL THEN [code] ELSE ['DE', 'XX', 'FR'] END) AS c FROM b) WHERE c IN ('DE', 'FR', 'ES')""",
)
def _(t):
    k = F.col("s_suppkey")
    b = t.raw("supplier").select(
        k.alias("id"), F.when(k % 3 == 0, "FR").alias("country_code"), F.array(F.lit("DE"), F.lit("XX"), F.lit("FR"), F.lit("DE")).alias("resolved"), F.when(k % 2 == 0, "Lyon").alias("city"),
        F.array().cast("array<string>").alias("cities"), F.array(F.lit("Berlin"), F.lit("Paris")).alias("derived_cities"), F.when(k % 4 == 0, "remote").alias("work_model"), F.lit("hybrid").alias("derived_work_model"),
    )
    tracked = t.spark.createDataFrame([("DE",), ("FR",), ("ES",)], "code string")
    return shape.per_country(b, tracked).withColumn("cities", F.array_join("cities", "|"))


@query("distinct_names", "SELECT DISTINCT segment AS name, country_id FROM company")
def _(t):
    return t.company.select(F.col("segment").alias("name"), "country_id").distinct()
