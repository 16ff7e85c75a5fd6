"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import columns as C
from jobloom.plans.base import query, sql_share, sql_slug

#: Texts with what the functions look for, made of table columns.
MESSY = "concat(' ', p_type, ' (Größe) / Ärzte & ', p_name, '_x ')"


@query("slug", f"SELECT p_partkey AS id, {sql_slug(MESSY)} AS slug FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), C.slug(F.expr(MESSY)).alias("slug"))


TEMPLATE_SQL = "'https://jobs.example.org/' || coalesce(p_brand, '') || '/' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') || '?id=' || coalesce(CAST(p_size AS VARCHAR), '')"


@query("url_template", f"SELECT p_partkey AS id, {TEMPLATE_SQL} AS url FROM part")
def _(t):
    from jobloom.sources.items import fill_template

    cols = {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size").cast("string")}
    return t.raw("part").select(F.col("p_partkey").alias("id"), fill_template("https://jobs.example.org/{brand}/{type|slug}?id={size}{missing}", cols).alias("url"))


SQL_KEEP = f"""trim(regexp_replace(replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace({MESSY}, 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'),
  '[()]', '', 'g'), '/', '_'), '[^A-Za-z0-9_]+', '-', 'g'), '-')"""


@query("slug_keep", f"SELECT p_partkey AS id, {SQL_KEEP} AS slug FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), C.slug_keep(F.expr(MESSY)).alias("slug"))


@query(
    "title_case_slug",
    """SELECT p_partkey AS id, array_to_string(list_transform(string_split(translate(replace(lower(p_type), ' ', '-') || '_teamX', '-_', '  '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM part""",
)
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), C.title_case_slug(F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit("_teamX"))).alias("title"))


@query("clean_name", r"SELECT c_custkey AS id, trim(regexp_replace(c_name || CASE WHEN c_custkey % 2 = 0 THEN ' - English' ELSE '' END, '(?i)\s*-\s*english\s*$', '')) AS name FROM customer")
def _(t):
    name = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " - English").otherwise(""))
    return t.raw("customer").select(F.col("c_custkey").alias("id"), C.clean_name(name).alias("name"))


def _sql_named(x: str) -> str:
    for name, char in sorted(C.ENTITIES.items(), key=lambda e: e[0] == "amp"):
        x = "replace({}, '&{};', '{}')".format(x, name, char.replace("'", "''"))
    return x


def _strip(tag: str, x: str) -> str:
    return f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"


def _sql_text(x: str) -> str:
    x = _sql_named(x)
    x = f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<nav\\b[^>]*>.*?</nav\\s*>|<footer\\b[^>]*>.*?</footer\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{C.BLOCKS})\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\n ', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _sql_named(f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')")


@query("html_to_text", f"SELECT page_id, {_sql_text('html')} AS text FROM pages")
def _(t):
    return t.raw("pages").select("page_id", C.html_to_text(F.col("html")).alias("text"))


@query("html_to_line", "SELECT page_id, trim(regexp_replace(" + _sql_named("regexp_replace(html, '<[^>]*>', ' ', 'g')") + ", '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS line FROM pages")
def _(t):
    return t.raw("pages").select("page_id", C.html_to_line(F.col("html")).alias("line"))


@query(
    "decode_entities",
    f"SELECT p_partkey AS id, {_sql_named('p_name')} || ' ' || chr(CAST(65 + p_size % 26 AS INTEGER)) || chr(CAST(192 + p_size AS INTEGER)) || chr(CAST(128512 + p_size AS INTEGER)) || ' & é' AS text FROM part",
)
def _(t):
    refs = F.concat(F.lit(" &#"), F.col("p_size") % 26 + 65, F.lit(";&#x"), F.hex(F.col("p_size") + 192), F.lit(";&#"), F.col("p_size") + 128512, F.lit("; &amp; &#233;"))
    return t.raw("part").select(F.col("p_partkey").alias("id"), C.decode_entities(F.concat("p_name", refs)).alias("text"))


@query(
    "cut_at_marker",
    """WITH p AS (SELECT doc_id, text, list_min(list_filter([strpos(lower(text), 'licensed under'), strpos(lower(text), 'all rights reserved')], lambda x: x > 0)) AS cut FROM documents)
SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE text[1:CAST(cut - 1 AS INTEGER)] END AS text FROM p""",
)
def _(t):
    return t.raw("documents").select("doc_id", C.cut_at_marker(F.col("text"), ["Licensed under", "All rights reserved"]).alias("text"))


@query(
    "drop_sections",
    """WITH s AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS part, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS i FROM documents)
SELECT doc_id, coalesce(string_agg(CASE WHEN i > 1 THEN chr(10) || chr(10) ELSE '' END || part, '' ORDER BY i) FILTER (WHERE NOT regexp_matches(part, '(?i)^ *(the|le|die)')), '') AS left_text FROM s GROUP BY 1""",
)
def _(t):
    return t.raw("documents").where("text is not null").select("doc_id", C.drop_sections(F.replace("text", F.lit("\n"), F.lit("\n\n")), ["the", "le", "die"]).alias("left_text"))


@query("strip_terms", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?i)(?:tion|ing|the|ll)', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", C.strip_terms(F.col("text"), ["the", "ll", "tion", "ing"]).alias("text"))


@query("strip_bilingual", "SELECT s_suppkey AS id, s_name || CASE s_suppkey % 3 WHEN 0 THEN '' ELSE ' / second' END AS title FROM supplier")
def _(t):
    tail = F.when(F.col("s_suppkey") % 3 == 0, " / Pārdevējs / more").when(F.col("s_suppkey") % 3 == 1, " / second / Vadītājs").otherwise(" / second")
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), C.strip_bilingual(F.concat("s_name", tail)).alias("title"))


@query("looks_non_english", "SELECT doc_id, regexp_matches(text, '[À-ÖØ-öø-ɏͰ-ӿ]') OR contains(lower(text), ' der ') OR contains(lower(text), ' les ') AS non_english FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", C.looks_non_english(F.col("text"), [" der ", " les "]).alias("non_english"))


@query(
    "title_cut",
    r"SELECT p_partkey AS id, trim(split_part(regexp_replace(regexp_replace('R' || p_size || ' - ' || p_name || ' – ' || p_brand || ', x - y', '^[A-Z]*[0-9]+ - ', ''), '^(.*) [-–] .*$', '\1'), ',', 1)) AS title FROM part",
)
def _(t):
    x = F.concat(F.lit("R"), "p_size", F.lit(" - "), "p_name", F.lit(" – "), "p_brand", F.lit(", x - y"))
    return t.raw("part").select(F.col("p_partkey").alias("id"), C.title_cut(x).alias("title"))


@query("clean_url", "SELECT page_id, regexp_replace(split_part(trim(replace(replace(replace(url, '.example', '.example//x&amp;amp;y'), '&amp;', '&'), '&amp;', '&')), '?', 1), '([^:])/{2,}', '\\1/', 'g') AS url FROM pages")
def _(t):
    return t.raw("pages").select("page_id", C.clean_url(F.replace("url", F.lit(".example"), F.lit(".example//x&amp;amp;y"))).alias("url"))


@query("safe_url", "SELECT page_id, CASE page_id % 3 WHEN 2 THEN NULL ELSE url END AS url FROM pages")
def _(t):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("[apply]("), "url", F.lit(")"))).when(k == 1, F.col("url")).otherwise(F.concat(F.lit("javascript:"), "url"))
    return t.raw("pages").select("page_id", C.safe_url(raw).alias("url"))


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"


@query("url_source_kind", f"SELECT page_id, CASE WHEN {HOST} LIKE 'blog.%' THEN 'blog' WHEN {HOST} LIKE 'm.%' THEN 'mobile' ELSE 'site' END AS kind, regexp_extract(url, '^https?://[^/]+/([a-z0-9-]+)', 1) AS slug FROM pages")
def _(t):
    from jobloom.sources.items import source_kind

    rules = [("blog", r"^blog\.", r"^/([a-z0-9-]+)"), ("mobile", r"^m\.", r"^/([a-z0-9-]+)"), ("site", ".", r"^/([a-z0-9-]+)")]
    k = source_kind(F.col("url"), rules)
    return t.raw("pages").select("page_id", k["kind"].alias("kind"), k["slug"].alias("slug"))


#: Career urls with the company {c}; the board and whether the company's name is found on it.
BOARD_URLS = [
    ("https://boards.greenhouse.io/{c}/jobs/1", "greenhouse", True), ("https://boards.greenhouse.io/embed/job_board?for={c}&b=1", "greenhouse", True), ("https://job-boards.greenhouse.io/embed", None, False), ("https://jobs.lever.co/{c}", "lever", True), ("https://jobs.eu.lever.co/{c}?x=1", "lever", True),
    ("https://jobs.ashbyhq.com/{c}/1", "ashby", True), ("https://apply.workable.com/api/v1/widget/accounts/{c}", "workable", True), ("https://apply.workable.com/{c}/j/1", "workable", True), ("https://{c}.workable.com", "workable", True), ("HTTPS://{c}.Recruitee.com/o/x#for=y", "recruitee", True),
    ("https://{c}.wd3.myworkdayjobs.com/en-US/site", "workday", True), ("https://wd5.myworkdaysite.com/en-US/recruiting/{c}/site", "workday", True), ("https://www.careers.{c}.com/jobs", None, True), ("no url {c}", None, False),
]
_BOARDS = ", ".join(f"({i}, {'NULL' if kind is None else repr(kind)}, {str(named).lower()}, {str('eu.lever' in u).lower()})" for i, (u, kind, named) in enumerate(BOARD_URLS))


@query("url_job_board", f"SELECT c_custkey AS id, kind, CASE WHEN named THEN 'co-' || c_custkey WHEN k = 2 THEN 'greenhouse' END AS slug, eu FROM customer JOIN (VALUES {_BOARDS}) v(k, kind, named, eu) ON k = c_custkey % {len(BOARD_URLS)}")
def _(t):
    from jobloom.sources.items import job_board

    form = F.get(F.array(*[F.lit(u) for u, *_ in BOARD_URLS]), (F.col("c_custkey") % len(BOARD_URLS)).cast("int"))
    board = job_board(F.replace(form, F.lit("{c}"), F.concat(F.lit("co-"), "c_custkey")))
    return t.raw("customer").select(F.col("c_custkey").alias("id"), board["kind"].alias("kind"), board["slug"].alias("slug"), board["eu"].alias("eu"))


@query("host_slug", f"WITH h AS (SELECT page_id, string_split({HOST}, '.') AS l FROM pages) SELECT page_id, l[len(l) - 1] AS slug FROM h")
def _(t):
    return t.raw("pages").select("page_id", C.host_slug(C.host(F.col("url"))).alias("slug"))


@query(
    "url_parts",
    f"""SELECT page_id, {HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([a-z]{{2}})(?:[/?#]|$)', 1), '') AS locale, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""",
)
def _(t):
    x = t.raw("pages").select("page_id", C.url_parts(F.col("url")).alias("u"))
    return x.select("page_id", "u.host", "u.path", "u.locale", F.get(F.try_element_at("u.params", F.lit("page")), F.lit(0)).alias("page"))


@query(
    "absolute_url",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a' WHEN 1 THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example.org/b' WHEN 2 THEN 'mailto:x@example.org'
  ELSE CASE WHEN regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '([^/])/[^/]*$', '\\1/') LIKE '%/' THEN regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '([^/])/[^/]*$', '\\1/') || 'c.html'
    ELSE split_part(split_part(url, '#', 1), '?', 1) || '/c.html' END END AS url FROM pages""",
)
def _(t):
    k = F.col("page_id") % 4
    href = F.when(k == 0, "/a").when(k == 1, "//cdn.example.org/b").when(k == 2, "mailto:x@example.org").otherwise("c.html")
    return t.raw("pages").select("page_id", C.absolute_url(F.col("url"), href).alias("url"))


@query("work_model", "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'on-site' WHEN 2 THEN NULL WHEN 3 THEN 'remote' END AS work_model FROM supplier")
def _(t):
    texts = F.array(*[F.lit(x) for x in ("Hybrid - Oslo; hybrid Bergen", "Onsite, Berlin", "Remote; Oslo", "Remote - EU", "Berlin")])
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), C.work_model(F.get(texts, (F.col("s_suppkey") % 5).cast("int"))).alias("work_model"))


@query("pct", f"SELECT l_orderkey AS id, {sql_share('count(*) FILTER (WHERE l_returnflag = chr(82))', 'count(*)')} AS pct0, {sql_share('count(*) FILTER (WHERE l_returnflag = chr(82))', 'count(*)', 1)} AS pct1 FROM lineitem GROUP BY 1")
def _(t):
    part, total = F.count_if(F.col("l_returnflag") == "R"), F.count("*")
    return t.raw("lineitem", "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("id")).agg(C.share(part, total).alias("pct0"), C.share(part, total, 1).alias("pct1"))


@query("day_key", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month FROM events")
def _(t):
    return t.raw("events").select("event_id", C.day_key(F.col("ts")).alias("day"), F.date_format("ts", "yyyy-MM").alias("month"))


@query(
    "fingerprint",
    """WITH r AS (SELECT l_orderkey, string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"l_quantity":' || CAST(l_quantity AS VARCHAR) || '}', ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS rows FROM lineitem GROUP BY 1)
SELECT l_orderkey, sha256('{"rows":[' || rows || ']}') AS fingerprint FROM r""",
)
def _(t):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    return t.raw("lineitem").groupBy("l_orderkey").agg(C.fingerprint(rows.alias("rows")).alias("fingerprint"))


@query("title_hash", "SELECT p_partkey AS id, left(md5(p_name), 8) AS title_hash FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), C.title_hash(F.col("p_name")).alias("title_hash"))


@query("map_lookup", "SELECT c.id, coalesce(CASE n.region_id WHEN 0 THEN 'green|black' WHEN 3 THEN 'blue|gold' END, 'grey') AS colours FROM company c JOIN country n ON n.id = c.country_id")
def _(t):
    flags = t.spark.createDataFrame([(0, ["green", "black"]), (3, ["blue", "gold"])], "region_id int, colours array<string>")
    x = t.company.select("id", "country_id").join(t.country.select(F.col("id").alias("country_id"), "region_id"), "country_id").join(F.broadcast(flags), "region_id", "left")
    return x.select("id", F.array_join(F.coalesce("colours", F.array(F.lit("grey"))), "|").alias("colours"))


@query(
    "array_helpers",
    """SELECT p_partkey AS id, array_to_string(list_sort(string_split(p_type, ' ')), '|') AS sorted, array_to_string(string_split(lower(p_name), ' '), '|') AS aliases, p_brand AS first FROM part""",
)
def _(t):
    words = F.split("p_name", " ")
    aliases = C.normalised_aliases(F.concat(F.transform(words, lambda w: F.concat(F.lit(" "), F.upper(w))), F.array(F.lit("  "))))
    first = C.first_non_blank(F.array(F.lit(" "), F.col("p_brand"), F.lit("z")))
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(F.split("p_type", " ")), "|").alias("sorted"), F.array_join(aliases, "|").alias("aliases"), first.alias("first"))


@query("other_than_english", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS other FROM supplier")
def _(t):
    k = F.col("s_suppkey") % 3
    langs = F.when(k == 1, F.array(F.lit("English"))).when(k == 2, F.array(F.lit("english"), F.lit("German")))
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), C.other_than_english(langs).alias("other"))
