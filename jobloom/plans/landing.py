"""Queries of sources and normalisers, over payloads that Spark builds from the given tables, and over `pages`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from jobloom.plans.base import query
from jobloom.plans.functions import _sql_text
from jobloom.plans.streams import scratch
from jobloom.sources import html as H
from jobloom.sources import items, normalise, tables


@query("json_path_extract", "SELECT event_id, CAST(props ->> '$.k' AS VARCHAR) AS k FROM events")
def _(t):
    return t.raw("events").select("event_id", items.get_string(F.try_parse_json("props"), "k").alias("k"))


def parts_payload(t):
    """One JSON document a brand with its parts as items."""
    item = F.struct(F.col("p_partkey").alias("id"), F.struct(F.concat(F.col("p_name"), F.lit(" &amp; co")).alias("text")).alias("title"), F.array(F.struct(F.col("p_type").alias("body"))).alias("parts"), F.array("p_type", "p_brand").alias("cities"), F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b")).alias("extra"))
    return t.raw("part").groupBy(F.col("p_brand").alias("brand")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("jobs"))).alias("payload"))


@query("config_map_items", "SELECT p_brand AS brand, CAST(p_partkey AS VARCHAR) AS source_id, p_name || ' & co' AS title, 'https://x.org/' || lower(p_type) || '/' || p_partkey AS url, p_type AS description, p_type || '|' || p_brand AS cities FROM part")
def _(t):
    x = items.explode_items(parts_payload(t), "payload", "jobs")
    cfg = {"id": "id", "title": "title.text", "url_template": "https://x.org/{parts.0.body|slug}/{id}", "description": ["parts.0.body", "nothing"], "cities": "cities"}
    return items.map_items(x, cfg).select("brand", "source_id", "title", "url", "description", F.array_join("cities", "|").alias("cities"))


@query("landing_json", """SELECT 'good' AS kind, event_id % 4 AS source, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_id % 4 <> 3 AND event_id % 10 <> 0 GROUP BY ALL
UNION ALL SELECT 'broken', event_id % 4, count(*), NULL FROM events WHERE event_id % 4 <> 3 AND event_id % 10 = 0 GROUP BY ALL UNION ALL SELECT 'kept whole', event_id % 4, count(*), NULL FROM events WHERE event_id % 2 = 1 GROUP BY ALL""")
def _(t):
    """Written files, of which those of two sources have broken lines: split in a table and its quarantine, by line and by file."""
    root = scratch(t)
    body = F.when((F.col("event_id") % 10 == 0) & (F.col("event_id") % 4 != 3), F.lit('{"k": 1, broken')).otherwise(F.col("props"))
    t.raw("events").select(body.alias("value"), (F.col("event_id") % 4).alias("source")).repartition("source").write.partitionBy("source").text(f"{root}/in")
    rows = tables.read_json_landing(t.spark, f"{root}/in", "k bigint, source bigint")
    good, bad = tables.land(rows, f"{root}/landed")
    whole, _ = tables.land(rows, f"{root}/files", clean_files=True)
    source = F.regexp_extract("source_file", "/source=([0-9]+)/", 1).cast("long")
    out = good.where("source <> 3").groupBy("source").agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit("good").alias("kind"), "source", "n", "total")
    out = out.unionByName(bad.groupBy(source.alias("source")).agg(F.count("*").alias("n")).select(F.lit("broken").alias("kind"), "source", "n", F.lit(None).cast("long").alias("total")))
    return out.unionByName(whole.groupBy("source").agg(F.count("*").alias("n")).select(F.lit("kept whole").alias("kind"), "source", "n", F.lit(None).cast("long").alias("total")))


@query("landing_xml", """SELECT s_suppkey AS id, s_name AS title, upper(substr(s_name, 1, 2)) AS country, [1, 2] AS tags, s_suppkey % 6 = 5 AS repaired FROM supplier WHERE s_suppkey % 6 <> 0""")
def _(t):
    """XML files by the reader: attributes, nested and repeated elements. A file that does not parse is kept apart whole; where references
    that XML does not allow are the cause, it is repaired and read again."""
    root, k = scratch(t), F.col("s_suppkey")
    # a file holds about a thousand jobs, however many there are
    pages = F.pmod(F.xxhash64(k), F.lit(max(1, t.raw("supplier").count() // 60_000))).alias("page")
    name = F.when(k % 6 == 5, F.concat("s_name", F.lit("&#7;"))).when(k % 6 == 0, F.concat("s_name", F.lit("</wrong>"))).otherwise(F.col("s_name"))
    job = F.concat(F.lit('<job id="'), k, F.lit('"><head><title>'), name, F.lit("</title><place><country>"), F.lower(F.substring("s_name", 1, 2)), F.lit("</country></place></head><tag>1</tag><tag>2</tag></job>"))
    feeds = t.raw("supplier").groupBy((k % 60).alias("source"), pages).agg(F.concat(F.lit("<jobs>"), F.array_join(F.collect_list(job), "\n"), F.lit("</jobs>")).alias("value"))
    feeds.select("value", "source", "page").write.partitionBy("source", "page").text(f"{root}/in")
    fields = "_id: bigint, head: struct<title:string,place:struct<country:string>>, tag: array<bigint>"
    good, bad = tables.land(tables.read_xml_landing(t.spark, f"{root}/in", "job", fields.replace(": ", " ")), f"{root}/landed", clean_files=True)
    row = lambda df, fixed: df.select(F.col("_id").alias("id"), F.col("head.title").alias("title"), F.upper("head.place.country").alias("country"), F.col("tag").alias("tags"), F.lit(fixed).alias("repaired"))
    again = bad.select(F.explode(F.from_xml(H.repair_xml(F.col("record")), f"job array<struct<{fields}>>")["job"]).alias("r")).select("r.*")
    return row(good, False).unionByName(row(again, True))


def _per_brand(t, item, key: str):
    rows = F.array_sort(F.collect_list(item))
    doc = F.to_json(F.struct(rows.alias(key))) if key else F.to_json(rows)
    return t.raw("part").groupBy(F.col("p_brand").alias("brand")).agg(doc.alias("payload"))


@query(
    "norm_nested_json",
    """SELECT 'greenhouse' AS kind, CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title, p_type AS location, NULL AS country_code, NULL AS work_model FROM part
UNION ALL SELECT 'lever', CAST(p_partkey AS VARCHAR), p_name, p_type, 'FI', 'hybrid' FROM part UNION ALL SELECT 'workable', CAST(p_partkey AS VARCHAR), p_name, p_type || ', Finland', 'FI', NULL FROM part
UNION ALL SELECT 'recruitee', CAST(p_partkey AS VARCHAR), p_name, p_type, NULL, CASE WHEN p_size % 2 = 0 THEN 'hybrid' ELSE 'remote' END FROM part
UNION ALL SELECT 'ashby', CAST(p_partkey AS VARCHAR), p_name, p_type, 'FI', NULL FROM part UNION ALL SELECT 'ashby', CAST(p_partkey AS VARCHAR), p_name, 'Riga', 'LV', NULL FROM part WHERE p_size % 2 = 0""",
)
def _(t):
    k, name, place = F.col("p_partkey").cast("string").alias("id"), F.col("p_name"), F.col("p_type")
    gh = _per_brand(t, F.struct(k, F.concat(name, F.lit(" - English")).alias("title"), F.struct(place.alias("name")).alias("location"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("departments")), "jobs")
    lever = _per_brand(t, F.struct(k, F.concat(name, F.lit(" / Pārdevējs")).alias("text"), F.array(F.struct(F.lit("Must").alias("text"), F.lit("<li>x</li>").alias("content"))).alias("lists"), F.lit("fi").alias("country"), F.lit("Hybrid work").alias("workplaceType"), F.struct(place.alias("location")).alias("categories")), "")
    workable = _per_brand(t, F.struct(k.alias("shortcode"), name.alias("title"), place.alias("city"), F.lit("Finland").alias("country"), F.array(F.struct(F.lit("fi").alias("countryCode"))).alias("locations")), "jobs")
    recruitee = _per_brand(t, F.struct(k, name.alias("title"), place.alias("location"), (F.col("p_size") % 2 == 0).alias("hybrid"), F.lit(True).alias("remote")), "offers")
    more = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("Riga").alias("location"), F.lit("lv").alias("country"), F.lit("Riga").alias("city"))))
    ashby = _per_brand(t, F.struct(k, name.alias("title"), place.alias("location"), F.lit("fi").alias("country"), F.lit("Oulu").alias("city"), more.alias("secondary")), "jobs")
    frames = [("greenhouse", normalise.normalise_greenhouse(gh)), ("lever", normalise.normalise_lever(lever)), ("workable", normalise.normalise_workable(workable)), ("recruitee", normalise.normalise_recruitee(recruitee)), ("ashby", normalise.normalise_ashby(ashby))]
    from jobloom.operators.shape import union_all

    return union_all([x.select(F.lit(n).alias("kind"), "source_id", "title", "location", "country_code", "work_model") for n, x in frames])


@query(
    "norm_two_table",
    """SELECT s_suppkey AS id, 'Espoo, Finland' AS location, NULL AS country_code, '' AS cities FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'Helsinki; Oulu', 'FI', 'Helsinki|Oulu' FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey, 'Riga', 'LV', 'Riga' FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey, 'Norway', NULL, '' FROM supplier WHERE s_suppkey % 3 = 2""",
)
def _(t):
    from jobloom.operators.location import dictionaries

    k = F.col("s_suppkey") % 3
    listing = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("url"), F.when(k == 0, "Espoo, Finland").when(k == 1, "3 Locations").otherwise("HQ NORTH").alias("location"))
    detail = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.lit("text").alias("description"), F.lit("Norway").alias("country"), F.when(k == 1, F.array(F.lit("Helsinki"), F.lit("Riga"), F.lit("Oulu"), F.lit("Elsewhere"))).alias("locations"))
    return normalise.normalise_workday(listing, detail, dictionaries(t.spark)[1]).select("id", "location", "country_code", F.array_join("cities", "|").alias("cities"))


@query("payload_shapes", "SELECT s_suppkey AS id, (['wrapped', 'list', 'single'])[CAST(s_suppkey % 4 + 1 AS INTEGER)] AS shape, unnest(range(CASE s_suppkey % 4 WHEN 2 THEN 1 ELSE 2 END)) AS no FROM supplier WHERE s_suppkey % 4 < 3")
def _(t):
    k = F.col("s_suppkey") % 4
    e = lambda n: F.concat(F.lit('{"name": "'), "s_name", F.lit(f'{n}"}}'))
    two = F.concat(F.lit("["), e(1), F.lit(", "), e(2), F.lit("]"))
    payload = F.when(k == 0, F.concat(F.lit('{"total_positions": 7, "companies": '), two, F.lit("}"))).when(k == 1, two).when(k == 2, e(1)).otherwise(F.lit("{nope"))
    return normalise.normalise_payload(t.raw("supplier").select(F.col("s_suppkey").alias("id"), payload.alias("payload"))).select("id", "shape", F.col("no").cast("long").alias("no"))


@query("sources_table", "SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS min_positions FROM pages WHERE page_id % 7 <> 0")
def _(t):
    x = t.raw("pages").select("page_id", F.when(F.col("page_id") % 7 != 0, F.col("url")).otherwise(" ").alias("url"), F.when(F.col("page_id") % 5 == 0, 0).alias("min_positions"))
    return tables.load_sources(x)


# -- pages ------------------------------------------------------------------------------------------------------------------


#: A board put into each page: cards, a list or bare links by page_id % 3, with a second card or item that is none.
TITLE_SQL = "trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[&<>\\s]+', ' ', 'g'))"


def board(t):
    """(page_id, html): the pages with a board whose titles, links and places come from the page."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"[&<>\s]+", " "))
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    k, n = F.col("page_id").cast("string"), F.col("page_id") % 3
    cards = part(
        '<div class="job-list"><div class="job-card"><h3>', title, ' a</h3><a href="/x/', k, '"></a><span class="office-city">Oulu</span></div>',
        '<div class="job-card"><h4>', title, ' b</h4><i>Full-time Turku</i><a href="https://y/', k, '"></a><b class="place">Remote</b></div>',
        '<div class="job-card"><h4>No current openings</h4><a href="/z"></a></div><div class="job-card"><h3>', title, ' c</h3></div></div>',
    )
    items = part('<ul><li><a href="/i/', k, '">', title, ' d</a> <span class="location">Rome</span></li><li>', title, " e</li><li><a href='/j'>", title, " f</a></li></ul><ol><li><a href='/q'>one more</a></li><li>two</li><li>three</li></ol>")
    links = part('<p><a href="/jobs/', k, '?a=1">', title, ' g</a> or <a href="https://h/career/', k, '"><b>', title, '</b> h</a> <a href="/jobs/1">abc</a> <a href="/about?x=job">', title, "</a></p>")
    made = F.when(n == 0, cards).when(n == 1, items).otherwise(links)
    return t.raw("pages", "page_id", "html").select("page_id", F.replace("html", F.lit("</body>"), F.concat(made, F.lit("</body>"))).alias("html"))


BOARD_SQL = f"""b AS (SELECT page_id, {TITLE_SQL} AS t, CAST(page_id AS VARCHAR) AS k, CAST(page_id % 3 AS INTEGER) AS n FROM pages WHERE contains(html, '</body>')),
c AS (SELECT page_id, 1 AS strategy, trim(t || ' a') AS title, '/x/' || k AS url, 'Oulu' AS location, n FROM b WHERE n = 0 UNION ALL SELECT page_id, 1, trim(t || ' b'), 'https://y/' || k, NULL, n FROM b WHERE n = 0),
l AS (SELECT page_id, 2 AS strategy, trim(t || ' d') AS title, '/i/' || k AS url, 'Rome' AS location, n FROM b WHERE n = 1 UNION ALL SELECT page_id, 2, trim(t || ' e'), NULL, NULL, n FROM b WHERE n = 1 UNION ALL SELECT page_id, 2, trim(t || ' f'), '/j', NULL, n FROM b WHERE n = 1),
a AS (SELECT page_id, 3 AS strategy, trim(t || ' g') AS title, '/jobs/' || k || '?a=1' AS url, n FROM b WHERE n = 2 UNION ALL SELECT page_id, 3, trim(t || ' h'), 'https://h/career/' || k, n FROM b WHERE n = 2)"""
FITS = "length(title) BETWEEN 2 AND 120"


@query("html_links", f"WITH {BOARD_SQL} SELECT page_id, title, url FROM a WHERE {FITS}")
def _(t):
    return H.links(board(t)).select("page_id", "title", "url")


@query("html_containers", f"WITH {BOARD_SQL} SELECT page_id, title, url, location FROM c WHERE {FITS}")
def _(t):
    return H.containers(board(t)).select("page_id", "title", "url", "location")


@query("html_lists", f"WITH {BOARD_SQL} SELECT page_id, title, url, location FROM l WHERE {FITS}")
def _(t):
    return H.lists(board(t)).select("page_id", "title", "url", "location")


@query("html_best_strategy", f"WITH {BOARD_SQL} SELECT page_id, strategy, title, url FROM c WHERE {FITS} UNION ALL SELECT page_id, strategy, title, url FROM l WHERE {FITS} UNION ALL SELECT page_id, strategy, title, url FROM a WHERE {FITS}")
def _(t):
    return H.best_rows(board(t)).select("page_id", "strategy", "title", "url")


@query("html_cards", f"WITH {BOARD_SQL} SELECT page_id, title, url, location FROM c UNION ALL SELECT page_id, 'No current openings', '/z', NULL FROM b WHERE n = 0 UNION ALL SELECT page_id, trim(t || ' c'), NULL, NULL FROM b WHERE n = 0")
def _(t):
    return H.cards(board(t), "div.job-card").select("page_id", "title", "url", "location")


PRESETS = {
    "middot": ("<h3>{t}</h3><p>Sales · Office: Espoo</p>", ["Espoo"], []), "token_list": ("<h3>{t}</h3><p>Part-time Lahti Center</p>", ["Lahti Center"], []), "or_list": ("<h3>{t}</h3><p class=place>Kotka or Pori</p>", ["Kotka", "Pori"], []),
    "tile": ("<h3>{t}</h3><p>Salo | Legal | Hybrid</p>", ["Salo"], ["Legal", "Hybrid"]), "accordion": ("<h3>{t}</h3><p>Team: Data Level: Senior</p>", [None], ["Team: Data", "Level: Senior"]),
}
_SAID = ", ".join(f"('{p}', {'NULL' if place is None else repr(place)}, '{'/'.join(more)}')" for p, (_, places, more) in PRESETS.items() for place in places)


@query("html_card_presets", f"WITH s AS (SELECT * FROM (VALUES {_SAID}) v(preset, location, more)) SELECT page_id, preset, trim({TITLE_SQL}) AS title, location, more FROM pages, s WHERE trim({TITLE_SQL}) <> ''")
def _(t):
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"[&<>\s]+", " "))
    pages = t.raw("pages", "page_id", "html")
    made = lambda layout: pages.select("page_id", F.concat(F.lit(f'<div class="card">{layout.split("{t}")[0]}'), title, F.lit(layout.split("{t}")[1] + "</div>"), "html").alias("html"))
    frames = [H.cards(made(layout), "div.card", p).withColumn("preset", F.lit(p)) for p, (layout, *_) in PRESETS.items()]
    x = reduce(lambda a, b: a.unionByName(b), frames)
    return x.select("page_id", "preset", "title", "location", F.array_join("more", "/").alias("more"))


_ARTICLE = _sql_text("array_to_string(regexp_extract_all(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), chr(10))")


@query(
    "html_description",
    f"""SELECT page_id, 'chain' AS how, CASE WHEN length({_ARTICLE}) >= 200 THEN {_ARTICLE} ELSE {_sql_text('html')} END AS text FROM pages
UNION ALL SELECT page_id, 'selector', 'Opening ' || page_id || ' ' || repeat('x', 100) || ' Inner ' || repeat('y', 100) || ' closing Second ' || page_id FROM pages WHERE contains(html, '</body>')
UNION ALL SELECT page_id, 'script', 'From the script of ' || page_id || ' ' || repeat('z', 200) FROM pages""",
)
def _(t):
    """The chain over whole pages; a selector whose element holds one of its own tag; a script where no element has enough."""
    p, k = t.raw("pages", "page_id", "html"), F.col("page_id").cast("string")
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    made = p.where(F.contains("html", F.lit("</body>"))).select("page_id", F.replace("html", F.lit("</body>"), part("<div class='a job-text'>Opening ", k, " <div>", "x" * 100, "<div class='job-text'> Inner ", "y" * 100, "</div></div> closing</div><p>no</p><div class=job-text>Second ", k, "</div></body>")).alias("html"))
    script = p.select("page_id", part('<html><body><article>short</article><script type="application/ld+json">{"title": "a]}", "description": "From the script of ', k, " ", "z" * 200, '"} trailing [</script></body></html>').alias("html"))
    line = lambda df, how: df.select("page_id", F.lit(how).alias("how"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return H.descriptions(p, script_key=None).select("page_id", F.lit("chain").alias("how"), "text").unionByName(line(H.descriptions(made, "div.job-text"), "selector")).unionByName(line(H.descriptions(script), "script"))


@query("html_capture", r"SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, coalesce(nullif(regexp_extract(html, '<h9>([^<]*)</h9>', 1), ''), url) AS place FROM pages")
def _(t):
    return t.raw("pages").select("page_id", H.capture(F.col("html"), "<title>([^<]*)</title>").alias("title"), H.capture(F.col("html"), "<h9>([^<]*)</h9>", F.col("url")).alias("place"))


@query("html_meta", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'about & ' || page_id END AS description FROM pages")
def _(t):
    k = F.col("page_id") % 3
    text = F.concat(F.lit('content="about &amp; '), "page_id", F.lit('"'))
    tag = F.when(k == 0, F.concat(F.lit('<meta name="description" '), text, F.lit(">"))).when(k == 1, F.concat(F.lit("<meta "), text, F.lit(' property="og:description">'))).otherwise("")
    return t.raw("pages").select("page_id", H.meta_description(F.concat(tag, "html")).alias("description"))


@query("html_options", "SELECT page_id, 'Label ' || page_id AS label, 'v' || page_id AS value FROM pages")
def _(t):
    tag = F.concat(F.lit('<select><option value="">Any</option><option value="v'), "page_id", F.lit('"> Label <b>'), "page_id", F.lit("</b></option></select>"))
    return H.select_options(t.raw("pages").select("page_id", F.concat(tag, "html").alias("html")), "select > option").select("page_id", "label", "value")


@query("html_attr_json", "SELECT page_id, unnest(['FI', 'SE']) AS country, unnest(['Oulu', CASE WHEN page_id % 2 = 0 THEN 'Malmö' ELSE 'Oulu' END]) AS location FROM pages")
def _(t):
    locs = F.when(F.col("page_id") % 2 == 0, F.lit('"Oulu","Malmö"')).otherwise(F.lit('"Oulu"'))
    tag = F.concat(F.lit("<div class=x data-jobs=\""), F.replace(F.concat(F.lit('[{"title":"a & b","countries":["FI","SE"],"locations":['), locs, F.lit("]}]")), F.lit('"'), F.lit("&quot;")), F.lit('">'))
    return H.attribute_json(t.raw("pages").select("page_id", F.concat("html", tag).alias("html")), "div", "data-jobs", "title:string,countries:array<string>,locations:array<string>").select("page_id", "country", "location")


@query("html_script_json", "SELECT page_id, unnest(['job ] ' || page_id, 'more \" }']) AS title FROM pages")
def _(t):
    """Two pushes with text behind the arrays, brackets and quotes inside of strings, and a broken array that is left out."""
    chunk = F.concat(F.lit('<script>self.push([1,"{\\"jobs\\":[{\\"title\\":\\"job ] '), "page_id", F.lit('\\"}"])</script><script>self.push([1,"], \\"x\\": [1, [2]], \\"jobs\\": [{\\"title\\": \\"more \\\\\\" }\\"}], \\"jobs\\": [{]} and ]"])</script>'))
    return H.script_json(t.raw("pages").select("page_id", F.concat("html", chunk).alias("html")), "jobs", "title string")


@query("html_marker_json", "SELECT page_id, '{\"n\": ' || page_id || '}' AS payload FROM pages WHERE page_id % 2 = 0")
def _(t):
    tag = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<script>totalHits = {"n": '), "page_id", F.lit("};</script>"))).otherwise("")
    return H.marker_json(t.raw("pages").select("page_id", F.concat("html", tag).alias("html")), "totalHits")


@query("xml_feed", "SELECT s_suppkey AS feed_id, unnest(range(2)) AS no, unnest([s_name || ' & co', chr(128512)]) AS title, unnest(['FI', '']) AS country_code FROM supplier")
def _(t):
    xml = F.concat(F.lit("<jobs><job><title><![CDATA["), "s_name", F.lit(" &amp; co]]></title><country>fi</country></job><job><title>&#55357;&#56832;&#7;</title></job></jobs>"))
    return H.xml_rows(t.raw("supplier").select(F.col("s_suppkey").alias("feed_id"), xml.alias("xml")), "job", {"title": "title", "country_code": "country"}).withColumn("no", F.col("no").cast("long"))
