"""Queries over texts: phrases, categories, skills, education, languages, locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import classify, location, phrases
from jobloom.plans.base import query

PHRASES = ["the", "of the", "and by", "licensed under", "all rights reserved", "der", "token =", "la"]


def sql_quote(p: str) -> str:
    return "".join("\\" + c if c in ".+*?()[]{}^$|\\" else c for c in p)


def sql_pos(text: str, phrase: str) -> str:
    """Place from 1 of the first bounded occurrence, 0 without."""
    pattern = f"'(?s)^(.*?)(^|[^a-z0-9])' || {phrase} || '($|[^a-z0-9])'"
    return f"CASE WHEN regexp_matches({text}, {pattern}) THEN length(regexp_extract({text}, {pattern}, 1)) + length(regexp_extract({text}, {pattern}, 2)) + 1 ELSE 0 END"


def values(rows: list[tuple], *names: str) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") v({', '.join(names)}))"


@query(
    "phrase_hits",
    f"""WITH p AS {values([(i, sql_quote(p)) for i, p in enumerate(PHRASES)], "phrase_id", "rx")}, h AS (SELECT doc_id, phrase_id, {sql_pos("lower(text)", "rx")} AS pos FROM documents, p WHERE text IS NOT NULL)
SELECT doc_id, CAST(phrase_id AS BIGINT) AS phrase_id, pos FROM h WHERE pos > 0""",
)
def _(t):
    p = t.spark.createDataFrame(list(enumerate(PHRASES)), "phrase_id long, phrase string")
    return phrases.phrase_hits(t.raw("documents", "doc_id", "text"), ["doc_id"], "text", p)


KEYWORDS = [("jewellery", 0, "ring", 0), ("jewellery", 0, "small ring", 1), ("metal", 1, "steel", 0), ("metal", 1, "brass", 1), ("metal", 1, "brass", 2), ("size", 2, "small", 0), ("size", 2, "large", 1), ("style", 3, "economy", 0)]


@query(
    "classify_category",
    f"""WITH k AS {values([(c, n, w, i, sql_quote(w)) for c, n, w, i in KEYWORDS], "category", "cat_no", "keyword", "kw_no", "rx")},
j AS (SELECT p_partkey AS id, 0 AS stage, CASE WHEN p_size % 5 = 0 THEN p_type END AS text FROM part UNION ALL SELECT p_partkey, 1, p_name FROM part UNION ALL SELECT p_partkey, 2, p_brand || ' ' || p_type FROM part),
h AS (SELECT id, stage, category, cat_no, keyword, kw_no, {sql_pos("lower(text)", "rx")} AS pos FROM j, k WHERE text IS NOT NULL),
s AS (SELECT id, stage, category, cat_no, count(*) AS score, min(pos) AS pos, arg_min(keyword, kw_no) AS keyword FROM h WHERE pos > 0 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, score DESC, pos, cat_no) AS rn FROM s)
SELECT p_partkey AS id, coalesce(category, 'other') AS category, keyword, coalesce((['jobFunction', 'title', 'description'])[CAST(stage + 1 AS INTEGER)], 'default') AS source
FROM part LEFT JOIN (SELECT * FROM b WHERE rn = 1) ON id = p_partkey""",
)
def _(t):
    k = t.spark.createDataFrame(KEYWORDS, "category string, cat_no int, keyword string, kw_no int")
    j = t.raw("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).alias("function"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("description"))
    return classify.classify_category(j, "id", k)


SKILLS = [("Articles", 0, ["the", "der", "la"]), ("Licences", 1, ["licensed under", "all rights reserved"]), ("Keys", 2, ["token =", ""]), ("Joins", 3, ["and", "und"])]


@query(
    "extract_skills",
    f"""WITH a AS {values([(n, i, sql_quote(x)) for n, i, xs in SKILLS for x in xs if x], "name", "skill_no", "rx")},
h AS (SELECT DISTINCT doc_id, name, skill_no FROM documents, a WHERE text IS NOT NULL AND {sql_pos("lower(text)", "rx")} > 0)
SELECT doc_id, string_agg(name, '|' ORDER BY skill_no) AS skills FROM h GROUP BY 1""",
)
def _(t):
    s = t.spark.createDataFrame(SKILLS, "name string, skill_no int, aliases array<string>")
    return classify.extract_skills(t.raw("documents", "doc_id", "text"), "doc_id", "text", s).withColumn("skills", F.array_join("skills", "|"))


EDU_TEXTS = ["Bachelor’s or Master’s degree", "PhD preferred", "MBA", "an apprenticeship or B.Sc.", "no studies at all", "M.Sc. or doctorate", "the trade school"]
EDU_SQL = "regexp_replace(text, '[‘’‚‛]', '''', 'g')"


@query(
    "education_floor",
    f"""WITH e AS {values(list(enumerate(EDU_TEXTS)), "k", "said")}, d AS (SELECT doc_id, text || ' ' || said AS text FROM documents JOIN e ON k = doc_id % {len(EDU_TEXTS)})
SELECT doc_id, CASE {" ".join("WHEN regexp_matches(" + EDU_SQL + ", '" + classify.phrase_pattern(p).replace("'", "''") + f"') THEN '{lvl}'" for lvl, p in classify.EDUCATION.items())} END AS level FROM d""",
)
def _(t):
    said = F.get(F.array(*[F.lit(x) for x in EDU_TEXTS]), (F.col("doc_id") % len(EDU_TEXTS)).cast("int"))
    return t.raw("documents").select("doc_id", classify.education_floor(F.concat_ws(" ", "text", said)).alias("level"))


@query("valid_title", "SELECT page_id, length(trim(t)) BETWEEN 2 AND 120 AND NOT regexp_matches(t, '(?i)loading|no +open roles') AS ok FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN ' Loading … ' WHEN page_id % 10 = 1 THEN 'No  open roles' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS t FROM pages)")
def _(t):
    title = F.when(F.col("page_id") % 10 == 0, " Loading … ").when(F.col("page_id") % 10 == 1, "No  open roles").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return t.raw("pages").select("page_id", classify.valid_title(title).alias("ok"))


@query("drop_placeholder", "SELECT doc_id FROM documents WHERE text IS NULL OR length(text) >= 300")
def _(t):
    return classify.drop_placeholder(t.raw("documents", "doc_id", "text"), F.col("text"), 300).select("doc_id")


SQL_GRAMS = """w AS (SELECT doc_id, lang, ' ' || w || ' ' AS c FROM (SELECT doc_id, lang, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')), ' ')) AS w FROM documents) WHERE w <> ''),
g AS (SELECT doc_id, lang, substr(c, i, 3) AS gram FROM (SELECT doc_id, lang, c, unnest(range(1, length(c) - 1)) AS i FROM w)),
f AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL), tt AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM f GROUP BY 1),
prof AS (SELECT lang, gram, n, total FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rn FROM f) JOIN tt USING (lang) WHERE rn <= 400)"""


@query("lang_profile", f"WITH {SQL_GRAMS} SELECT * FROM prof")
def _(t):
    return classify.build_lang_profile(t.raw("documents", "lang", "text"))


@query(
    "lang_detect",
    f"""WITH {SQL_GRAMS}, c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT doc_id, prof.lang, sum(c.n * CAST(floor(prof.n * 1000000 / total) AS BIGINT)) AS score FROM c JOIN prof USING (gram) GROUP BY ALL)
SELECT doc_id, lang AS detected FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rn FROM s) WHERE rn = 1""",
)
def _(t):
    d = t.raw("documents", "doc_id", "lang", "text")
    return classify.detect_lang(d, ["doc_id"], "text", classify.build_lang_profile(d))


SQL_WORDS = """w AS (SELECT doc_id, lang, w AS word FROM (SELECT doc_id, lang, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')), ' ')) AS w FROM documents) WHERE length(w) >= 3),
per AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
words AS (SELECT lang, word FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rn FROM per WHERE lang <> 'en' AND n >= 3 AND word NOT IN (SELECT word FROM per WHERE lang = 'en')) WHERE rn <= 300)"""


@query("title_words", f"WITH {SQL_WORDS} SELECT * FROM words")
def _(t):
    return classify.title_words(t.raw("documents", "lang", "text"))


@query(
    "title_language",
    f"""WITH {SQL_WORDS}, p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
tw AS (SELECT DISTINCT page_id, unnest(string_split(trim(regexp_replace(lower(title), '[^\\p{{L}}]+', ' ', 'g')), ' ')) AS word FROM p),
h AS (SELECT page_id, lang, count(*) AS n FROM tw JOIN words USING (word) GROUP BY ALL)
SELECT page_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, lang) AS rn FROM h) WHERE rn = 1""",
)
def _(t):
    """Titles of pages by words that labelled documents show to be another language's."""
    titles = t.raw("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return classify.title_language(titles, "page_id", "title", classify.title_words(t.raw("documents", "lang", "text")))


LETTERS = "äöüßÄÖÜéèêàçñáíóú"


@query("native_chars", f"SELECT doc_id, length(regexp_replace(text, '[^{LETTERS}]', '', 'g')) AS n_native, array_to_string(list_sort(list_distinct(string_split(regexp_replace(text, '[^{LETTERS}]', '', 'g'), ''))), '') AS sample FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", classify.native_char_count(F.col("text"), LETTERS).alias("n_native"), classify.native_sample(F.col("text"), LETTERS).alias("sample"))


def sql_chunks(source: str) -> str:
    """CTEs: the languages `found` of the paragraphs p of a source of (doc_id, text)."""
    return f"""{SQL_GRAMS}, q AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x)), lambda x: length(x) >= 200) AS paras FROM {source} WHERE text IS NOT NULL),
pp AS (SELECT doc_id, CASE WHEN len(paras) > 0 THEN paras ELSE [text] END AS paras FROM q), p AS (SELECT doc_id, i - 1 AS para, paras[i] AS p FROM (SELECT doc_id, paras, unnest(range(1, len(paras) + 1)) AS i FROM pp)),
k AS (SELECT doc_id, para, 1 AS part, p AS chunk FROM p WHERE length(p) <= 1500 UNION ALL SELECT doc_id, para, s0, substr(p, s0, 500) FROM (SELECT doc_id, para, p, unnest(range(1, length(p) + 1, 500)) AS s0 FROM p WHERE length(p) > 1500) WHERE length(substr(p, s0, 500)) >= 200),
kw AS (SELECT doc_id, para, part, ' ' || w || ' ' AS c FROM (SELECT doc_id, para, part, unnest(string_split(trim(regexp_replace(lower(chunk), '[^\\p{{L}}]+', ' ', 'g')), ' ')) AS w FROM k) WHERE w <> ''),
kg AS (SELECT doc_id, para, part, substr(c, i, 3) AS gram FROM (SELECT doc_id, para, part, c, unnest(range(1, length(c) - 1)) AS i FROM kw)),
ks AS (SELECT doc_id, para, part, prof.lang, sum(CAST(floor(prof.n * 1000000 / total) AS BIGINT)) AS score FROM kg JOIN prof USING (gram) GROUP BY ALL),
kb AS (SELECT doc_id, para, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para, part ORDER BY score DESC, lang) AS rn FROM ks) WHERE rn = 1),
kv AS (SELECT doc_id, para, lang, count(*) AS n FROM kb GROUP BY ALL), kt AS (SELECT doc_id, para, sum(n) AS total FROM kv GROUP BY ALL),
found AS (SELECT doc_id, CAST(para AS INTEGER) AS para, lang FROM kv JOIN kt USING (doc_id, para) WHERE n * 2 > total)"""


SQL_CHUNKS = "WITH " + sql_chunks("documents")


@query("chunk_language", f"{SQL_CHUNKS} SELECT * FROM found WHERE lang IN ('de', 'fr', 'es')")
def _(t):
    d = t.raw("documents", "doc_id", "lang", "text")
    return classify.chunk_language(d, "doc_id", "text", classify.build_lang_profile(d)).where("lang in ('de', 'fr', 'es')")


@query("chunk_language_any", f"{SQL_CHUNKS} SELECT doc_id, arg_min(lang, para) AS lang, min(para) AS para FROM found WHERE lang <> 'en' GROUP BY 1")
def _(t):
    d = t.raw("documents", "doc_id", "lang", "text")
    found = classify.chunk_language(d, "doc_id", "text", classify.build_lang_profile(d)).where("lang <> 'en'")
    return found.groupBy("doc_id").agg(F.min_by("lang", "para").alias("lang"), F.min("para").alias("para"))


# -- locations ------------------------------------------------------------------------------------------------------------

PLACES = [
    "Hybrid - Helsinki, Uusimaa; Hybrid - Tallinn, Estonia", "Berlin | immediately", "KQB (Amsterdam - Herengracht 578)", "Germany - Home Based", "Remote", "Riga central", "Home office DK",
    "FI - Unknown", "NLGWV03 - De Kroon", "ESP - Somewhere", "Mo i Rana, Norway", "Nowhere", "", "Paris (Remote), France; Lyon", "Espoo, Smalltown", "Vaasa, Finland",
]


def places(t):
    said = F.get(F.array(*[F.lit(x) for x in PLACES]), (F.col("c_custkey") % len(PLACES)).cast("int"))
    return t.raw("customer").select(F.col("c_custkey").alias("id"), said.alias("location"))


def per_place(answers: list, kind: str = "VARCHAR") -> str:
    """SQL of answers worked out by hand for PLACES, one for each customer."""
    rows = ", ".join(f"({i}, {'NULL' if a is None else repr(a)})" for i, a in enumerate(answers))
    return f"SELECT c_custkey AS id, CAST(a AS {kind}) AS answer FROM customer JOIN (VALUES {rows}) v(k, a) ON k = c_custkey % {len(PLACES)}"


@query(
    "location_segments",
    "SELECT id, answer AS segments FROM ("
    + per_place(["Helsinki|Uusimaa|Tallinn|Estonia", "Berlin|immediately", "KQB (Amsterdam - Herengracht 578)|Amsterdam|Herengracht 578|KQB (Amsterdam|Herengracht 578)", "Germany - Home Based|Germany|Home Based", None, "Riga central", "Home office DK", "FI - Unknown|FI|Unknown", "NLGWV03 - De Kroon|NLGWV03|De Kroon", "ESP - Somewhere|ESP|Somewhere", "Mo i Rana|Norway", "Nowhere", None, "Paris (Remote)|France|Remote|Lyon", "Espoo|Smalltown", "Vaasa|Finland"])
    + ") WHERE answer IS NOT NULL",
)
def _(t):
    x = location.location_segments(places(t), "id")
    from jobloom.operators.stats import group_rows

    return group_rows(x, "id", "pos", "segment").select("id", F.array_join("rows", "|").alias("segments"))


CODES = ["FI|EE", "DE", "NL", "DE", None, "LV", None, "FI", None, "ES", "NO", None, None, "FR", "FI", "FI"]


@query("resolve_countries", "SELECT id, answer AS codes FROM (" + per_place(CODES) + ") WHERE answer IS NOT NULL")
def _(t):
    c, k = location.dictionaries(t.spark)
    return location.resolve_countries(places(t), "id", c, k).withColumn("codes", F.array_join("codes", "|"))


@query("resolve_countries_fallback", "SELECT id, answer AS codes FROM (" + per_place([c or d for c, d in zip(CODES, ["", "", "", "", "GB", "", "DK", "", "NL", "", "", "GB", "GB", "", "", ""], strict=True)]) + ")")
def _(t):
    c, k = location.dictionaries(t.spark)
    return location.resolve_with_fallback(places(t), "id", c, k, default=F.lit("GB")).withColumn("codes", F.array_join("codes", "|"))


@query("cities_for_country", "SELECT id, answer AS cities FROM (" + per_place(["Helsinki", "", "", "", "", "", "", "FI - Unknown", "", "", "", "", "", "", "Espoo", "Vaasa"]) + ")")
def _(t):
    c, k = location.dictionaries(t.spark)
    return location.cities_for_country(places(t), "id", F.lit("FI"), c, k).withColumn("cities", F.array_join("cities", "|"))


@query("prefix_lookup", "SELECT id, answer AS code FROM (" + per_place([{"Riga central": "LV", "Paris (Remote), France; Lyon": "FR"}.get(p) for p in PLACES]) + ") WHERE answer IS NOT NULL")
def _(t):
    c, k = location.dictionaries(t.spark)
    return location.place_of(location.location_segments(places(t), "id"), c, k).where("kind = 'prefix'").select("id", "code")


@query("venue_city", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Espoo' WHEN 1 THEN 'Oslo' END AS city FROM supplier")
def _(t):
    texts = F.array(*[F.lit(x) for x in ("FI123 - Espoo - Road 1", "Norway, Oslo, 0150", "Berlin")])
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), location.venue_city(F.get(texts, (F.col("s_suppkey") % 3).cast("int"))).alias("city"))


@query("location_class", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'venue' ELSE 'plain' END AS kind FROM supplier")
def _(t):
    texts = F.array(*[F.lit(x) for x in ("3 Locations", "HQ NORTH 2", "Berlin, Germany")])
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), location.location_class(F.get(texts, (F.col("s_suppkey") % 3).cast("int"))).alias("kind"))


@query("country_matches", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 1")
def _(t):
    c, _k = location.dictionaries(t.spark)
    own = F.get(F.array(F.lit(" Suomi "), F.lit("Sweden"), F.lit(None).cast("string")), (F.col("s_suppkey") % 3).cast("int"))
    x = t.raw("supplier").select(F.col("s_suppkey").alias("id"), own.alias("own"))
    return location.country_matches(F.col("own"), c, x, "FI").select("id")
