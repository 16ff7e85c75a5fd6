"""Queries of the language-requirement cascade, over postings made of `documents` and sentences chosen by doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import classify, language
from jobloom.plans.base import query
from jobloom.plans.texts import KEYWORDS, SKILLS, sql_chunks

#: Country, title and sentence; then what should be said where the text that follows shows no language: phase, value, matched text,
#: languages required and preferred.
CASES = [
    ("FI", "Kehittäjä", "We build things.", "1a", True, "Kehittäjä", "Finnish", ""),
    ("DE", "Engineer", "German is a plus.", "1b", False, "german is a plus", "", "German"),
    ("SE", "Engineer", "Any Nordic language is an advantage.", "1b-group", False, "nordic language is an advantage", "", "Swedish"),
    ("FI", "Engineer", "Fluent in Finnish and English.", "2a", True, "fluent in finnish", "Finnish", ""),
    ("DE", "Engineer", "German skills are not required.", "2a", False, "german skills", "", "German"),
    ("FR", "Engineer", "You must speak French.", "2a", True, "must speak french", "French", ""),
    ("NL", "Engineer", "Local language is required.", "2a-generic", True, "local language is required", "Dutch", ""),
    ("DK", "Engineer", "Fluency in a Nordic language.", "2a-group", True, "fluency in a nordic language", "Danish", ""),
    ("ES", "Engineer", "You must speak Polish.", "2a-cross", True, "must speak polish", "Polish", ""),
    ("CH", "Engineer", "Working language depends: depending on location French or German.", "2b", True, "depending on location", "German|French|Italian", ""),
    ("US", "Engineer", "Nothing about it.", "2c", False, "", "", ""),
    ("LV", "Engineer", "Ideally fluent in Latvian", "2a", True, "fluent in latvian", "Latvian", ""),
    ("US", "Engineer", "Dutch, French, and English: Professional working proficiency is required for all three languages.", "2a-all", True, "dutch, french, and english: professional working proficiency is required for all three languages", "Dutch|French", ""),
    ("SE", "Engineer", "English in addition to Norwegian or Swedish.", "2a-generic", True, "in addition to norwegian or swedish", "Swedish", ""),
    ("IT", "Engineer", "Knowledge of additional EU languages is a plus.", "1b-group", False, "additional eu languages is a plus", "", "Italian"),
    ("PT", "Engineer", "You speak your local language (Portuguese).", "2a-generic", True, "your local language portuguese", "Portuguese", ""),
    ("GR", "Engineer", "You must speak Greek.", "2a", True, "must speak greek", "Greek", ""),
]


def postings(t):
    k = (F.col("doc_id") % len(CASES)).cast("int")
    pick = lambda n: F.get(F.array(*[F.lit(c[n]) for c in CASES]), k)
    return t.raw("documents").select(F.col("doc_id").alias("id"), pick(0).alias("country_code"), pick(1).alias("title"), F.concat_ws("\n", pick(2), "text").alias("description"))


def values_sql(rows: list[tuple]) -> str:
    show = lambda v: str(v).lower() if isinstance(v, bool) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


#: The postings with their cases, and how many letters of the country's own their texts have.
SQL_POSTINGS = f"""cases(k, country, title, sentence, phase, value, matched, required, preferred) AS ({values_sql([(i, *c) for i, c in enumerate(CASES)])}),
own(country, language) AS ({values_sql([(c, name) for c, names in language.COUNTRY_LANGUAGES.items() for name in names])}),
letters(country, chars, least) AS ({values_sql([(c, chars, n) for c, (chars, n) in language.LETTERS.items()])}),
post AS (SELECT doc_id, cases.*, sentence || CASE WHEN text IS NULL THEN '' ELSE chr(10) || text END AS text FROM documents JOIN cases ON k = doc_id % {len(CASES)}),
native AS (SELECT post.*, left(phase, 1) = '2' AS late, coalesce(length(text) - length(translate(text, chars, '')) >= least, false) AS by_letters FROM post LEFT JOIN letters ON letters.country = post.country)"""


@query("phase_requirement", f"WITH {SQL_POSTINGS} SELECT doc_id AS id, CASE WHEN late AND by_letters THEN '1b-chars' ELSE phase END AS phase, value OR late AND by_letters AS value FROM native")
def _(t):
    return language.detect_language_requirement(postings(t)).select("id", "phase", "value")


@query("phase_title", f"WITH {SQL_POSTINGS} SELECT doc_id AS id, phase = '1a' AS hit FROM native")
def _(t):
    return postings(t).select("id", language.phase_title(F.col("title")).alias("hit"))


# -- single phases: whole documents, each with a sentence made of a language, a country and a form by its id -------------------

NAMES = ["finnish", "swedish", "norwegian", "danish", "icelandic", "german", "dutch", "french", "italian", "spanish", "portuguese", "polish", "czech", "estonian", "latvian", "lithuanian", "greek", "turkish"]
LANDS = ["FI", "SE", "NO", "DK", "IS", "DE", "CH", "NL", "BE", "FR", "ES", "PL", "EE", "LV", "LT", "US", "IN"]
OWN = [(c, l.lower()) for c in LANDS for l in language.COUNTRY_LANGUAGES.get(c, [])]  # noqa: E741


def said(t, forms: list[tuple[str, int]]):
    """(id, country_code, name, form, said): what documents say with a form's sentence before their text; {l} is the language's name."""
    pick = lambda xs, by: F.get(F.array(*map(F.lit, xs)), F.expr(f"cast({by} as int)"))
    name = pick(NAMES, f"doc_id % {len(NAMES)}")
    d = t.raw("documents", "doc_id", "text").where("text is not null")
    d = d.select(F.col("doc_id").alias("id"), pick(LANDS, f"(doc_id div {len(NAMES)}) % {len(LANDS)}").alias("country_code"), name.alias("name"), F.expr(f"cast(doc_id % {len(forms)} as int)").alias("form"), F.col("text").alias("body"))
    sentence = F.replace(pick([f for f, _ in forms], f"id % {len(forms)}"), F.lit("{l}"), F.initcap("name"))
    return d.select("id", "country_code", "name", "form", language.signals(sentence, F.concat(F.lit(". "), "body"), F.col("country_code")).alias("said"))


def said_sql(forms: list[tuple[str, int]], when: str, out: str = "hit") -> str:
    """The same choices in SQL: `good` is the form's flag, `own` whether the name is a language of the country."""
    arr = lambda xs: "[" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in xs) + "]"
    own = " OR ".join(f"(country_code = '{c}' AND name = '{n}')" for c, n in OWN)
    return f"""WITH s AS (SELECT doc_id AS id, ({arr(NAMES)})[CAST(doc_id % {len(NAMES)} + 1 AS INTEGER)] AS name, ({arr(LANDS)})[CAST((doc_id // {len(NAMES)}) % {len(LANDS)} + 1 AS INTEGER)] AS country_code, ({arr([g for _, g in forms])})[CAST(doc_id % {len(forms)} + 1 AS INTEGER)] AS good FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, ({own}) AS own FROM s)
SELECT id, {when} AS {out} FROM w"""


ADVANTAGE_FORMS = [("{l} is a plus", 1), ("Knowledge of {l} would be an asset", 1), ("Nice to have: {l}", 1), ("{l} food is served", 0), ("We were founded by {l} people", 0)]


@query("phase_advantage", said_sql(ADVANTAGE_FORMS, "good = 1 AND own"))
def _(t):
    return said(t, ADVANTAGE_FORMS).select("id", F.col("said.advantage").isNotNull().alias("hit"))


GROUP_FORMS = [("Any Nordic language is an advantage", 1), ("Fluency in a Nordic language", 2), ("Another Baltic language would be a plus", 3), ("Baltic languages are required", 4), ("A Nordic team of {l} people", 0)]


@query("phase_group", said_sql(GROUP_FORMS, "CASE WHEN good IN (1, 2) AND country_code IN ('FI', 'SE', 'NO', 'DK', 'IS') OR good IN (3, 4) AND country_code IN ('LV', 'LT', 'EE') THEN CASE WHEN good IN (1, 3) THEN 'plus' ELSE 'required' END END", "kind"))
def _(t):
    return said(t, GROUP_FORMS).select("id", F.when(F.col("said.group_plus").isNotNull(), "plus").when(F.col("said.group_required").isNotNull(), "required").alias("kind"))


GENERIC_FORMS = [("Local language skills are a plus", 1), ("Knowledge of additional EU languages is a plus", 1), ("The local language is required", 2), ("Your local language ({l}) at work", 3), ("English in addition to Klingon or {l}", 5), ("Klingon, {l}, and English: Full fluency is required for all three languages", 4), ("A local company for {l} people", 0)]


# the local language is known only where the country is; one that is named counts anywhere
@query("phase_generic", said_sql(GENERIC_FORMS, "CASE WHEN good = 1 AND country_code NOT IN ('US', 'IN') THEN 'plus' WHEN good = 2 AND country_code NOT IN ('US', 'IN') OR good = 3 OR good = 5 AND own THEN 'required' WHEN good = 4 THEN name END", "kind"))
def _(t):
    s = said(t, GENERIC_FORMS)
    required = F.coalesce("said.generic", "said.your_local", "said.in_addition")
    return s.select("id", F.when(F.col("said.generic_plus").isNotNull(), "plus").when(required.isNotNull(), "required").when(F.size("said.listed") > 0, F.array_join("said.listed", "|")).alias("kind"))


CROSS_FORMS = [("Fluent in {l}", 1), ("You must speak {l}", 1), ("{l} skills are not required", 2), ("Ideally fluent in {l}", 1), ("{l} is required", 1), ("{l} or English", 0), ("{l} speaking people", 1), ("We like {l} food", 0)]


@query("phase_cross", said_sql(CROSS_FORMS, "CASE WHEN good > 0 THEN name END AS language, CASE WHEN good > 0 AND NOT own THEN CASE good WHEN 1 THEN 'required' ELSE 'welcome' END END", "says"))
def _(t):
    return said(t, CROSS_FORMS).select("id", F.get("said.requirements", F.lit(0))["language"].alias("language"), F.col("said.cross.says").alias("says"))


CONDITIONAL_FORMS = [("Depending on the location you speak {l}", 1), ("{l} or English, depending on your location", 1), ("Depending on the weather you speak {l}", 0)]


@query("phase_conditional", said_sql(CONDITIONAL_FORMS, "good = 1 AND own"))
def _(t):
    return said(t, CONDITIONAL_FORMS).select("id", F.coalesce("said.conditional", F.lit(False)).alias("hit"))


#: Cases, letters and paragraphs together, in the order of the phases.
SQL_REQUIREMENT = f"""WITH {SQL_POSTINGS}, {sql_chunks("post")}, codes(lang, language) AS ({values_sql(list(language.CODES.items()))}),
seen AS (SELECT found.doc_id, found.para, codes.language, EXISTS (SELECT 1 FROM own WHERE own.country = post.country AND own.language = codes.language) AS local,
 coalesce(length(p) - length(translate(p, chars, '')) >= {language.LEAST_LETTERS}, true) AS lettered, (codes.lang NOT IN {tuple(sorted(language.LONGER))} OR length(p) >= {language.LONGER_CHARS}) AND (codes.lang <> 'el' OR regexp_matches(p, '\\p{{Greek}}')) AS sure
 FROM found JOIN codes USING (lang) JOIN p ON p.doc_id = found.doc_id AND p.para = found.para JOIN post ON post.doc_id = found.doc_id LEFT JOIN letters ON letters.country = post.country),
par AS (SELECT doc_id, arg_min(language, para) FILTER (local AND lettered) AS mine, arg_min(language, para) FILTER (NOT local AND sure) AS other FROM seen GROUP BY 1),
locals AS (SELECT country, string_agg(upper(language[1]) || language[2:], '|') AS names FROM own GROUP BY 1),
told AS (SELECT native.*, mine, other, names, CASE WHEN NOT late THEN phase WHEN by_letters THEN '1b-chars' WHEN mine IS NOT NULL THEN '1c' WHEN other IS NOT NULL THEN '1c-any' ELSE phase END AS ph FROM native LEFT JOIN par USING (doc_id) LEFT JOIN locals ON locals.country = native.country)
SELECT doc_id AS id, country AS country_code, ph AS phase, CASE ph WHEN '1b-chars' THEN 'native letters' WHEN '1c' THEN mine WHEN '1c-any' THEN other ELSE matched END AS matched, CASE WHEN ph IN ('1b-chars', '1c', '1c-any') THEN true ELSE value END AS value,
ph = phase AND preferred <> '' AS advantage, CASE WHEN ph IN ('1b-chars', '1c') THEN coalesce(names, '') WHEN ph = '1c-any' THEN upper(other[1]) || other[2:] ELSE required END AS required, CASE WHEN ph = phase THEN preferred ELSE '' END AS preferred FROM told"""


@query("language_requirement", SQL_REQUIREMENT)
def _(t):
    profile = classify.build_lang_profile(t.raw("documents", "lang", "text"))
    x = language.detect_language_requirement(postings(t), profile)
    return x.select("id", "country_code", "phase", "matched", "value", "advantage", F.array_join("required", "|").alias("required"), F.array_join("preferred", "|").alias("preferred"))


@query("signal_text", "SELECT p_partkey AS id, lower(p_name || ' and co ' || p_type || '. ' || p_brand || ' speaking x speaking y speaking') AS text FROM part")
def _(t):
    text = F.concat(F.lit("& (co) "), "p_type", F.lit("\n\n"), "p_brand", F.lit(" speaking x/y speaking"))
    return t.raw("part").select(F.col("p_partkey").alias("id"), language.normalise_signal_text(F.col("p_name"), text).alias("text"))


@query("classify_postings")
def _(t):
    k = t.spark.createDataFrame(KEYWORDS, "category string, cat_no int, keyword string, kw_no int")
    s = t.spark.createDataFrame(SKILLS, "name string, skill_no int, aliases array<string>")
    jobs = postings(t).withColumns({"function": F.lit(None).cast("string"), "requires_native_language": F.when(F.col("id") % 10 == 0, True)})
    x = language.classify_postings(jobs, k, s)
    return x.withColumns({c: F.array_join(c, "|") for c in ("skills", "required_languages", "preferred_languages")})
