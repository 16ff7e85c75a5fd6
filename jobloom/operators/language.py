"""Whether a posting asks for the local language: phases in order, the first that hits decides.

Phases: 1a title in another language; 1b advantage phrases (a language, a group, "local language"); 1b-chars native letters; 1c text
in the country's language; 1c-any text in another known language; 2a requirement phrases (generic, group, per language with
negation, other languages); 2b "depending on location"; 2c none. What phrases, lists and clauses say is read in one pass a
text (`signals.py`) in Arrow batches; the order of the phases is an expression.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions.columns import looks_non_english
from jobloom.operators.signals import GROUPS, Forms, Reader, one_line

# The languages of a country, what a language is called, letters that tell a country's language and how many it
# takes, codes of identified languages, and languages whose paragraphs have to be longer.
COUNTRY_LANGUAGES = {
    "FI": ["finnish"], "SE": ["swedish"], "NO": ["norwegian"], "DK": ["danish"], "IS": ["icelandic"], "DE": ["german"], "AT": ["german"], "CH": ["german", "french", "italian"], "NL": ["dutch"], "BE": ["dutch", "french"],
    "FR": ["french"], "LU": ["luxembourgish", "french", "german"], "IT": ["italian"], "ES": ["spanish"], "PT": ["portuguese"], "PL": ["polish"], "CZ": ["czech"], "SK": ["slovak"], "HU": ["hungarian"], "RO": ["romanian"], "BG": ["bulgarian"],
    "HR": ["croatian"], "SI": ["slovenian"], "RS": ["serbian"], "EE": ["estonian"], "LV": ["latvian"], "LT": ["lithuanian"], "GR": ["greek"], "TR": ["turkish"], "UA": ["ukrainian"], "RU": ["russian"], "GE": ["georgian"], "IL": ["hebrew"],
    "JP": ["japanese"], "CN": ["chinese"], "KR": ["korean"], "BA": ["bosnian", "croatian", "serbian"], "MK": ["macedonian"], "ME": ["montenegrin"], "AL": ["albanian"], "MD": ["romanian"], "BY": ["belarusian", "russian"],
}
LANGUAGE_WORDS = {
    "finnish": "finnish suomi suomen", "swedish": "swedish svenska", "norwegian": "norwegian norsk bokmål nynorsk", "danish": "danish dansk", "icelandic": "icelandic íslenska", "german": "german deutsch", "luxembourgish": "luxembourgish luxembourgeois lëtzebuergesch",
    "dutch": "dutch nederlands flemish", "french": "french français francais", "italian": "italian italiano", "spanish": "spanish español espanol castellano", "portuguese": "portuguese português portugues", "polish": "polish polski", "czech": "czech čeština cestina",
    "slovak": "slovak slovenčina", "hungarian": "hungarian magyar", "romanian": "romanian română romana moldovan", "bulgarian": "bulgarian български", "croatian": "croatian hrvatski", "slovenian": "slovenian slovenščina", "serbian": "serbian srpski", "estonian": "estonian eesti",
    "latvian": "latvian latviešu", "lithuanian": "lithuanian lietuvių", "greek": "greek ελληνικά", "turkish": "turkish türkçe", "ukrainian": "ukrainian українська", "russian": "russian русский", "georgian": "georgian ქართული", "hebrew": "hebrew עברית", "japanese": "japanese 日本語",
    "chinese": "chinese mandarin 普通话", "korean": "korean 한국어", "bosnian": "bosnian", "macedonian": "macedonian", "montenegrin": "montenegrin", "albanian": "albanian shqip", "belarusian": "belarusian", "arabic": "arabic",
}
LETTERS = {
    "FI": ("äöÄÖ", 15), "SE": ("äöåÄÖÅ", 15), "NO": ("æøåÆØÅ", 15), "DK": ("æøåÆØÅ", 10), "IS": ("þðÞÐ", 10), "DE": ("äöüßÄÖÜ", 10), "AT": ("äöüßÄÖÜ", 10), "EE": ("äöõÄÖÕ", 10),
    "LV": ("āčēģīķļņšūžĀČĒĢĪĶĻŅŠŪŽ", 15), "LT": ("ąčęėįšųūžĄČĘĖĮŠŲŪŽ", 15), "PL": ("ąćęłńśźżĄĆĘŁŃŚŹŻ", 10), "FR": ("éèêëàâîïôùûçœÉÈÊËÀÂÎÏÔÙÛÇŒ", 25),
}
CODES = {"fi": "finnish", "sv": "swedish", "no": "norwegian", "nb": "norwegian", "nn": "norwegian", "da": "danish", "is": "icelandic", "nl": "dutch", "de": "german", "fr": "french", "it": "italian", "es": "spanish", "pt": "portuguese", "pl": "polish", "cs": "czech", "sk": "slovak", "hu": "hungarian", "ro": "romanian", "hr": "croatian", "sl": "slovenian", "sr": "serbian", "et": "estonian", "lv": "latvian", "lt": "lithuanian", "bg": "bulgarian", "el": "greek", "tr": "turkish", "uk": "ukrainian", "ru": "russian"}
LONGER = {"fr", "es", "it", "pt", "ro", "el", "nl", "de", "cs", "sk", "pl", "hr", "sl", "hu", "no"}
LEAST_LETTERS, LONGER_CHARS = 2, 400
TITLE_WORDS = ["entwickler", "mitarbeiter", "kehittäjä", "utvecklare", "asiantuntija", "rådgiver", "medarbejder", "développeur", "ingénieur", "desarrollador", "spécialiste"]

#: What a text says, see `signals`. `requirements` and `cross` say "required" or "welcome".
SAID = "struct<language:string,says:string,matched:string>"
SIGNALS = f"""struct<advantage:string,group_plus:string,generic_plus:string,generic:string,your_local:string,your_local_language:string,group_required:string,
listed:array<string>,listed_match:string,requirements:array<{SAID}>,own:{SAID},in_addition:string,cross:{SAID},conditional:boolean>"""


def normalise_signal_text(title: Column, description: Column) -> Column:
    """Title and description as one line for `signals`, see `signals.one_line`. Arrow batches."""

    @F.pandas_udf("string")
    def line(titles: pd.Series, descriptions: pd.Series) -> pd.Series:
        return pd.Series([one_line(t, d) for t, d in zip(titles, descriptions, strict=True)], dtype=object)

    return line(title, description)


@lru_cache(maxsize=4)
def _reader(forms: Forms | None) -> Reader:
    return Reader(forms or Forms({k: v.split() for k, v in LANGUAGE_WORDS.items()}))


def read_signals(text: str | None, country: str | None, reader: Reader | None = None) -> dict | None:
    """What one normalised text says, for a posting in a country; None if it names no language and does not speak of any."""
    if not text:
        return None
    r = (reader or _reader(None)).read(text)
    if not r.spans and "language" not in text:
        return None
    langs = COUNTRY_LANGUAGES.get(country or "", [])
    group = next((g for g, cs in GROUPS.items() if country in cs), None)
    welcomes = r.welcomes()
    found = r.requirements(welcomes)
    genuine = any(found.get(x, ("",))[0] == "required" for x in langs)
    told = [(x, *found[x]) for x in LANGUAGE_WORDS if x in found]
    said = {x: found.get(x) or ("welcome", r.original(*welcomes[x])) for x in LANGUAGE_WORDS if x in found or x in welcomes}
    local, listed, addition = r.your_local(), r.all_required(), r.in_addition()
    as_said = lambda x: dict(zip(("language", "says", "matched"), x, strict=True)) if x else None
    return {
        "advantage": None if genuine else next((r.original(*welcomes[x]) for x in langs if x in welcomes), None), "group_plus": r.group("welcome", group), "generic_plus": r.generic_welcome() if langs else None,
        "generic": r.generic() if langs else None, "your_local": local and local[1], "your_local_language": local and local[0], "group_required": r.group("required", group), "listed": listed[0] if listed else [], "listed_match": listed and listed[1],
        "requirements": [as_said(x) for x in told], "own": as_said(next(((x, *found[x]) for x in langs if x in found and (not genuine or found[x][0] == "required")), None)),
        "in_addition": next((addition[x] for x in langs if x in addition), None), "cross": as_said(next(((x, *v) for x, v in said.items() if x not in langs), None)), "conditional": bool(langs) and not r.depending().isdisjoint(langs),
    }


def signals(title: Column, description: Column, country: Column, forms: Forms | None = None) -> Column:
    """Struct of what a posting's title and description say (`SIGNALS`); all null where they say nothing. Arrow batches, one pass a text."""
    names = [f.name for f in T._parse_datatype_string(SIGNALS).fields]

    @F.pandas_udf(SIGNALS)
    def read(titles: pd.Series, descriptions: pd.Series, countries: pd.Series) -> pd.DataFrame:
        reader = _reader(forms)
        rows = [read_signals(one_line(t, d), c, reader) or {} for t, d, c in zip(titles, descriptions, countries, strict=True)]
        return pd.DataFrame([[row.get(n) for n in names] for row in rows], columns=names, dtype=object)

    # as it reads each text once, the optimiser is not to write the call out for every field that is used
    return read.asNondeterministic()(title, description, country)


def phase_title(title: Column, words: list[str] | None = None) -> Column:
    return looks_non_english(title, words or TITLE_WORDS)


def own_languages(country: Column) -> Column:
    """Languages of a country; none for one that is not in the dictionary."""
    langs = F.create_map(*[x for c, ls in COUNTRY_LANGUAGES.items() for x in (F.lit(c), F.array(*map(F.lit, ls)))])
    return F.coalesce(F.try_element_at(langs, country), F.array().cast("array<string>"))


def paragraph_languages(jobs: DataFrame, profile: DataFrame, key: str = "id") -> DataFrame:
    """(key, country_code, native, foreign): the first paragraph language that is the country's, and that is another known one.

    A paragraph in the country's language has two of its letters where it has letters of its own; one in another language
    has 400 characters for the languages that are taken for English easily, and a Greek letter if it is Greek.
    """
    from jobloom.operators.classify import chunk_language, paragraphs

    texts = jobs.select(key, "description").where("description is not null").dropDuplicates([key])
    names = F.create_map(*[y for c, l in CODES.items() for y in (F.lit(c), F.lit(l))])
    seen = chunk_language(texts, key, "description", profile).withColumn("language", F.try_element_at(names, F.col("lang"))).where("language is not null")
    x = seen.join(paragraphs(texts, key, "description"), [key, "para"]).join(jobs.select(key, "country_code").distinct(), key)
    letters = F.create_map(*[y for c, (chars, _) in LETTERS.items() for y in (F.lit(c), F.lit(chars))])
    x = x.withColumns({"langs": own_languages(F.col("country_code")), "letters": F.try_element_at(letters, F.col("country_code"))})
    own = F.array_contains("langs", F.col("language")) & (F.col("letters").isNull() | (F.length("p") - F.length(F.expr("translate(p, letters, '')")) >= LEAST_LETTERS))
    other = (~F.col("lang").isin(*LONGER) | (F.length("p") >= LONGER_CHARS)) & ((F.col("lang") != "el") | F.col("p").rlike("[\\u0370-\\u03ff\\u1f00-\\u1fff]"))
    first = lambda c: F.min(F.when(c, F.struct("para", "language")))["language"]
    return x.groupBy(key, "country_code").agg(first(own).alias("native"), first(other & ~F.array_contains("langs", F.col("language"))).alias("foreign"))


def detect_language_requirement(jobs: DataFrame, profile: DataFrame | None = None, key: str = "id", forms: Forms | None = None, title_words: list[str] | None = None) -> DataFrame:
    """(key, country_code, value, advantage, required, preferred, phase, matched) for (key, country_code, title, description) rows.

    `forms` are the phrases around a language, `title_words` words that show a title to be in another language (`classify.title_words`
    makes such a list of labelled texts). With a language
    profile, paragraphs are identified too (1c and 1c-any); the original uses a third-party model there, so these phases need
    not agree with it. Texts of any length are read whole, in time proportional to it; a null title or description is empty.
    """
    x = jobs.select(key, "country_code", "title", F.coalesce("description", F.lit("")).alias("description"))
    x = x.withColumns({"langs": own_languages(F.col("country_code")), "said": signals(F.col("title"), F.col("description"), F.col("country_code"), forms)})
    letters = F.coalesce(*[F.when((F.col("country_code") == c) & (F.length("description") - F.length(F.translate("description", chars, "")) >= n), F.lit("native letters")) for c, (chars, n) in LETTERS.items()])
    none = F.array().cast("array<string>")
    langs, said = F.col("langs"), lambda name: F.col(f"said.{name}")
    shown = lambda names: F.transform(names, lambda n: F.initcap(n))

    def phase(name: str, matched: Column, value: bool, required: Column = none, preferred: Column = none) -> Column:
        return F.when(matched.isNotNull(), F.struct(F.lit(name).alias("phase"), matched.alias("matched"), F.lit(value).alias("value"), F.lit(not value and name != "2c").alias("advantage"), shown(required).alias("required"), shown(preferred).alias("preferred")))

    def by_clause(name: str, entry: str, names: Column) -> list[Column]:
        """A requirement, or what its clause makes a welcome."""
        matched = lambda says: F.when(said(f"{entry}.says") == says, said(f"{entry}.matched"))
        return [phase(name, matched("required"), True, names), phase(name, matched("welcome"), False, preferred=names)]

    by_paragraph = []
    if profile is not None:
        x = x.join(paragraph_languages(jobs, profile, key), [key, "country_code"], "left")
        by_paragraph = [phase("1c", F.col("native"), True, langs), phase("1c-any", F.col("foreign"), True, F.array("foreign"))]

    decided = F.coalesce(
        phase("1a", F.when(phase_title(F.col("title"), title_words) & (F.size("langs") > 0), F.col("title")), True, langs),
        phase("1b", said("advantage"), False, preferred=langs),
        phase("1b-group", F.coalesce(said("group_plus"), said("generic_plus")), False, preferred=langs),
        phase("1b-chars", letters, True, langs),
        *by_paragraph,
        phase("2a-generic", said("generic"), True, langs),
        phase("2a-generic", said("your_local"), True, F.array(said("your_local_language"))),
        phase("2a-group", said("group_required"), True, langs),
        phase("2a-all", said("listed_match"), True, said("listed")),
        *by_clause("2a", "own", langs),
        phase("2a-generic", said("in_addition"), True, langs),
        *by_clause("2a-cross", "cross", F.array(said("cross.language"))),
        phase("2b", F.when(said("conditional"), F.lit("depending on location")), True, langs),
        phase("2c", F.lit(""), False),
    )
    return x.select(key, "country_code", decided.alias("d")).select(key, "country_code", "d.*")


def without_proper_nouns(text: Column, company: Column, names: list[str]) -> Column:
    """A text without the company's name and other names, whatever their case: they say nothing on a posting's language."""
    text = F.when(company.isNotNull() & (company != ""), F.regexp_replace(text, F.concat(F.lit("(?i)\\Q"), F.replace(company, F.lit("\\E"), F.lit("")), F.lit("\\E")), F.lit(" "))).otherwise(text)
    pattern = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return F.regexp_replace(text, f"(?iu){pattern}", " ") if names else text


def classify_postings(jobs: DataFrame, keywords: DataFrame, skills: DataFrame, profile: DataFrame | None = None, place_names: list[str] | None = None, forms: Forms | None = None) -> DataFrame:
    """Category, skills, education floor and language requirement of (id, country_code, title, description, function, requires_native_language) rows.

    Where `jobs` has them: `description_html` goes before `description` for category and language (markup removed), while skills
    and education come from the plain description if there is one; `classifier_title` goes before `title`; the `company` name and
    `place_names` with letters beyond ASCII are left out of what the language is read from. A posting's own flag on language
    goes before what its text says.
    """
    from jobloom.functions.columns import html_to_text
    from jobloom.operators.classify import classify_category, education_floor, extract_skills

    has = lambda c, otherwise: F.coalesce(c, otherwise) if c in jobs.columns else otherwise
    html = html_to_text(F.col("description_html")) if "description_html" in jobs.columns else F.lit(None).cast("string")
    x = jobs.select("id", "country_code", has("classifier_title", F.col("title")).alias("title"), F.coalesce(html, html_to_text(F.col("description")) if "description_html" in jobs.columns else F.col("description")).alias("description"), F.coalesce(F.col("description"), html).alias("plain"), "function", "requires_native_language", (F.col("company") if "company" in jobs.columns else F.lit(None).cast("string")).alias("company"))
    one = x.dropDuplicates(["id"])
    names = [n for n in place_names or [] if not n.isascii()]
    read = x.select("id", "country_code", *[without_proper_nouns(F.col(c), F.col("company"), names).alias(c) for c in ("title", "description")])
    lang = detect_language_requirement(read, profile, forms=forms).withColumnRenamed("value", "_value")
    x = x.join(lang, ["id", "country_code"], "left").join(classify_category(one, "id", keywords).select("id", "category"), "id", "left").join(extract_skills(one, "id", "plain", skills), "id", "left")
    none = F.array().cast("array<string>")
    return x.select("id", "country_code", "category", F.coalesce("skills", none).alias("skills"), education_floor(F.col("plain")).alias("required_education"), F.coalesce("requires_native_language", "_value").alias("requires_native_language"), F.coalesce("advantage", F.lit(False)).alias("local_language_advantage"), F.coalesce("required", none).alias("required_languages"), F.coalesce("preferred", none).alias("preferred_languages"), "phase")


__all__ = ["classify_postings", "detect_language_requirement", "normalise_signal_text", "own_languages", "paragraph_languages", "phase_title", "read_signals", "signals", "without_proper_nouns"]
