"""Scalar functions: Column to Column, all on the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str]:
    """Letters of one base letter plus combining marks, and their bases, from the Unicode tables (lower case, to U+1EFF)."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(c) <= 0x36F for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Accented letters to their base letters; combining marks U+0300 to U+036F go."""
    source, target = _decompositions()
    return F.regexp_replace(F.translate(c, source, target), "[̀-ͯ]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_ascii(c: Column) -> Column:
    """A slug without accent folding: what is not a-z or 0-9 becomes a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_keep(c: Column) -> Column:
    """A slug that keeps case: German letters spelled out, brackets dropped, / to _, other runs to hyphens."""
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.replace(F.regexp_replace(c, "[()]", ""), F.lit("/"), F.lit("_"))
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]+", "-"), "^-+|-+$", "")


def title_case_slug(c: Column) -> Column:
    """Hyphens and underscores to spaces, first letters to upper case, the rest as it is."""
    words = F.split(F.translate(c, "-_", "  "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def clean_name(c: Column) -> Column:
    """A name without a trailing language mark such as "- English"."""
    return F.trim(F.regexp_replace(c, r"(?i)\s*-\s*english\s*$", ""))


#: HTML names of characters that postings use.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "bull": "•", "hellip": "…", "rsquo": "’", "lsquo": "‘"}


def decode_entities(c: Column, names: dict[str, str] | None = None) -> Column:
    """Decimal and hexadecimal references, then names (&amp; last, so that nothing is decoded twice)."""
    names = ENTITIES if names is None else names
    pieces = F.regexp_extract_all(c, F.lit(r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(1))

    def one(acc: Column, ref: Column) -> Column:
        is_hex = ref.rlike("^[xX]")
        code = F.when(is_hex, F.conv(F.substring(ref, 2, 7), 16, 10)).otherwise(ref).cast("int")
        low = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        over = code - 0x10000
        pair = F.concat(F.lpad(F.hex(over.bitwiseAND(F.lit(0xFFC00)) / 1024 + 0xD800), 4, "0"), F.lpad(F.hex(over.bitwiseAND(F.lit(0x3FF)) + 0xDC00), 4, "0"))
        char = F.when((code >= 0xD800) & (code <= 0xDFFF) | (code == 0) | (code > 0x10FFFF), F.lit("�")).when(code < 0x10000, low).otherwise(F.decode(F.unhex(pair), "UTF-16BE"))
        return F.replace(acc, F.concat(F.lit("&#"), ref, F.lit(";")), char)

    # only texts with a numeric reference pay for the fold over them
    out = F.when(F.contains(c, F.lit("&#")), F.aggregate(pieces, c, one)).otherwise(c)
    for name, char in sorted(names.items(), key=lambda x: x[0] == "amp"):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


# Tags that end a line.
BLOCKS = "p|div|br|li|h[1-6]|tr|section|article|blockquote"


def html_to_text(html: Column) -> Column:
    """Text of a page: no scripts, styles, navigation and footers, a line for each block, entities decoded."""
    x = decode_entities(html)
    x = F.regexp_replace(x, r"(?is)<(script|style|nav|footer)\b[^>]*>.*?</\1\s*>", "")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", " ")
    x = F.regexp_replace(x, "[ \\t]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, "\n ", "\n"), "\n{3,}", "\n\n")
    return decode_entities(F.regexp_replace(x, r"^\s+|\s+$", ""))


def html_to_line(html: Column) -> Column:
    x = decode_entities(F.regexp_replace(html, "<[^>]*>", " "))
    return F.trim(F.regexp_replace(x, "[ \\t\\n\\x0B\\f\\r]+", " "))


def cut_at_marker(text: Column, markers: list[str]) -> Column:
    """The text before the first of the markers, in any case of letters."""
    places = [F.locate(m.lower(), F.lower(text)) for m in markers]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def quote(term: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in term)


def alternation(terms: list[str]) -> str:
    return "|".join(quote(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def drop_sections(text: Column, headings: list[str]) -> Column:
    """Drops sections (blank-line separated) whose first line starts with one of the headings."""
    return F.regexp_replace(text, rf"(?is)(?:^|\n\n)[ ]*(?:{alternation(headings)})[^\n]*(?:\n(?!\n)[^\n]*)*+", "")


def strip_terms(text: Column, terms: list[str]) -> Column:
    """Terms out of the text, longest first, runs of spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"(?i)(?:{alternation(terms)})", " "), " +", " "))


LATVIAN = "āčēģīķļņšūž"


def strip_bilingual(title: Column) -> Column:
    """Cuts a title at the first / after which the next part has Latvian letters."""
    parts = F.split(title, "/")
    n = F.size(parts)
    local = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.lower(F.get(parts, i)).rlike(f"[{LATVIAN}]"), F.lit(False)))
    return F.when(F.size(local) > 0, F.trim(F.array_join(F.slice(parts, F.lit(1), F.get(local, F.lit(0))), "/"))).otherwise(title)


def looks_non_english(title: Column, keywords: list[str], letters: str = "À-ÖØ-öø-ɏͰ-ӿ") -> Column:
    return F.coalesce(title.rlike(f"[{letters}]"), F.lit(False)) | F.coalesce(F.lower(title).rlike(alternation([k.lower() for k in keywords])), F.lit(False))


def title_cut(title: Column) -> Column:
    """The title without a part after its last spaced dash, an id before its first, and what follows a comma."""
    x = F.regexp_replace(title, r"^[A-Z]*[0-9]+ - ", "")
    x = F.regexp_replace(x, r"^(.*) [-–] .*$", "$1")
    return F.trim(F.substring_index(x, ",", 1))


def clean_url(url: Column, keep_query: bool = False) -> Column:
    x = F.trim(F.replace(F.replace(url, F.lit("&amp;"), F.lit("&")), F.lit("&amp;"), F.lit("&")))
    x = x if keep_query else F.substring_index(x, "?", 1)
    return F.regexp_replace(x, "([^:])/{2,}", "$1/")


def safe_url(url: Column) -> Column:
    """http, https and mailto addresses, out of a markdown link if need be; others are null."""
    x = F.trim(F.regexp_replace(F.trim(url), r"^\[[^\]]*\]\(([^)]*)\)$", "$1"))
    return F.when(x.rlike(r"(?i)^(?:https?://|mailto:)"), x)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def host_slug(host_: Column, subdomains: tuple[str, ...] = ("www", "jobs", "careers", "career", "m", "blog", "apply")) -> Column:
    """The label before the last one, after career-like subdomains are gone as long as more than two labels remain."""
    labels = F.split(host_, r"\.")
    lead = F.array(*[F.lit(s) for s in subdomains])
    peeled = F.aggregate(labels, labels, lambda acc, _: F.when((F.size(acc) > 2) & F.array_contains(lead, F.get(acc, F.lit(0))), F.slice(acc, F.lit(2), F.size(acc))).otherwise(acc))
    return F.when(F.size(peeled) > 1, F.get(peeled, F.size(peeled) - 2)).otherwise(F.get(peeled, F.lit(0)))


def absolute_url(base: Column, href: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.substring_index(F.substring_index(base, "#", 1), "?", 1), "([^/])/[^/]*$", "$1/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )


def url_parts(url: Column) -> Column:
    """Struct of host, path, language segment and query parameters as a map of arrays."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))
    values = F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == k), lambda p: F.regexp_extract(p, "=(.*)$", 1)))
    locale = F.regexp_extract(path(url), r"^/([a-z]{2}(?:[-_][A-Za-z]{2})?)(?:/|$)", 1)
    return F.struct(host(url).alias("host"), path(url).alias("path"), F.nullif(locale, F.lit("")).alias("locale"), F.map_from_arrays(keys, values).alias("params"))


WORK_MODELS = (("hybrid", "hybrid"), ("remote", "remote"), ("on-site", "on-site"), ("onsite", "on-site"), ("office", "on-site"))


def work_model(location: Column) -> Column:
    """hybrid, remote or on-site when all ;-separated parts start with the same of these words, else null."""
    firsts = F.transform(F.split(F.lower(location), ";"), lambda s: F.regexp_extract(F.trim(s), r"^(hybrid|remote|on-?site)\b", 1))
    kinds = F.array_distinct(F.transform(firsts, lambda k: F.when(k == "onsite", "on-site").otherwise(k)))
    return F.when((F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) != ""), F.get(kinds, F.lit(0)))


def work_model_of(kind: Column) -> Column:
    """A source's own word for the work model, by the first entry that it contains."""
    out = F.lit(None).cast("string")
    for word, model in reversed(WORK_MODELS):
        out = F.when(F.contains(F.lower(kind), F.lit(word)), F.lit(model)).otherwise(out)
    return out


def share(part: Column, total: Column, digits: int = 0) -> Column:
    """part / total in hundredths, half up, 0 where total is 0; decimal arithmetic, so no binary rounding."""
    p, t = part.cast("decimal(20,0)"), total.cast("decimal(20,0)")
    return F.when(total > 0, F.round(p * 100 / t, digits)).otherwise(F.lit(0)).cast("double")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of a canonical JSON of the columns; null fields are written, so that null and missing differ from a value."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def title_hash(title: Column) -> Column:
    return F.left(F.md5(title.cast("binary")), F.lit(8))


def first_non_blank(a: Column) -> Column:
    return F.get(F.filter(a, lambda x: F.trim(x) != ""), F.lit(0))


def normalised_aliases(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def other_than_english(languages: Column) -> Column:
    """Whether any language of the list is not English; null for a null list."""
    return F.exists(languages, lambda x: F.lower(x) != "english")
