"""Pages to rows: patterns where a pattern is enough, a small parser over Arrow batches where elements nest."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobloom.functions.columns import decode_entities, html_to_line, html_to_text
from jobloom.operators.classify import valid_title
from jobloom.sources.selectors import Element, Page, parse

# The parts of a page that are its frame, by tag, role and words of a class or id; what a class of a place says, and
# what in a place's stead names none; what the class or id of a posting, and the path of a link to one, says.
CHROME_TAGS, CHROME_ROLES = {"nav", "header", "footer"}, {"navigation", "banner", "contentinfo"}
CHROME_WORDS = {"nav", "navbar", "navigation", "menu", "megamenu", "footer", "social", "breadcrumb", "cookie", "newsletter", "subscribe", "sidebar", "topbar"}
PLACE_WORDS = ("location", "city", "country", "office", "place", "region", "area")
NO_PLACE = {"remote", "worldwide", "global", "anywhere", "wfh", "work from home", "home office", "europe", "emea", "apac"}
JOB_WORDS, LINK_WORDS = "(?i)job|position|opening|vacancy|career|role|listing|posting", "(?i)apply|job|position|career|opening|role|vacancy|posting"
#: Links and matches inside of one another that a container has at most; items and linked items of a list at least.
MAX_LINKS, MAX_NESTED, LEAST_ITEMS, LEAST_LINKED = 5, 2, 3, 2
HEADINGS = ("h1", "h2", "h3", "h4")
CARD = "page_id long, no int, title string, url string, location string, text string"
CANDIDATE = "page_id long, strategy int, no int, parent int, title string, url string, location string"


def _classes(e: Element) -> str:
    return f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".strip()


def _in_chrome(page: Page) -> list[bool]:
    """For each element whether it is part of the page's frame: itself or what it stands in."""
    out: list[bool] = []
    for e in page.elements:
        own = e.tag in CHROME_TAGS or e.attrs.get("role") in CHROME_ROLES or not CHROME_WORDS.isdisjoint(re.split("[-_ ]", _classes(e).lower()))
        out.append(own or e.parent is not None and out[e.parent.no])
    return out


def _told(page: Page, e: Element, headings: tuple[str, ...], title: str | None = None, url: str | None = None, place: str | None = None) -> dict:
    """Title (first heading, else first link, else the text), url (first link) and place of an element; selectors go before these rules."""
    inside = page.inside(e)
    pick = lambda selector: next(iter(page.find(selector, e)), None) if selector else None
    link = next((x for x in inside if x.tag == "a" and "href" in x.attrs), None)
    at = pick(url)
    href = at.attrs.get("href") if at else link.attrs["href"] if link else None
    at = pick(title)
    said = page.text(at) if at else next((x for h in inside if h.tag in headings and (x := page.text(h))), None)
    if said is None and link:
        said = page.text(link) or None
    if said is None:
        said, href = page.text(e), None if url is None else href
    at = pick(place)
    places = [page.text(at)] if at else (page.text(x) for x in inside if any(w in x.attrs.get("class", "").lower() for w in PLACE_WORDS))
    return {"no": e.no, "title": said, "url": href, "location": next((x for x in places if x and x.lower() not in NO_PLACE), None)}


def _text_rows(pages: DataFrame, rows_of: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """Rows of each (page_id, html) in Arrow batches; a null or empty page has none."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page_id, html in zip(b.column(0), b.column(1), strict=True):
                rows = rows_of(html.as_py()) if len(html.as_py() or "") else []
                if rows:
                    yield pa.RecordBatch.from_pylist([{**r, "page_id": page_id.as_py()} for r in rows], schema=arrow)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def _page_rows(pages: DataFrame, rows_of: Callable[[Page], list[dict]], schema: str) -> DataFrame:
    """Rows of each page, which is parsed once."""
    return _text_rows(pages, lambda html: rows_of(Page(html)), schema)


def select(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, no, tag, text, html, attrs): the elements of (page_id, html) that a selector matches, with their text and inner markup."""
    steps = parse(selector)
    return _page_rows(pages, lambda p: [{"no": e.no, "tag": e.tag, "text": p.text(e), "html": p.markup(e), "attrs": e.attrs} for e in p.find(steps)], "page_id long, no int, tag string, text string, html string, attrs map<string,string>")


#: Words after which a card says its place.
EMPLOYMENT = r"(?i)(?:full[- ]time|part[- ]time|contract|internship|temporary|permanent)\s+"


def cards(pages: DataFrame, selector: str, preset: str | None = None, title: str | None = None, url: str | None = None, location: str | None = None) -> DataFrame:
    """(page_id, no, title, url, location, more): the elements that a selector matches, in the frame or not.

    title, url and location are selectors inside a card; without one, title is the first heading h2 to h4 (else first link), url the first
    link, location the first text of a class like a place. Presets read the rest of a card: middot (place after the last ·,
    without "Office"), token_list (place after a word of employment), or_list ("A or B": one row a place), tile (place before the
    first |, more the parts after it), accordion (more the label: value pairs). Cards without a title are left out.
    """
    steps, by = parse(selector), {k: parse(v) for k, v in {"title": title, "url": url, "place": location}.items() if v}
    e = _page_rows(pages, lambda p: [{**_told(p, x, ("h2", "h3", "h4"), **by), "text": p.text(x)} for x in p.find(steps)], CARD).where("title <> ''")
    rest = F.trim(F.replace("text", F.col("title"), F.lit("")))
    more = F.array().cast("array<string>")
    place = F.col("location")
    if preset == "middot":
        place = F.trim(F.regexp_replace(F.element_at(F.split(rest, "·"), -1), r"(?i)^\s*office\s*[:,-]?\s*", ""))
    elif preset == "token_list":
        place = F.regexp_extract(rest, EMPLOYMENT + "(.*)$", 1)
    elif preset == "tile":
        parts = F.transform(F.split(rest, r"\|"), lambda p: F.trim(p))
        place, more = F.coalesce(F.nullif(parts[0], F.lit("")), place), F.slice(parts, 2, F.size(parts))
    elif preset == "accordion":
        more = F.transform(F.regexp_extract_all(rest, F.lit(r"([\p{L} ]+:\s*[^:]+?)(?=\s+\p{L}+:|$)"), F.lit(1)), lambda p: F.trim(p))
    out = e.select("page_id", "no", "title", "url", F.nullif(place, F.lit("")).alias("location"), more.alias("more"))
    if preset == "or_list":
        out = out.withColumn("location", F.explode_outer(F.split("location", r"\s+or\s+|,\s*")))
    return out


def candidates(pages: DataFrame, strategies: tuple[int, ...] = (1, 2, 3), like: str = JOB_WORDS, link_like: str = LINK_WORDS) -> DataFrame:
    """(page_id, strategy, no, title, url, location) of all strategies from one parse of each page, outside of its frame.

    1: elements whose class or id looks right, with a link, few links and few such elements inside; 2: items of lists of 3 or more, of
    which max(2, half) with a valid title have a link; 3: links whose path looks right with a title of 4 characters or more.
    """

    def found(page: Page) -> list[dict]:
        named, path = re.compile(like), re.compile(link_like)
        chrome, all_ = _in_chrome(page), page.elements
        links, matches = [0], [0]  # running counts, so that what is inside an element is a difference
        for e in all_:
            links.append(links[-1] + (e.tag == "a" and "href" in e.attrs))
            matches.append(matches[-1] + bool(named.search(e.attrs.get("class", ""))))
        items: dict[int, int] = {}
        for e in all_:
            if e.tag == "li" and e.parent is not None:
                items[e.parent.no] = items.get(e.parent.no, 0) + 1
        rows = []
        for e in all_:
            if chrome[e.no]:
                continue
            n_links = links[e.last + 1] - links[e.no + 1]
            if 1 in strategies and 0 < n_links <= MAX_LINKS and matches[e.last + 1] - matches[e.no + 1] <= MAX_NESTED and named.search(_classes(e)):
                rows.append({**_told(page, e, HEADINGS), "strategy": 1})
            if 2 in strategies and e.tag == "li" and e.parent is not None and e.parent.tag in ("ul", "ol") and items[e.parent.no] >= LEAST_ITEMS:
                rows.append({**_told(page, e, HEADINGS), "strategy": 2, "parent": e.parent.no})
            if 3 in strategies and e.tag == "a" and path.search(re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*|[?#].*$", "", e.attrs.get("href", ""), flags=re.S)):
                rows.append({"strategy": 3, "no": e.no, "title": page.text(e), "url": e.attrs["href"]})
        return rows

    x = _page_rows(pages, found, CANDIDATE).where(valid_title(F.col("title")) & ((F.col("strategy") == 2) | F.col("url").isNotNull()) & ((F.col("strategy") != 3) | (F.length("title") >= 4)))
    if 2 in strategies:
        per = W.partitionBy("page_id", "strategy", "parent")  # items of one page
        x = x.withColumns({"_n": F.count("*").over(per), "_linked": F.count("url").over(per)})
        x = x.where((F.col("strategy") != 2) | (F.col("_linked") >= F.greatest(F.lit(LEAST_LINKED), F.floor(F.col("_n") / 2))))
    return x.select("page_id", "strategy", "no", "title", "url", "location")


def containers(pages: DataFrame, like: str = JOB_WORDS) -> DataFrame:
    """Strategy 1 of `candidates`."""
    return candidates(pages, (1,), like)


def lists(pages: DataFrame) -> DataFrame:
    """Strategy 2 of `candidates`."""
    return candidates(pages, (2,))


def links(pages: DataFrame, like: str = LINK_WORDS) -> DataFrame:
    """Strategy 3 of `candidates`."""
    return candidates(pages, (3,), link_like=like)


def best_rows(pages: DataFrame) -> DataFrame:
    """The best strategy's rows of each page, see `best_of`; a page is parsed once for all strategies."""
    return best_of([candidates(pages)])


def best_of(frames: list[DataFrame]) -> DataFrame:
    """For each page the rows of the strategy with most rows (ties: the earlier), then the first row of each url."""
    x = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    per = x.groupBy("page_id", "strategy").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.max_by("strategy", F.struct("n", -F.col("strategy"))).alias("strategy"))
    x = x.join(per, ["page_id", "strategy"])
    return x.withColumn("rn", F.row_number().over(W.partitionBy("page_id", "url").orderBy("no"))).where("rn = 1").drop("rn")


def descriptions(pages: DataFrame, selector: str | None = None, fallback: tuple[str, ...] = ("article", "main"), script_key: str | None = "description", least: int = 200) -> DataFrame:
    """(page_id, text): the text of all outermost elements that the selector matches, else of the first of `fallback` that has enough.

    Where none has `least` characters, the text under `script_key` in the page's JSON scripts stands if it has, else the text of the page. An
    element's text is that of all it holds, however often its tag is nested. A null page has a null text.
    """
    chain = [s for s in (selector, *fallback) if s]

    def found(page: Page) -> list[dict]:
        scripts = (json_under(page.markup(e), script_key) for e in page.elements if e.tag == "script") if script_key else ()
        return [{"found": ["\n".join(page.markup(e) for e in page.outermost(s)) for s in chain], "script": next((x for x in scripts if isinstance(x, str)), None)}]

    x = _page_rows(pages, found, "page_id long, found array<string>, script string")
    good = lambda c: F.when(F.length(c) >= least, c)
    picked = F.coalesce(*[good(html_to_text(F.get("found", F.lit(i)))) for i in range(len(chain))], good(html_to_text(F.col("script"))))
    return pages.select("page_id", "html").join(x, "page_id", "left").select("page_id", F.coalesce(picked, html_to_text(F.col("html"))).alias("text"))


def capture(html: Column, pattern: str, fallback: Column | None = None) -> Column:
    """The first group of a pattern, null without a match (or the fallback)."""
    found = F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    return found if fallback is None else F.coalesce(found, fallback)


def label_value(html: Column, label: str) -> Column:
    """The text of the dd after the dt with this label."""
    return F.nullif(html_to_line(F.regexp_extract(html, rf"(?is)<dt\b[^>]*>\s*{label}\s*</dt>\s*<dd\b[^>]*>(.*?)</dd>", 1)), F.lit(""))


def meta_description(html: Column) -> Column:
    a = F.regexp_extract(html, r'(?i)<meta\s+(?:name="description"|property="og:description")\s+content="([^"]*)"', 1)
    b = F.regexp_extract(html, r'(?i)<meta\s+content="([^"]*)"\s+(?:name="description"|property="og:description")', 1)
    return F.coalesce(F.nullif(decode_entities(a), F.lit("")), F.nullif(decode_entities(b), F.lit("")))


def select_options(pages: DataFrame, selector: str = "option", value: str = "value", skip: tuple[str, ...] = ("", "all"), prefix: str = "") -> DataFrame:
    """(page_id, no, label, value): label and value (an attribute, without `prefix`) of the elements that a selector matches, without values to skip."""
    v = F.coalesce(F.try_element_at("attrs", F.lit(value)), F.lit(""))
    v = F.when(F.startswith(v, F.lit(prefix)), F.substring(v, F.lit(len(prefix) + 1), F.length(v))).otherwise(v)
    return select(pages, selector).select("page_id", "no", F.col("text").alias("label"), v.alias("value")).where(~F.lower("value").isin(*skip))


def attribute_json(pages: DataFrame, tag: str, attr: str, schema: str) -> DataFrame:
    """(page_id, pos, item...): rows of a JSON array that stands in an element's attribute; parallel lists fan out.

    `schema` is that of an item; with fields countries and locations, each country takes the location of its place, or the first.
    """
    raw = decode_entities(F.regexp_extract("html", rf'(?is)<{tag}\b[^>]*\s{attr}="([^"]*)"', 1))
    x = pages.select("page_id", F.posexplode(F.from_json(raw, f"array<struct<{schema}>>")).alias("pos", "item"))
    if "countries:" not in schema:
        return x.select("page_id", "pos", "item.*")
    x = x.select("page_id", "pos", "item", F.posexplode_outer("item.countries").alias("i", "country"))
    return x.select("page_id", "pos", "item.*", "country", F.coalesce(F.get("item.locations", F.col("i")), F.get("item.locations", F.lit(0))).alias("location"))


def json_values(text: str, marker: str, opening: str) -> Iterator[object]:
    """The values that begin with an opening bracket behind a marker, each read to its own end whatever follows; broken ones are left out."""
    decode, at = json.JSONDecoder().raw_decode, text.find(marker)
    while at >= 0:
        start = at + len(marker)
        while start < len(text) and text[start] in " \t\r\n:=":
            start += 1
        end = start + 1
        if text[start : start + 1] and text[start] in opening:
            try:
                value, end = decode(text, start)
                yield value
            except ValueError:
                pass
        at = text.find(marker, min(max(end, at + len(marker)), len(text)))


def json_under(text: str, key: str) -> object:
    """The first value under a key in a text with JSON in it, else None."""
    return next(json_values(text, json.dumps(key), '[{"'), None)


def script_json(pages: DataFrame, key: str, schema: str) -> DataFrame:
    """(page_id, item...): the items of all JSON arrays under a key in escaped script chunks push([n,"..."]), which are one text."""
    chunk = re.compile(r'push\(\[\d+,("(?:[^"\\]|\\.)*+")\]\)')

    def found(page_html: str) -> list[dict]:
        text = "".join(json.loads(c, strict=False) for c in chunk.findall(page_html))
        return [{"no": i, "item": json.dumps(x)} for i, x in enumerate(x for a in json_values(text, json.dumps(key), "[") for x in a)]

    x = _text_rows(pages, found, "page_id long, no int, item string")
    return x.select("page_id", "no", F.from_json("item", schema).alias("item")).select("page_id", "item.*")


def marker_json(pages: DataFrame, marker: str) -> DataFrame:
    """(page_id, payload): the JSON object that begins after the first marker in a page, as text; pages without one are left out."""

    def found(html: str) -> list[dict]:
        at = html.find(marker)
        start = html.find("{", at + len(marker)) if at >= 0 else -1
        try:
            return [{"payload": json.dumps(json.JSONDecoder().raw_decode(html, start)[0], sort_keys=True)}] if start >= 0 else []
        except ValueError:
            return []

    return _text_rows(pages, found, "page_id long, payload string")


def repair_xml(xml: Column) -> Column:
    """Drops character references that XML does not allow; pairs of surrogate references become one."""
    pair = re.compile(r"&#(5[56]\d{3});&#(5[67]\d{3});")

    @F.pandas_udf("string")
    def join_pairs(s: pd.Series) -> pd.Series:
        one = lambda m: chr(0x10000 + ((int(m[1]) - 0xD800) << 10) + int(m[2]) - 0xDC00) if 0xD800 <= int(m[1]) < 0xDC00 <= int(m[2]) < 0xE000 else ""
        return s.map(lambda x: pair.sub(one, x))

    x = F.when(xml.rlike(r"&#5[56]\d{3};&#5[67]\d{3};"), join_pairs(xml)).otherwise(xml)
    return F.regexp_replace(x, r"&#(?:[0-8]|1[124-9]|2\d|3[01]|55[3-9]\d{2}|5[67]\d{3}|x[0-8a-fA-F]);", "")


def xml_rows(feeds: DataFrame, row_tag: str, fields: dict[str, str]) -> DataFrame:
    """(feed_id, no, fields...): rows of an XML text by their tag; fields by element name, CDATA unwrapped, entities decoded."""
    x = feeds.select("feed_id", F.posexplode(F.regexp_extract_all(repair_xml(F.col("xml")), F.lit(rf"(?s)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"), F.lit(1))).alias("no", "row"))
    one = lambda name: decode_entities(F.trim(F.regexp_replace(F.regexp_extract("row", rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))
    return x.select("feed_id", "no", *[(F.upper(one(p)) if k == "country_code" else one(p)).alias(k) for k, p in fields.items()])
