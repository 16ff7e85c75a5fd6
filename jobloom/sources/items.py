"""Generic items: dot-paths into JSON, configured row mapping, templates, source kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.columns import decode_entities, host, host_slug, path, slug_ascii, slug_keep


def _json_path(dotted: str) -> str:
    return "$" + "".join(f".{p}" if not p.isdigit() else f"[{p}]" for p in dotted.split(".") if p)


def explode_items(df: DataFrame, payload: str, items_path: str = "") -> DataFrame:
    """One row for each element of the array at a dot-path of a JSON text, as a variant `item` with its place `ord`.

    A payload that does not parse, or has no array there, gives no rows.
    """
    at = F.try_variant_get(F.try_parse_json(payload), _json_path(items_path), "array<variant>")
    return df.select(*[c for c in df.columns if c != payload], F.posexplode(at).alias("ord", "item"))


def get_string(item: Column, dotted: str) -> Column:
    """A scalar as text; of an array its first element; null for what is missing or an object."""
    first = F.try_variant_get(item, _json_path(dotted) + "[0]", "string")
    return F.coalesce(F.try_variant_get(item, _json_path(dotted), "string"), first)


def get_strings(item: Column, dotted: str) -> Column:
    """All texts of an array, or of an object's values; one scalar as an array of one; empty for what is missing."""
    p = _json_path(dotted)
    listed = F.try_variant_get(item, p, "array<string>")
    values = F.map_values(F.try_variant_get(item, p, "map<string,string>"))
    one = F.try_variant_get(item, p, "string")
    return F.filter(F.coalesce(listed, values, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")), lambda x: x.isNotNull())


def extract_paths(df: DataFrame, payload: str, items_path: str, fields: dict[str, str]) -> DataFrame:
    x = explode_items(df, payload, items_path)
    return x.select(*[c for c in x.columns if c != "item"], *[get_string(F.col("item"), p).alias(k) for k, p in fields.items()])


def fill_template(template: str, cols: dict[str, Column]) -> Column:
    """{name}, {name|slug} and {name|keepslug} filled from the columns; a missing or null value is ''."""
    parts = []
    for text, name, how in re.findall(r"([^{]+)|\{([^}|]+)(?:\|([a-z]+))?\}", template):
        if text:
            parts.append(F.lit(text))
            continue
        c = cols.get(name)
        if c is not None:
            c = slug_ascii(c) if how == "slug" else slug_keep(c) if how == "keepslug" else c
        parts.append(F.lit("") if c is None else F.coalesce(c, F.lit("")))
    return F.concat(*parts)


def map_items(items: DataFrame, cfg: dict) -> DataFrame:
    """Rows of the common posting shape from variant items and a configuration.

    cfg: title (path), url (path) or url_template, description (list of paths, joined by blank lines), cities (path), id (path),
    location (path). Items without a title are dropped; titles are entity-decoded.
    """
    item = F.col("item")
    s = lambda key: get_string(item, cfg[key]) if key in cfg else F.lit(None).cast("string")
    names = re.findall(r"\{([^}|]+)", cfg.get("url_template", ""))
    url = fill_template(cfg["url_template"], {n: get_string(item, n) for n in names}) if "url_template" in cfg else s("url")
    text = F.concat_ws("\n\n", *[get_string(item, p) for p in cfg.get("description", [])])
    keep = [c for c in items.columns if c not in ("item",)]
    out = items.select(
        *keep, s("id").alias("source_id"), F.trim(decode_entities(s("title"))).alias("title"), url.alias("url"), F.nullif(text, F.lit("")).alias("description"),
        (get_strings(item, cfg["cities"]) if "cities" in cfg else F.array().cast("array<string>")).alias("cities"), s("location").alias("location"),
    )
    return out.where("title is not null and title <> ''")


def source_kind(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (kind, slug) by the first rule (kind, host pattern, pattern of the slug in the path) whose host pattern matches."""
    h, p = host(url), path(url)
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("slug"))
    for kind, host_re, path_re in reversed(rules):
        out = F.when(h.rlike(host_re), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(p, path_re, 1).alias("slug"))).otherwise(out)
    return out


# Hosts of job boards (whole, or the end of one after the company's name), and where the company's name stands:
# in the path's first part, in the host, in a parameter, or behind a part of the path.
BOARD_HOSTS = [
    ("greenhouse", "boards.greenhouse.io", "for, else path"), ("greenhouse", "job-boards.greenhouse.io", "for, else path"), ("lever", "jobs.lever.co", "path"), ("lever", "jobs.eu.lever.co", "path"), ("ashby", "jobs.ashbyhq.com", "path"),
    ("workable", "apply.workable.com", "accounts, else path"), ("workable", ".workable.com", "host"), ("recruitee", ".recruitee.com", "host"), ("workday", ".myworkdayjobs.com", "first label"), ("workday", ".myworkdaysite.com", "recruiting, else first label"),
]
# First parts of a path that are no company, and the one host that is in Europe.
NO_COMPANY, EU_HOST = ("embed", "api"), "jobs.eu.lever.co"
# Own hosts of companies that are on a board under another name.
BOARD_OF_HOST = {"ouraring.com": ("greenhouse", "oura"), "alpha-sense.com": ("greenhouse", "alphasense"), "deptagency.com": ("greenhouse", "dept")}


def job_board(url: Column, own_hosts: dict[str, tuple[str, str]] | None = None) -> Column:
    """Struct (kind, slug, eu): the job board of a career url and the company's name on it; without a board kind is null and slug the host's.

    `own_hosts` are hosts of companies that are on a board under a name. A rule whose slug is missing does not hold, the next that fits does.
    A null url, or one without a host, has nulls.
    """
    # each value is bound to a name before the next uses it: written out in one another they grow to thousands of calls a row
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    some = lambda c: F.nullif(c, F.lit(""))

    def places(url: Column) -> Column:
        h, p = F.regexp_replace(host(url), r"^www\.", ""), path(url)
        return bound(F.struct(url.alias("url"), h.alias("h"), p.alias("p")), lambda x: F.struct(x["url"].alias("url"), some(x["h"]).alias("h"), x["p"].alias("p"), some(F.regexp_extract(x["p"], r"^/([^/]+)", 1)).alias("first")))

    def names(x: Column) -> Column:
        url, h, p, first = x["url"], x["h"], x["p"], x["first"]
        where = {
            "path": F.when(~first.isin(*NO_COMPANY), first), "host": some(F.regexp_extract(h, r"^(.+)\.[^.]+\.[^.]+$", 1)), "first label": some(F.substring_index(h, ".", 1)), "for": some(F.regexp_extract(url, r"[?&]for=([^&#]+)", 1)),
            "accounts": some(F.regexp_extract(p, r"^/api/v1/widget/accounts/([^/]+)", 1)), "recruiting": some(F.regexp_extract(p, r"/recruiting/([^/]+)", 1)),
        }
        return bound(F.struct(h.alias("h"), *[c.alias(n) for n, c in where.items()]), board_of)

    def board_of(x: Column) -> Column:
        h = x["h"]
        board = lambda kind, slug: F.struct(F.lit(kind).cast("string").alias("kind"), slug.alias("slug"), F.coalesce(h == EU_HOST, F.lit(False)).alias("eu"))
        rules = [F.when(h == own, board(kind, F.lit(slug))) for own, (kind, slug) in (BOARD_OF_HOST if own_hosts is None else own_hosts).items()]
        for kind, end, said in BOARD_HOSTS:
            slug = F.coalesce(*[x[w.strip()] for w in said.split(", else ")])
            rules.append(F.when((F.endswith(h, F.lit(end)) if end.startswith(".") else h == end) & slug.isNotNull(), board(kind, slug)))
        return F.coalesce(*rules, board(None, host_slug(h)))

    return bound(bound(url, places), names)
