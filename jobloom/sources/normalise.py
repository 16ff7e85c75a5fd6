"""Normalisers of landed payloads into the common posting row.

Common columns: source_id, title, description, location, url, department, country_code, cities, work_model. Each takes a frame with
a JSON text column `payload`; documents that do not parse give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.columns import clean_name, html_to_line, strip_bilingual, work_model_of
from jobloom.operators.location import location_class, normalised_key

COMMON = ("source_id", "title", "description", "location", "url", "department", "country_code", "cities", "work_model")


def _row(x: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """The common row from what a source has; titles are needed."""
    kinds = {c: "array<string>" if c == "cities" else "string" for c in COMMON}
    out = [cols[c].cast(kinds[c]).alias(c) if c in cols else F.lit(None).cast(kinds[c]).alias(c) for c in COMMON]
    return x.select(*keep, *out).where("title is not null and trim(title) <> ''")


def _items(raw: DataFrame, schema: str, path: str | None) -> tuple[DataFrame, list[str]]:
    keep = [c for c in raw.columns if c != "payload"]
    parsed = F.from_json("payload", schema)
    return raw.select(*keep, F.explode(parsed[path] if path else parsed).alias("j")), keep


def normalise_greenhouse(raw: DataFrame) -> DataFrame:
    x, keep = _items(raw, "jobs array<struct<id:string,title:string,absolute_url:string,content:string,location:struct<name:string>,departments:array<struct<name:string>>>>", "jobs")
    return _row(x, keep, source_id=F.col("j.id"), title=clean_name(F.col("j.title")), description=F.col("j.content"), location=F.col("j.location.name"), url=F.col("j.absolute_url"), department=F.get("j.departments", F.lit(0))["name"])


def normalise_lever(raw: DataFrame) -> DataFrame:
    x, keep = _items(raw, "array<struct<id:string,text:string,hostedUrl:string,descriptionPlain:string,lists:array<struct<text:string,content:string>>,country:string,workplaceType:string,categories:struct<location:string,team:string>>>", None)
    lists = F.array_join(F.transform("j.lists", lambda e: F.concat_ws("\n", e["text"], html_to_line(e["content"]))), "\n")
    return _row(
        x, keep, source_id=F.col("j.id"), title=strip_bilingual(F.col("j.text")), description=F.concat_ws("\n\n", "j.descriptionPlain", F.nullif(lists, F.lit(""))), location=F.col("j.categories.location"),
        url=F.col("j.hostedUrl"), department=F.col("j.categories.team"), country_code=F.upper("j.country"), work_model=work_model_of(F.col("j.workplaceType")),
    )


def normalise_ashby(raw: DataFrame) -> DataFrame:
    """One row for each job and country of its primary and secondary places, with the cities there; places without a country stay rows."""
    place = "struct<location:string,country:string,city:string>"
    x, keep = _items(raw, f"jobs array<struct<id:string,title:string,jobUrl:string,descriptionHtml:string,department:string,workplaceType:string,location:string,country:string,city:string,secondary:array<{place}>>>", "jobs")
    primary = F.array(F.struct(F.col("j.location").alias("location"), F.col("j.country").alias("country"), F.col("j.city").alias("city")))
    places = F.concat(primary, F.coalesce("j.secondary", F.array().cast(f"array<{place}>")))
    x = x.select(*keep, F.col("j").alias("j"), F.posexplode(places).alias("pos", "p"))
    g = x.groupBy(*keep, "j.id", F.coalesce("p.country", F.concat(F.lit("?"), "p.location")).alias("at")).agg(
        F.min_by(F.col("j"), "pos").alias("j"), F.min("p.country").alias("country"), F.min_by("p.location", "pos").alias("location"), F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("p.city").alias("city")))), lambda s: s["city"])).alias("cities")
    )
    return _row(g, keep, source_id=F.col("j.id"), title=F.col("j.title"), description=F.col("j.descriptionHtml"), location=F.col("location"), url=F.col("j.jobUrl"), department=F.col("j.department"), country_code=F.upper("country"), cities=F.array_distinct("cities"), work_model=work_model_of(F.col("j.workplaceType")))


def normalise_workable(raw: DataFrame) -> DataFrame:
    x, keep = _items(raw, "jobs array<struct<shortcode:string,title:string,url:string,description:string,department:string,city:string,country:string,locations:array<struct<countryCode:string>>>>", "jobs")
    where = F.nullif(F.concat_ws(", ", F.nullif("j.city", F.lit("")), "j.country"), F.lit(""))
    return _row(x, keep, source_id=F.col("j.shortcode"), title=F.col("j.title"), description=F.col("j.description"), location=where, url=F.col("j.url"), department=F.col("j.department"), country_code=F.upper(F.get("j.locations", F.lit(0))["countryCode"]))


def normalise_recruitee(raw: DataFrame) -> DataFrame:
    x, keep = _items(raw, "offers array<struct<id:string,title:string,careers_url:string,description:string,department:string,location:string,hybrid:boolean,remote:boolean,on_site:boolean>>", "offers")
    model = F.when(F.col("j.hybrid"), "hybrid").when(F.col("j.remote"), "remote").when(F.col("j.on_site"), "on-site")
    return _row(x, keep, source_id=F.col("j.id"), title=F.col("j.title"), description=F.col("j.description"), location=F.col("j.location"), url=F.col("j.careers_url"), department=F.col("j.department"), work_model=model)


def normalise_workday(listing: DataFrame, detail: DataFrame, cities: DataFrame) -> DataFrame:
    """(id, title, url, location) and (id, description, country, locations array) -> one row for each job and country.

    Plain locations stand as they are; for "N locations" and venue names the detail's locations are grouped by their country, and
    where none is known, the detail's country name stands.
    """
    x = listing.join(detail, "id", "left").withColumn("kind", location_class(F.col("location")))
    plain = x.where("kind = 'plain'").select("id", "title", "url", "description", "location", F.lit(None).cast("string").alias("country_code"), F.array().cast("array<string>").alias("cities"))
    rest = x.where("kind <> 'plain' or kind is null")
    parts = rest.select("id", F.posexplode("locations").alias("pos", "place")).withColumn("key", normalised_key(F.col("place"))).join(cities.select("key", "code"), "key")
    per = parts.groupBy("id", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda s: s["place"]).alias("cities"))
    known = rest.join(per, "id", "left")
    out = known.select("id", "title", "url", "description", F.coalesce(F.when(F.col("code").isNull(), F.col("country")), F.array_join("cities", "; ")).alias("location"), F.col("code").alias("country_code"), F.coalesce(F.array_distinct("cities"), F.array().cast("array<string>")).alias("cities"))
    return plain.unionByName(out)


def normalise_payload(raw: DataFrame) -> DataFrame:
    """Upload payloads of three shapes to one row an entry: wrapped {total_positions, companies}, a list, or one entry.

    `entry` is the entry's JSON; `total_positions` is the declared total of a wrapped payload.
    """
    keep = [c for c in raw.columns if c != "payload"]
    v = F.try_parse_json("payload")
    wrapped = F.try_variant_get(v, "$.companies", "array<variant>")
    listed = F.try_variant_get(v, "$", "array<variant>")
    shape = F.when(wrapped.isNotNull(), "wrapped").when(listed.isNotNull(), "list").when(F.try_variant_get(v, "$.name", "string").isNotNull(), "single")
    entries = F.coalesce(wrapped, listed, F.array(v))
    x = raw.select(*keep, shape.alias("shape"), F.try_variant_get(v, "$.total_positions", "long").alias("total_positions"), F.posexplode(entries).alias("no", "e"))
    return x.where("shape is not null").select(*keep, "shape", "total_positions", "no", F.to_json("e").alias("entry"))
