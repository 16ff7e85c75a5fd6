"""Filters, joins, unions and fan-outs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- filters -----------------------------------------------------------------------------------------------------------


def position_detail(positions: DataFrame, categories: DataFrame) -> DataFrame:
    """Positions with their category's name ('Other' without one) and flags that default to false."""
    cat = categories.select(F.col("id").alias("category_id"), F.col("name").alias("_category"))
    x = positions.join(cat, "category_id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("requires_native_language", "local_language_advantage")}
    return x.withColumns(flags | {"category_name": F.coalesce("_category", F.lit("Other"))}).drop("_category")


def by_slug(df: DataFrame, slug: str) -> DataFrame:
    """Rows of a slug; one that is no slug finds nothing."""
    return df.where(F.lit(slug).rlike("^[a-z0-9-]+$") & (F.col("slug") == slug))


def where_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")


def search_name(df: DataFrame, q: str, column: str = "name") -> DataFrame:
    q = q.strip().lower()
    return df.where(F.contains(F.lower(column), F.lit(q))) if q else df


def search_any(df: DataFrame, q: str, columns: list[str], arrays: list[str] | None = None) -> DataFrame:
    """Rows with the text in any of the columns or in any element of the array columns."""
    q = q.strip().lower()
    if not q:
        return df
    tests = [F.contains(F.lower(c), F.lit(q)) for c in columns] + [F.exists(a, lambda x: F.contains(F.lower(x), F.lit(q))) for a in arrays or []]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]))


def lang_status() -> Column:
    """required, advantage or neither."""
    return F.when(F.col("requires_native_language"), "required").when(F.col("local_language_advantage"), "advantage").otherwise("neither")


def split_tracked(df: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tracked countries, and one row of counters: tracked, skipped_unknown, skipped_untracked."""
    codes = tracked.select(F.col(tracked.columns[0]).alias("country_code"), F.lit(True).alias("_tracked"))
    x = df.join(codes, "country_code", "left")
    counters = x.agg(F.count_if(F.col("_tracked")).alias("tracked"), F.count_if(F.col("country_code").isNull()).alias("skipped_unknown"), F.count_if(F.col("country_code").isNotNull() & F.col("_tracked").isNull()).alias("skipped_untracked"))
    return x.where("_tracked").drop("_tracked"), counters


def enrichment_targets(jobs: DataFrame, cached: DataFrame, non_english: Column) -> DataFrame:
    """Jobs worth a detail fetch: an address, not cached, an English title and no description yet."""
    empty = F.coalesce(F.trim("description"), F.lit("")) == ""
    return jobs.where(F.col("url").isNotNull() & empty & ~non_english).join(cached.select("url"), "url", "left_anti")


def drop_gone(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def match_rules(rules: list[tuple[str, str]], column: str) -> Column:
    """The value of the first rule (substring, value) that the column contains: a CASE in table order."""
    out = F.lit(None).cast("string")
    for part, value in reversed(rules):
        out = F.when(F.contains(F.lower(column), F.lit(part)), F.lit(value)).otherwise(out)
    return out


# -- joins -------------------------------------------------------------------------------------------------------------


def positions_in_country(positions: DataFrame, companies: DataFrame, country_id: int) -> DataFrame:
    co = companies.where(F.col("country_id") == country_id).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return positions.join(co, "company_id")


def admin_positions(positions: DataFrame, companies: DataFrame, countries: DataFrame) -> DataFrame:
    co = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "country_id")
    c = countries.select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    x = positions.join(co, "company_id", "left").join(c, "country_id", "left")
    return x.withColumns({k: F.coalesce(k, F.lit("—")) for k in ("company", "country")})


def resolve_keys(df: DataFrame, categories: DataFrame, fallback: str = "other") -> DataFrame:
    """category (a slug) to category_id; unknown slugs take the fallback's id."""
    cat = categories.select(F.col("slug").alias("category"), F.col("id").alias("_id"))
    other = categories.where(F.col("slug") == fallback).agg(F.min("id").alias("_other"))
    return df.join(cat, "category", "left").crossJoin(F.broadcast(other)).withColumn("category_id", F.coalesce("_id", "_other")).drop("_id", "_other")  # one row


def merge_sources(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Full outer by key: each field from the secondary where it has one, else from the primary.

    A secondary field that is null leaves the primary's (the reference lets an explicit undefined overwrite).
    """
    p, s = primary.alias("p"), secondary.alias("s")
    fields = [c for c in primary.columns if c != key]
    return p.join(s, key, "full_outer").select(key, *[F.coalesce(F.col(f"s.`{c}`"), F.col(f"p.`{c}`")).alias(c) for c in fields])


def enrich(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """Details of a url reach each job with it: a job's own function stays, the detail's city comes first, text is appended.

    Of several details of a url the one with the least `ord` counts, which has to tell any two of them apart.
    """
    d = details.groupBy("url").agg(F.min_by(F.struct("function", "city", "extra"), "ord").alias("d"))
    x = jobs.join(d, "url", "left")
    cities = F.array_distinct(F.concat(F.array_compact(F.array("d.city")), F.coalesce("cities", F.array().cast("array<string>"))))
    return x.select(*[c for c in jobs.columns if c not in ("function", "cities", "description")], F.coalesce("function", "d.function").alias("function"), cities.alias("cities"), F.concat_ws("\n", "description", "d.extra").alias("description"))


# -- unions and fan-outs -----------------------------------------------------------------------------------------------


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tag_and_union(passes: list[tuple[str, DataFrame]], city_country: DataFrame) -> DataFrame:
    """Each pass's rows with its country, ids suffixed by it, and their cities cut to that country ("City,State,Country" heads)."""
    x = union_all([df.withColumn("country_code", F.lit(code)) for code, df in passes])
    heads = x.select("id", "country_code", F.posexplode_outer("cities").alias("pos", "raw")).withColumn("city", F.trim(F.substring_index("raw", ",", 1)))
    kept = heads.join(city_country.select("city", F.col("code").alias("country_code")), ["city", "country_code"], "left_semi")
    lists = kept.groupBy("id", "country_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "city"))), lambda s: s["city"]).alias("cities"))
    x = x.drop("cities").join(lists, ["id", "country_code"], "left")
    return x.withColumns({"id": F.concat_ws("-", F.col("id").cast("string"), F.lower("country_code")), "cities": F.coalesce("cities", F.array().cast("array<string>"))})


def fan_out_country(df: DataFrame) -> DataFrame:
    """The base row, and a row for each distinct secondary country other than its own, its id suffixed with the code."""
    more = df.withColumn("c", F.explode(F.array_distinct(F.col("secondary")))).where(~F.col("c").eqNullSafe(F.col("country_code")))
    more = more.withColumns({"id": F.concat_ws("-", "id", F.lower("c")), "country_code": F.col("c")}).drop("c")
    return df.unionByName(more)


def fan_out_city() -> Column:
    """A row's cities followed by its secondary cities."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce("cities", none), F.coalesce("secondary_cities", none))


def fan_out_parallel(df: DataFrame) -> DataFrame:
    """One row for each country of a list; the first keeps the id, others suffix it; all share the city text."""
    x = df.select("*", F.posexplode_outer("countries").alias("pos", "country_code"))
    return x.withColumn("id", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("id")).otherwise(F.concat_ws("-", "id", F.lower("country_code")))).drop("countries", "pos")


def expand_multi(df: DataFrame, details: DataFrame) -> DataFrame:
    """Rows marked multi become one row for each location of their detail; those without one stay as they are."""
    d = details.select("id", "locations")
    x = df.join(d, "id", "left").withColumn("_l", F.when(F.col("multi"), F.col("locations")))
    x = x.select("*", F.posexplode_outer("_l").alias("part", "_loc"))
    return x.withColumn("location", F.coalesce("_loc", "location")).drop("_l", "_loc", "locations", "multi")


def fan_out_text(df: DataFrame, cities: DataFrame, tracked: list[str]) -> DataFrame:
    """One row for each tracked country of a text such as "A or B/C", with its first city there."""
    x = df.select("*", F.posexplode(F.split("location", r"\s+or\s+|/")).alias("pos", "part"))
    x = x.withColumn("city", F.trim("part")).join(cities.select("city", "code"), "city").where(F.col("code").isin(tracked))
    first = x.groupBy("id", "code").agg(F.min_by("city", "pos").alias("city"))
    return first.withColumnRenamed("code", "country_code")


def per_country(df: DataFrame, tracked: DataFrame) -> DataFrame:
    """A posting for each tracked country that it resolves to: an explicit code wins over the resolved list."""
    codes = F.when(F.col("country_code").isNotNull(), F.array("country_code")).otherwise(F.array_distinct("resolved"))
    x = df.withColumn("code", F.explode(codes)).join(tracked.select(F.col(tracked.columns[0]).alias("code")), "code", "left_semi")
    cities = F.when(F.size("cities") > 0, F.col("cities")).when(F.col("city").isNotNull(), F.array("city")).otherwise(F.col("derived_cities"))
    return x.select("id", F.col("code").alias("country_code"), cities.alias("cities"), F.coalesce("work_model", "derived_work_model").alias("work_model"))
