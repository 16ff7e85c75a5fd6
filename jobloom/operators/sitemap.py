"""Sitemap rows as a table; write them with df.write.text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.columns import slug


def sitemap_rows(countries: DataFrame, companies: DataFrame, base: str, day: Column) -> DataFrame:
    """(path, priority, changefreq, lastmod, line): static pages, countries, distinct company slugs, companies in countries."""
    spark = countries.sparkSession
    static = spark.createDataFrame([("/", "1.0"), ("/companies", "0.8")], "path string, priority string")
    c = countries.select(F.concat(F.lit("/"), "slug").alias("path"), F.lit("0.9").alias("priority"))
    named = companies.select(slug(F.col("name")).alias("company"), "country_id").distinct()
    co = named.select(F.concat(F.lit("/company/"), "company").alias("path"), F.lit("0.7").alias("priority")).distinct()
    both = named.join(countries.select(F.col("id").alias("country_id"), "slug"), "country_id").select(F.concat(F.lit("/"), "slug", F.lit("/"), "company").alias("path"), F.lit("0.6").alias("priority")).distinct()
    x = static.unionByName(c).unionByName(co).unionByName(both).withColumn("changefreq", F.lit("daily")).withColumn("lastmod", F.date_format(day, "yyyy-MM-dd"))
    line = F.concat(F.lit(f"<url><loc>{base}"), "path", F.lit("</loc><lastmod>"), "lastmod", F.lit("</lastmod><priority>"), "priority", F.lit("</priority></url>"))
    return x.withColumn("line", line)
