"""License scans by diagonal voting, in DataFrame functions alone.

Hashes of all rolling word k-grams of the texts are joined with the places where the templates have them. A hit is a vote for a
diagonal, text word minus template word. Short templates (phrases, one-line notices) must stand whole: each of their diagonals
needs every vote. Longer ones may be edited: words lost or put in move the diagonal a little, so diagonals that lie close are
one candidate, and it needs as many votes as the least allowed share of equal words leaves (an unequal word spoils k votes at most).
Candidates are verified word by word, in the spans of the texts that they point to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, small, table

#: Words of a rolling gram, at most: a template of fewer words has one gram of all its words. With 3, a long template with a
#: quarter of its words changed, wherever they stand, keeps a gram.
GRAM = 3
#: Templates of fewer words have to occur whole; of longer ones this share of words has to be there, in place.
WHOLE_WORDS, LEAST_SHARE = 20, 0.75
#: Diagonals of a long template that lie so close are one candidate.
NEAR = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases with their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Notices and license texts that are public, with labels of our own.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("dedicated to the public domain under cc0", "cc0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl-3"),
]


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case: runs of digits, letters and all characters beyond ASCII; none for null."""
    # the one other character whose lower case is an ASCII letter (the Kelvin sign) would become a word's k
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def grams(h: Column, k: int) -> Column:
    """(at, gram): place and hash of every run of k word hashes."""
    last = F.size(h) - k
    at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    made = F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)]).alias("gram")))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<struct<at:int,gram:bigint>>"))


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def built_in(spark: SparkSession) -> DataFrame:
    """The templates above: (template, label, kind, text), kind `base` or `notice`."""
    rows = [(text, label, "base") for text, label in BASE] + [(text, label, "notice") for text, label in NOTICES]
    made = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(text).alias("text")) for i, (text, label, kind) in enumerate(rows)])
    return spark.range(1).select(F.inline(made))


def spans(docs: DataFrame, templates: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, th, template, label, kind, start, last, matched, n) of verified spans in `docs` (id, th, text), th a hash of the text.

    start and last are the first and last word of the text that a template's word stands at, matched those that do, of n. Rows that agree in
    id and text are one. Templates without words are never found; the templates' ids have to differ.
    """
    t = templates.select("template", "label", "kind", words(F.col("text")).alias("tw")).withColumn("n", F.size("tw")).where("n > 0")
    t = t.withColumns({"k": F.least("n", F.lit(GRAM)), "whole": F.col("n") < WHOLE_WORDS})
    # an unequal word spoils k grams
    t = t.withColumn("votes", F.when(F.col("whole"), F.col("n") - F.col("k") + 1).otherwise(F.greatest(F.lit(1), F.col("n") - F.col("k") + 1 - F.col("k") * F.floor(F.col("n") * (1 - LEAST_SHARE)).cast("int"))))
    places = t.withColumn("h", hashes(F.col("tw")))
    lengths = range(1, GRAM + 1)
    places = places.select("template", "k", "whole", "votes", F.inline(F.coalesce(*[F.when(F.col("k") == k, grams(F.col("h"), k)) for k in lengths])).alias("j", "gram"))
    size = t.agg(F.sum("n").alias("rows"), F.collect_set("k").alias("ks")).first()  # at most GRAM lengths
    d = docs.select("id", "th", hashes(words(F.col("text"))).alias("h"))
    own = d.select("id", "th", F.inline(F.concat(*[grams(F.col("h"), k) for k in sorted(size.ks) or [GRAM]])).alias("i", "gram"))
    hits = own.join(small(places, size.rows or 0), "gram").select("id", "th", "template", "whole", "votes", (F.col("i") - F.col("j")).alias("diagonal"), "j").distinct()

    # votes by diagonal; near diagonals of a long template are one
    by = W.partitionBy("id", "th", "template").orderBy("diagonal", "j")
    step = F.col("diagonal") - F.lag("diagonal").over(by)
    hits = hits.withColumn("new", F.when(F.coalesce(step > F.when(F.col("whole"), 0).otherwise(NEAR), F.lit(True)), 1).otherwise(0))
    hits = hits.withColumn("candidate", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    likely = hits.groupBy("id", "th", "template", "votes", "candidate").agg(F.array_sort(F.collect_set("diagonal")).alias("ds"), F.size(F.collect_set("j")).alias("got")).where("got >= votes").select("id", "th", "template", "ds")
    likely = scratch.save(likely, "candidates")

    # the texts come back once for each document with candidates; what a candidate needs of them is cut out
    known = t.select("template", "n")
    asked = likely.join(small(known, size.rows or 0), "template").groupBy("id", "th").agg(F.collect_list(F.struct("template", "n", "ds")).alias("cs"))
    asked = small(asked, likely.count())
    same = F.col("id").eqNullSafe(F.col("id0")) & (F.col("th") == F.col("th0"))
    back = docs.select(F.col("id").alias("id0"), F.col("th").alias("th0"), "text").join(asked, same)
    cut = lambda w, c: F.struct(c["template"].alias("template"), c["ds"].alias("ds"), F.greatest(c["ds"][0], F.lit(0)).alias("from"), F.slice(w, F.greatest(c["ds"][0], F.lit(0)) + 1, F.element_at(c["ds"], -1) + c["n"] - F.greatest(c["ds"][0], F.lit(0))).alias("w"))
    # the outer array binds the words to a name
    back = back.select("id", "th", F.explode(F.transform(F.array(words(F.col("text"))), lambda w: F.transform("cs", lambda c: cut(w, c)))[0]).alias("x")).select("id", "th", "x.*")
    back = back.join(small(t.select("template", "label", "kind", "whole", "tw", "n"), size.rows or 0), "template")
    there = lambda j: F.get(F.filter("ds", lambda d: F.coalesce(F.get("w", d + j - F.col("from")) == F.get("tw", j), F.lit(False))), F.lit(0)) + j
    back = back.withColumn("at", F.array_compact(F.transform(F.sequence(F.lit(0), F.col("n") - 1), there))).withColumn("matched", F.size("at"))
    back = back.where(F.when(F.col("whole"), F.col("matched") == F.col("n")).otherwise(F.col("matched") >= F.col("n") * LEAST_SHARE))
    return back.select("id", "th", "template", "label", "kind", F.array_min("at").cast("long").alias("start"), F.array_max("at").cast("long").alias("last"), F.col("matched").cast("long").alias("matched"), F.col("n").cast("long").alias("n")).distinct()


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_words and license_spans (array of start, template, label, kind, last, matched, n; in this order) to every row of `docs`.

    A null or empty text has 0 words and no spans. Rows that repeat an id and a text get the same answer, and so do rows with a null
    id and equal texts. Texts of any length are read whole, spans may overlap. Columns of the added names are replaced, others stay, also
    those with names that the scan uses itself. An empty table or list of templates is no error.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "license_spans")
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    scratch = Scratch(spark, "licenses")
    found = scratch.save(spans(keyed, built_in(spark) if templates is None else templates, scratch), "spans")
    per = found.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "template", "label", "kind", "last", "matched", "n"))).alias("license_spans")).select(F.col("id").alias("_id0"), F.col("th").alias("_th0"), "license_spans")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"), F.size(words(text)).cast("long").alias("n_words"))
    out = rows.join(small(per, found.count()), F.col("_id").eqNullSafe(F.col("_id0")) & (F.col("_th") == F.col("_th0")), "left")
    none = F.array().cast(per.schema["license_spans"].dataType)
    return out.select(*[F.col(f"_doc.`{c}`") for c in docs.columns], "n_words", F.coalesce("license_spans", none).alias("license_spans"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licenses of all documents; score is the largest share of a template's words that a span has (0 without a span)."""
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda s: s["label"]))), ",")
    d = d.withColumn("base", F.filter("license_spans", lambda s: s["kind"] == "base"))
    starts = F.transform("base", lambda s: s["start"])
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("base").alias("base_labels"), labels("license_spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("license_spans", lambda s: s["matched"] / s["n"])), F.lit(0.0)).alias("score"),
    )


def _quoted(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


#: The same by plain words: every place of a template, diagonals with a shared gram, words compared in place.
_SQL = f"""WITH t0 AS (SELECT template, label, kind, string_split(text, ' ') AS tw FROM (VALUES {_quoted([(i, label, kind, text) for i, (text, label, kind) in enumerate([(*b, "base") for b in BASE] + [(*b, "notice") for b in NOTICES])])}) v(template, label, kind, text)),
t AS (SELECT *, len(tw) AS n, least(len(tw), {GRAM}) AS k, len(tw) < {WHOLE_WORDS} AS whole FROM t0),
tg AS (SELECT template, k, n, whole, j, array_to_string(tw[j + 1 : j + k], ' ') AS gram FROM t, LATERAL (SELECT unnest(range(n - k + 1)) AS j)),
tp AS (SELECT template, j, tw[j + 1] AS word FROM t, LATERAL (SELECT unnest(range(n)) AS j)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c FROM tok WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT doc_id, template, n, k, whole, i - j AS diagonal, j FROM (SELECT doc_id, i, 2 AS k, word || ' ' || b AS gram FROM g UNION ALL SELECT doc_id, i, 3, word || ' ' || b || ' ' || c FROM g) JOIN tg USING (k, gram)),
isl AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER y <= CASE WHEN whole THEN 0 ELSE {NEAR} END THEN 0 ELSE 1 END AS new FROM hit WINDOW y AS (PARTITION BY doc_id, template ORDER BY diagonal, j)),
cand AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal, j) AS candidate FROM isl),
same AS (SELECT c.doc_id, c.template, c.candidate, p.j, min(tok.i) AS i FROM (SELECT DISTINCT * FROM cand) c JOIN tp p ON p.template = c.template JOIN tok ON tok.doc_id = c.doc_id AND tok.i = c.diagonal + p.j AND tok.word = p.word GROUP BY ALL),
span AS (SELECT DISTINCT doc_id, template, min(i) AS start, max(i) AS last, count(*) AS matched FROM same GROUP BY doc_id, template, candidate),
ok AS (SELECT s.*, t.label, t.kind, t.n FROM span s JOIN t USING (template) WHERE CASE WHEN whole THEN matched = n ELSE matched >= n * {LEAST_SHARE} END)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (kind = 'base') AS n_base, min(start) FILTER (kind = 'base') AS first_word, max(start) FILTER (kind = 'base') AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base'), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(matched / n), 0.0::DOUBLE) AS score
FROM d LEFT JOIN ok ON ok.doc_id = d.doc_id GROUP BY d.doc_id, w"""

QUERIES = {"op11_licenses": op11_licenses}
ORACLE_SQL = {"op11_licenses": _SQL}
