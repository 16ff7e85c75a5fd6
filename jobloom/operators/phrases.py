"""Phrase dictionaries over texts: hits by equi-joins on word runs instead of one pattern after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a dictionary up to which it is broadcast.
BROADCAST_PHRASES = 50_000


#: What borders a phrase: no such character may stand beside it. Words are runs of them.
BORDER = "[a-z0-9]"


def words(text: Column, border: str = BORDER) -> Column:
    """Lower-cased runs of border characters in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({border}+)"), F.lit(1))


def phrase_hits(texts: DataFrame, key: list[str], text_col: str, phrases: DataFrame, border: str = BORDER) -> DataFrame:
    """(keys, phrase_id, pos): each phrase that a text holds between borders, with the place of its first hit (from 1).

    `phrases` has phrase_id and phrase; a phrase may have symbols inside or at its edges. Phrases meet texts on their longest
    word, as an equi-join with the distinct words of a text; what is left of a phrase's words is looked up among the text's
    words where the pair meets, and only then the phrase itself is looked for in the text. Phrases that are listed twice hit
    twice. A null text has no hits; a phrase without any word is not looked for.
    """
    p = phrases.select("phrase_id", F.lower(F.trim("phrase")).alias("phrase")).withColumn("w", words(F.col("phrase"), border)).where(F.size("w") > 0)
    n = p.count()
    longest = F.array_sort(F.col("w"), lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).otherwise(F.when(x < y, -1).when(x > y, 1).otherwise(0)))
    p = p.select("phrase_id", "phrase", F.array_distinct("w").alias("pw"), longest[0].alias("word"))
    p = F.broadcast(p) if n <= BROADCAST_PHRASES else p
    # a text's distinct words; the texts themselves stay out of the explosion and come back by key for pairs that are left
    w = texts.select(*key, F.array_distinct(words(F.col(text_col), border)).alias("tw")).where(F.size("tw") > 0)
    met = w.select(*key, F.explode("tw").alias("word")).join(p, "word").groupBy(*key).agg(F.collect_list(F.struct("phrase_id", "phrase", "pw")).alias("ps"))
    # one text comes back once, for all phrases that it may hold (at most the dictionary)
    back = met.join(texts.select(*key, F.lower(text_col).alias("_text"), F.array_distinct(words(F.col(text_col), border)).alias("tw")), key)
    back = back.select(*key, "_text", F.explode(F.filter("ps", lambda q: F.size(F.array_except(q["pw"], F.col("tw"))) == 0)).alias("q"))
    return back.select(*key, "q.phrase_id", first_bounded(F.col("_text"), F.col("q.phrase"), border).alias("pos")).where("pos > 0")


def first_bounded(text: Column, phrase: Column, border: str = BORDER) -> Column:
    """Place (from 1) of the first occurrence of a literal phrase with no border character beside it; 0 if there is none."""
    return F.regexp_instr(text, F.concat(F.lit(f"(?<!{border})\\Q"), phrase, F.lit(f"\\E(?!{border})")))
