"""Classification of postings: categories, skills, education floor, language of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.operators.phrases import phrase_hits

#: Kinds of application that name no job; a title with one of them is 'other' whatever its text says.
OPEN_APPLICATIONS = ("open", "spontaneous", "speculative", "general")


def names_no_job(title: Column) -> Column:
    """Whether an open kind of application stands in a title: its words side by side."""
    w = F.regexp_extract_all(F.lower(title), F.lit("([a-z]+)"), F.lit(1))
    pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return F.coalesce(F.arrays_overlap(pairs, F.array(*[F.lit(f"{k} application") for k in OPEN_APPLICATIONS])), F.lit(False))


def best_category(hits: DataFrame, key: list[str], weight: int) -> DataFrame:
    """(key, category, score, keyword) of each text: highest score, then earliest hit, then category order.

    `hits` has key, category, cat_no, keyword, kw_no and pos. A keyword that is listed twice counts twice.
    """
    per = hits.groupBy(*key, "category", "cat_no").agg((F.count("*") * weight).alias("score"), F.min("pos").alias("pos"), F.min_by("keyword", "kw_no").alias("keyword"))
    order = F.struct(F.col("score"), -F.col("pos"), -F.col("cat_no"))
    return per.groupBy(*key).agg(F.max_by(F.struct("category", "score", "keyword"), order).alias("b")).select(*key, "b.*")


def classify_category(jobs: DataFrame, key: str, keywords: DataFrame, title: str = "title", description: str = "description", function: str = "function") -> DataFrame:
    """(key, category, keyword, source): by the job function, else the title, else the description; 'other' by default.

    `keywords` has category, cat_no, keyword, kw_no. A catch-all title without a keyword is 'other' whatever its description says.
    """
    kw = keywords.withColumn("phrase_id", F.xxhash64("cat_no", "kw_no"))
    dictionary = kw.select("phrase_id", F.col("keyword").alias("phrase"))
    # the three texts are looked through at once: one explosion, one dictionary join
    texts = jobs.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("stage"), F.col(c).alias("text")) for i, c in enumerate((function, title, description))])).alias("t")).select(key, "t.*")
    hits = phrase_hits(texts, [key, "stage"], "text", dictionary).join(kw, "phrase_id")
    best = best_category(hits, [key, "stage"], 1)
    catch_all = names_no_job(F.col(title))
    best = best.join(jobs.select(key, catch_all.alias("_all")), key).where(~((F.col("stage") == 2) & F.col("_all")))
    first = best.groupBy(key).agg(F.min_by(F.struct("category", "keyword", "stage"), "stage").alias("b"))
    x = jobs.select(key).join(first, key, "left")
    stage = F.when(F.col("b").isNotNull(), F.col("b.stage"))
    source = F.when(stage == 0, "jobFunction").when(stage == 1, "title").when(stage == 2, "description").otherwise("default")
    return x.select(key, F.coalesce("b.category", F.lit("other")).alias("category"), F.col("b.keyword").alias("keyword"), source.alias("source"))


def extract_skills(texts: DataFrame, key: str, text: str, skills: DataFrame) -> DataFrame:
    """(key, skills): names of all skills with an alias in the text, in taxonomy order; texts without skills are left out.

    `skills` has name, skill_no and aliases. An alias has no a-z or 0-9 beside it; empty aliases are skipped.
    """
    a = skills.select("name", "skill_no", F.explode("aliases").alias("phrase")).where(F.trim("phrase") != "").withColumn("phrase_id", F.xxhash64("skill_no", "phrase"))
    hits = phrase_hits(texts, [key], text, a.select("phrase_id", "phrase")).join(a, "phrase_id")
    once = hits.select(key, "skill_no", "name").distinct()
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("skill_no", "name"))), lambda s: s["name"]).alias("skills"))


# What each level of education is called, lowest level first. A full stop may be left out, a space is any white space.
EDUCATION = {
    "vocational": ["vocational qualification", "vocational degree", "vocational education", "vocational certificate", "vocational diploma", "vocational training qualification", "vocational training program", "vocational training programme", "vocational training certificate", "vocational training degree", "apprenticeship", "trade school", "trade qualification", "trade certificate", "technical degree"],
    "bachelor": ["bachelor", "bachelors", "bachelor's", "b.sc.", "b.s.", "b.a.", "undergraduate degree", "university degree", "college degree", "academic degree", "a degree in", "higher education"],
    "master": ["master's", "masters", "master degree", "master of science", "master of arts", "master of engineering", "master of laws", "m.sc.", "m.s.", "m.a.", "graduate degree", "postgraduate degree"],
    "mba": ["mba", "master of business administration"],
    "phd": ["ph.d.", "doctorate", "doctoral degree", "doctor of philosophy", "doctor of science", "doctor of engineering"],
}
ASCII_WORD = "A-Za-z0-9_"


def phrase_pattern(phrases: list[str]) -> str:
    """A pattern that finds any of the phrases with no ASCII word character beside it, in any case."""
    literal = "|".join(p.replace(".", r"\.?").replace(" ", r"\s+") for p in phrases)
    return f"(?i)(?:^|[^{ASCII_WORD}])(?:{literal})(?:$|[^{ASCII_WORD}])"


def education_floor(text: Column, levels: dict[str, list[str]] = EDUCATION) -> Column:
    """The lowest level of education that a text asks for; null if none. "MS Office" reads as a master's degree."""
    t = F.regexp_replace(text, "[‘’‚‛]", "'")
    out = F.lit(None).cast("string")
    for level, phrases in reversed(levels.items()):
        out = F.when(t.rlike(phrase_pattern(phrases)), level).otherwise(out)
    return out


#: What a text says that stands where a title would, but is none.
PLACEHOLDERS = ["loading", "coming soon", "there are no", "no openings", "no positions", "no vacancies", "no roles", "no current openings", "no current positions", "no current vacancies", "no current roles", "no open openings", "no open positions", "no open vacancies", "no open roles", "sign in", "signin", "log in", "login", "log out", "logout", "subscribe", "newsletter"]


def valid_title(title: Column) -> Column:
    """2 to 120 characters and nothing in it that a placeholder says."""
    t, low = F.trim(title), F.regexp_replace(F.lower(title), r"\s+", " ")
    return F.coalesce(F.length(t).between(2, 120) & ~F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda p: F.contains(low, p)), F.lit(False))


def drop_placeholder(df: DataFrame, text: Column, least: int = 30) -> DataFrame:
    """Postings whose description has fewer characters of text than `least` go; those without a description stay."""
    return df.where(text.isNull() | (F.length(text) >= least))


# -- language of a text -------------------------------------------------------------------------------------------------


def text_words(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, word): one row a run of letters, lower-cased."""
    return df.select(*keep, F.explode(F.split(letters_only(F.col(text)), " ")).alias("word")).where("word <> ''")


#: Characters of texts whose trigrams are counted at once.
BATCH_CHARS = 400_000


def letters_only(text: Column) -> Column:
    """A text's words (runs of letters, lower-cased) with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def _code_points(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, row of each) of some rows at once: " words " of each text, a line feed between two texts."""
    begin, some, size = 0, [], 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size > BATCH_CHARS:
            if some:
                cp = np.frombuffer("\n".join(some).encode("utf-32-le"), np.uint32)
                yield begin, cp, np.repeat(np.arange(len(some)), [len(x) + 1 for x in some])[: len(cp)]
            begin, some, size = i, [], 0
        if i < len(texts):
            some.append(f" {texts[i].as_py() or ''} ")
            size += len(some[-1])


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n): how often each trigram of a word with a space before and after it stands in a language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, which = np.unique(np.array(b.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True) if len(b) else ([], None)
            for begin, cp, row in _code_points(b.column(1)):
                x = cp.astype(np.uint64)
                code = (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]
                inside = (cp[1:-1] != 32) & (cp[:-2] != 10) & (cp[1:-1] != 10) & (cp[2:] != 10)
                of = which[begin + row[:-2]]
                for k in np.unique(of):
                    found, n = np.unique(code[inside & (of == k)], return_counts=True)
                    three = np.stack([found >> np.uint64(42), found >> np.uint64(21) & np.uint64(0x1FFFFF), found & np.uint64(0x1FFFFF)], 1).astype(np.uint32)
                    said = three.tobytes().decode("utf-32-le")
                    grams = [said[i : i + 3] for i in range(0, len(said), 3)]
                    yield pa.RecordBatch.from_arrays([pa.array([str(names[k])] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    parts = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), letters_only(F.col(text)).alias("t")).where("t <> ''").mapInArrow(run, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_lang_profile(docs: DataFrame, top: int = 400) -> DataFrame:
    """(lang, gram, n, total): each language's most frequent trigrams in labelled text (ties by gram) and their share's base."""
    per = count_grams(docs, "lang", "text")
    totals = per.groupBy("lang").agg(F.sum("n").alias("total"))
    ranked = per.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rn") <= top).drop("rn")
    return ranked.join(totals, "lang")


def title_words(docs: DataFrame, english: str = "en", top: int = 300, least: int = 3, letters: int = 3) -> DataFrame:
    """(lang, word): of each language but English the most frequent words of labelled texts (lang, text) that English ones do not have.

    Words are runs of at least `letters` letters that occur `least` times or more; ties by word. The table is top x languages rows.
    """
    per = text_words(docs, ["lang"], "text").where(F.length("word") >= letters).groupBy("lang", "word").agg(F.count("*").alias("n"))
    own = per.where((F.col("lang") != english) & (F.col("n") >= least)).join(per.where(F.col("lang") == english).select("word"), "word", "left_anti")
    ranked = own.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("rn") <= top).select("lang", "word")


def title_language(titles: DataFrame, key: str, title: str, words: DataFrame) -> DataFrame:
    """(key, lang): the language that most distinct words of a title belong to (ties by name); titles without such a word are left out.

    Words meet the dictionary as an equi-join, whatever its size.
    """
    w = text_words(titles, [key], title).distinct()
    hits = w.join(words, "word").groupBy(key, "lang").agg(F.count("*").alias("n"))
    return hits.groupBy(key).agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"))


def gram_scores(text: Column, weights: list[tuple[str, str, int]], langs: list[str]) -> Column:
    """Array of a text's sums of weights by language, in the order of `langs`; null for one that shares no trigram with the text.

    `weights` has (lang, gram, weight). Arrow batches; a text's places are looked up in one table of trigrams.
    """
    letters = sorted({ord(c) for _, g, _ in weights for c in g})
    grams = sorted({g for _, g, _ in weights})
    size = len(letters) + 1
    number = {c: i + 1 for i, c in enumerate(letters)}
    codes = sorted(((number[ord(g[0])] * size + number[ord(g[1])]) * size + number[ord(g[2])], g) for g in grams)
    at = {g: i for i, (_, g) in enumerate(codes)}
    table = np.zeros((2, len(grams), len(langs)), np.int64)  # weights, and whether a language has the trigram
    for lang, g, w in weights:
        table[:, at[g], langs.index(lang)] += (w, 1)
    keys = np.array([c for c, _ in codes], np.int64)

    @F.arrow_udf("array<bigint>")
    def score(texts: pa.Array) -> pa.Array:
        letter = np.zeros(0x110000, np.int64)
        letter[letters] = np.arange(1, size)
        out = np.zeros((2, len(texts), len(langs)), np.int64)
        for begin, cp, row in _code_points(texts) if len(keys) else ():
            a = letter[cp]
            code = (a[:-2] * size + a[1:-1]) * size + a[2:]
            some = np.flatnonzero((a[:-2] > 0) & (a[1:-1] > 0) & (a[2:] > 0))
            k = np.minimum(np.searchsorted(keys, code[some]), len(keys) - 1)
            hit = keys[k] == code[some]
            k, of = k[hit], row[some[hit]]
            if len(of):
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[:, begin + of[first]] = np.add.reduceat(table[:, k], first, axis=1)
        values = pa.array(out[0].ravel(), mask=out[1].ravel() == 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(langs), pa.int32()), values)

    return score(text)


def detect_lang(texts: DataFrame, key: list[str], text: str, profile: DataFrame) -> DataFrame:
    """(keys, detected): the language whose profile gives a text's trigrams the highest sum of weights, ties by name.

    A trigram of a profile weighs its share of the language in millionths; texts that share no trigram with any profile are
    left out. The profile is top x languages rows, which the tasks get as they are.
    """
    weights = [tuple(r) for r in profile.select("lang", "gram", F.floor(F.col("n") * 1_000_000 / F.col("total")).cast("long")).collect()]
    langs = sorted({lang for lang, _, _ in weights})
    # a text's grams are weighed where they are read: one row a text moves
    scores = texts.select(*key, gram_scores(letters_only(F.col(text)), weights, langs).alias("s"))
    per = scores.groupBy(*key).agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(len(langs))]).cast("array<bigint>").alias("s"))
    place = F.array_position("s", F.array_max("s"))  # the first of equal ones
    return per.select(*key, F.get(F.array(*map(F.lit, langs)).cast("array<string>"), (place - 1).cast("int")).alias("detected")).where("detected is not null")


def native_char_count(text: Column, letters: str) -> Column:
    """How many characters of a text are among the letters."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def native_sample(text: Column, letters: str) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & F.contains(F.lit(letters), c))
    return F.array_join(F.array_sort(F.array_distinct(chars)), "")


def paragraphs(texts: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """(key, para, p): paragraphs of at least `least` characters, else the whole text."""
    paras = F.transform(F.split(text, r"\n+"), lambda s: F.trim(s))
    long_ = F.filter(paras, lambda p: F.length(p) >= least)
    return texts.select(key, F.posexplode(F.when(F.size(long_) > 0, long_).otherwise(F.array(F.col(text)))).alias("para", "p"))


def chunks(texts: DataFrame, key: str, text: str, least: int = 200, longest: int = 1500, window: int = 500) -> DataFrame:
    """(key, para, part, chunk): paragraphs, long ones in windows."""
    x = paragraphs(texts, key, text, least)
    starts = F.when(F.length("p") > longest, F.sequence(F.lit(1), F.length("p"), F.lit(window))).otherwise(F.array(F.lit(1)))
    x = x.select(key, "para", "p", F.posexplode(starts).alias("part", "start"))
    piece = F.when(F.length("p") > longest, F.substring("p", F.col("start"), F.lit(window))).otherwise(F.col("p"))
    x = x.select(key, "para", "part", piece.alias("chunk"), (F.length("p") > longest).alias("cut"))
    return x.where(~F.col("cut") | (F.length("chunk") >= least)).drop("cut")


def chunk_language(texts: DataFrame, key: str, text: str, profile: DataFrame) -> DataFrame:
    """(key, para, lang): each paragraph's language; of a long one, what more than half of its windows say."""
    from jobloom.operators.stats import strict_majority

    found = detect_lang(chunks(texts, key, text), [key, "para", "part"], "chunk", profile)
    votes = found.select(F.struct(key, "para").alias("k"), F.col("detected").alias("lang"))
    return strict_majority(votes, "k", "lang").select(F.col(f"k.{key}").alias(key), F.col("k.para").alias("para"), "lang")
