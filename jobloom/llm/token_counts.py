"""Token counts: a broadcast table of frequent pre-token lengths, worker caches for the rest, no shuffle of pre-tokens."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8_bytes

#: The pre-token pattern of word_bpe_49k.json. Its special tokens are left out: texts that have one go to the library whole. A file
#: with another pattern, other normalisers or other special tokens has all its texts counted by the library whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Texts of these characters are normalised alike by Python and by the library: NFC leaves them and lower case maps one to one.
PLAIN = r"[\x00-\x1b\x20-įı-ɏ]*"
#: Documents in the sample that the frequent table is drawn from, and rows of that table. Both touch speed alone.
SAMPLE_DOCS, TABLE_ROWS, CACHE_ROWS = 2_000, 30_000, 250_000


def splits_as_known(path: str) -> bool:
    """Whether a tokenizer file normalises and splits texts in the way that `TokenCounter.split` does."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = lambda key, inner: (d.get(key) or {}).get(inner) or [d.get(key) or {}]
    normalisers = [(n.get("type"), n.get("content")) for n in steps("normalizer", "normalizers")]
    split, *rest = steps("pre_tokenizer", "pretokenizers")
    pattern = split.get("type") == "Split" and split.get("pattern", {}).get("Regex") == PATTERN and split.get("behavior") == "Removed" and split.get("invert")
    known = normalisers == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and [(r.get("type"), r.get("add_prefix_space")) for r in rest] == [("ByteLevel", False)]
    return bool(pattern and known) and tuple(t["content"] for t in d.get("added_tokens", [])) == SPECIAL


class TokenCounter:
    """Counts the tokens of texts in one worker: table first, then the cache, then the library for what both miss."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread and one malloc arena: the task is the unit of parallel work
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.frequent, self.cache = frequent, {}
        self.known = splits_as_known(path)
        self.find, self.plain = regex.compile(PATTERN).findall, re.compile(PLAIN).fullmatch

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens, or None where the library has to take the whole text."""
        if not self.known:
            return None
        # in lower case as well: a lowered string would be taken for a special when its pre-token is counted
        low = text.lower()
        if not self.plain(text) or SPECIAL[0] in low or SPECIAL[1] in low:
            return None
        return self.find(low)

    def counts(self, texts: list[str]) -> list[int]:
        out, whole = [0] * len(texts), []
        pending: list[tuple[int, Counter]] = []
        missing: set[str] = set()
        frequent, cache = self.frequent, self.cache
        for i, text in enumerate(texts):
            if not text:
                continue
            words = self.split(text)
            if words is None:
                whole.append(i)
                continue
            n = 0
            rest = []
            for w in words:
                k = frequent.get(w) or cache.get(w)
                if k is None:
                    rest.append(w)
                else:
                    n += k
            out[i] = n
            if rest:
                pending.append((i, Counter(rest)))
                missing.update(rest)
        if missing:
            if len(cache) + len(missing) > CACHE_ROWS:
                cache.clear()
            new = list(missing)
            found = dict(zip(new, (len(e) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            for i, rest in pending:
                out[i] += sum(found[w] * k for w, k in rest.items())
            if len(new) <= CACHE_ROWS:
                cache.update(found)
        for i in whole:  # one at a time: these may be long
            out[i] = len(self.tok.encode(texts[i], add_special_tokens=False))
        return out


@lru_cache(maxsize=1)
def worker_counter(path: str) -> TokenCounter:
    """The counter of this Python worker: later tasks of a query find it with its cache."""
    return TokenCounter(path, {})


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, rows: int = TABLE_ROWS) -> dict[str, int]:
    """The compact table: token lengths of the most frequent pre-tokens in about `sample_docs` documents (at most `rows` rows)."""
    n = docs.count()
    keep = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // sample_docs))) == 0).where(F.length("text") < 100_000).select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = worker_counter(path)
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(c.split(text or "") or ())
        top = seen.most_common(rows)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in top], pa.string()), "n": pa.array([k for _, k in top], pa.int64())})

    # The partial counts of a bounded sample; what counts for the result, the documents' pre-tokens, is never shuffled.
    top = keep.mapInArrow(words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(rows).collect()
    found = [r.w for r in top]
    return dict(zip(found, TokenCounter(path, {}).counts(found), strict=True))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) for every row; a null text counts as empty: 0 and 0.

    The counts are those of the tokenizers library with its defaults for `path` (any .json of that library): no begin, end
    or padding tokens, no truncation, special strings inside a text as special tokens. Texts with characters beyond
    Latin Extended-B, or with special strings, go through the library whole. Columns of the same names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lengths = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs.select(F.col(text_col).alias("text")).where("text is not null"), path))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_counter(path)
        counter.frequent = lengths.value
        for texts in batches:
            values = texts.tolist()
            yield pd.Series([k for i in range(0, len(values), 256) for k in counter.counts(values[i : i + 256])], dtype="int64")

    n_tokens = F.pandas_udf(counts, "long")(text)
    return docs.withColumns({"n_bytes": utf8_bytes(F.col(text_col)), "n_tokens": n_tokens}).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, whole."""
    import public_tokenizers

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(d, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE_SQL: dict[str, str] = {}
