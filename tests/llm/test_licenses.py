"""License scans: phrases by plain words, edited texts, edge rows, and the query's SQL."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def plain(text):
    """Base phrases by a plain walk over the words."""
    from jobloom.llm.licenses import BASE

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for phrase, label in BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def asked(spark, rows):
    from jobloom.llm.licenses import scan

    d = scan(spark.createDataFrame(rows, DOC))
    out = {}
    for r in d.collect():
        base = [s for s in r.license_spans if s.kind == "base"]
        starts = [s.start for s in base]
        out.setdefault((r.doc_id, r.text), []).append(((r.n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({s.label for s in base}))), {s.label for s in r.license_spans}, r.license_spans))
    return out


def test_base_phrases_brute_force(spark):
    rnd = random.Random(4)
    words = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC", "By", "x", "İ", "K", "é9"]
    rows = [(i, rnd.choice([" ", "-", "\n", "@", "[", "_ "]).join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(150)]
    rows += [(None, "CC BY"), (None, None), (1, ""), (2, None), (3, "cc by cc by CC-BY"), (3, "cc by cc by CC-BY"), (4, "all rights reserved " * 20_000), (5, "by"), (6, "x" * 300_000)]
    got = asked(spark, rows)
    assert sum(map(len, got.values())) == len(rows)
    for (_, text), found in got.items():
        for one in found:
            assert one[0] == plain(text), text
    assert len(got[3, "cc by cc by CC-BY"]) == 2 and got[3, "cc by cc by CC-BY"][0][0][1] == 3


def test_edited_license_texts(spark):
    from jobloom.llm.licenses import LEAST_SHARE, NOTICES, WHOLE_WORDS

    rnd = random.Random(8)
    long = [(i, t.split(), label) for i, (t, label) in enumerate(NOTICES) if len(t.split()) >= WHOLE_WORDS]
    short = [(t.split(), label) for t, label in NOTICES if len(t.split()) < WHOLE_WORDS]
    rows, want = [], {}
    for i, w, label in long:
        for share in (0.0, 0.1, 0.25):
            # the most words that may be other ones, spread as evenly as they can be, so that no long stretch is left
            e, x = int(len(w) * share), list(w)
            for j in range(e):
                x[int((j + 0.5) * len(w) / e)] = f"other{j}"
            rows.append((len(rows), "before it " * rnd.randrange(30) + " ".join(x) + " after"))
            want[rows[-1][0]] = label
        x = w[:20] + ["one", "more"] + w[20:30] + w[31:]  # words put in and lost
        rows.append((len(rows), " ".join(x)))
        want[rows[-1][0]] = label
        rows.append((len(rows), " ".join(rnd.sample(w, len(w)))))  # all words, in no order
        want[rows[-1][0]] = None
        rows.append((len(rows), " ".join(w[: len(w) // 2])))  # a half is too little
        want[rows[-1][0]] = None
    for w, label in short:
        rows += [(len(rows), ", ".join(w).upper()), (len(rows) + 1, " ".join([*w[:-1], "other", w[-1]]))]
        want |= {rows[-2][0]: label, rows[-1][0]: None}
    for (i, _), found in asked(spark, rows).items():
        labels, spans = found[0][1], [s for s in found[0][2] if s.n >= WHOLE_WORDS]
        if want[i]:
            assert want[i] in labels, (i, want[i], labels)
        elif i < len(long) * 6:
            assert not spans, (i, spans)
        assert all(s.matched >= s.n * LEAST_SHARE and 0 <= s.start <= s.last for s in spans)


def test_own_templates_and_edges(spark):
    from jobloom.llm.licenses import scan

    t = spark.createDataFrame([(1, "a", "base", "alpha"), (2, "b", "notice", ""), (3, "c", "notice", "one two three four")], "template int, label string, kind string, text string")
    d = spark.createDataFrame([(1, "Alpha one two three four, alpha"), (2, "one two three")], DOC).withColumns({"th": F.lit(1), "n_words": F.lit("x"), "id": F.lit("y")})
    got = {r.doc_id: r for r in scan(d, t).collect()}
    assert [(s.label, s.start, s.last) for s in got[1].license_spans] == [("a", 0, 0), ("c", 1, 4), ("a", 5, 5)] and got[1].n_words == 6 and got[1].id == "y"
    assert got[2].license_spans == [] and scan(d.where("false"), t).count() == 0 and scan(d, t.where("false")).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_and_sql(spark):
    import duckdb

    from jobloom.llm.licenses import ORACLE_SQL, op11_licenses

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    res = con.execute(ORACLE_SQL["op11_licenses"])
    names = [c[0] for c in res.description]
    rows = op11_licenses(spark, SF).collect()
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(res.fetchall()) and any(r.n_base for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
