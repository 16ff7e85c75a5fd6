"""Registered queries of operators without SQL, over their whole smallest table, against plain code."""

import base64
import hashlib
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_op7_lines_query(spark):
    from jobloom.llm.lines import normalised, op7_lines, within

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None)
    firsts: dict[str, tuple] = {}
    for i, text in docs:
        for n, line in enumerate(text.split("\n")):
            if norm := normalised(line):
                firsts.setdefault(norm, (i, n))
    lines = sorted(firsts, key=len)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(lines):
        for b in lines[n + 1 :]:
            if len(b) - len(a) > len(b) * 0.1:
                break
            if within(a, b):
                root[find(a)] = find(b)
    head: dict[str, tuple] = {}
    for x in lines:
        head[find(x)] = min(head.get(find(x), firsts[x]), firsts[x])
    want = {}
    for i, text in docs:
        kept = [line for n, line in enumerate(text.split("\n")) if not (norm := normalised(line)) or head[find(norm)] == (i, n)]
        clean = "\n".join(kept)
        want[i] = (text.count("\n") + 1, text.count("\n") + 1 - len(kept), len(clean), hashlib.md5(clean.encode()).hexdigest())
    got = {r.doc_id: (r.n_lines, r.n_removed, r.clean_chars, r.clean_md5) for r in op7_lines(spark, SF).collect()}
    assert {k: got[k] for k in want} == want


def test_op9_warc_query(spark):
    from jobloom.llm.warc import op9_warc

    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    last: dict[bytes, int] = {}
    for i, body in pages:
        last[body] = max(last.get(body, i), i)
    want = {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in pages}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op9_warc(spark, SF).collect()} == want


def test_op10_token_counts_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from jobloom.llm.token_counts import op10_token_counts

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 2048)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op10_token_counts(spark, SF).collect()} == want


def test_op2_toxicity_query_finds_held_out_documents(spark):
    """On a table with enough labels: most toxic documents that no label was learned from, and few others."""
    from jobloom.llm.toxicity import op2_toxicity

    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(toxic[r.doc_id], r.predicted) for r in op2_toxicity(spark, sf).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    found, all_, alarms = sum(t and p for t, p in rows), sum(t for t, _ in rows), sum(p and not t for t, p in rows)
    assert all_ > 50 and found >= 0.8 * all_ and alarms <= 0.05 * len(rows)
