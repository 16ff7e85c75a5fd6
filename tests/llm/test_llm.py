"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
HERE = os.path.isdir(SF)
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "   ", "en", "a", 3), (None, "lost row of words here", "en", "b", 22), (5, "same words again and again here", None, "a", 1), (5, "same words again and again here", None, "a", 1), (7, "x" * 200_000, "en", "a", 1), (8, "word " * 30_000, "en", "b", 1)]


def docs_of(spark, rows=EDGE):
    """Documents with an extra column of a name that operators use themselves."""
    return spark.createDataFrame(rows, DOC).withColumns({"shard": F.lit("mine"), "h": F.lit(1)})


def empty(spark):
    return spark.createDataFrame([], DOC)


# -- top-k ------------------------------------------------------------------------------------------------------------------


def test_topk_brute_force(spark):
    from jobloom.llm.topk import quantised, top_k

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 2]) for i in range(120)] + [(200, None), (201, [float("nan")] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (7, [0.5] * 6), (300, []), (301, [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"))
    good = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if i is not None and v is not None and not any(x is None or x != x for x in v)]
    asks = {i: min(v for j, v in good if j == i) for i, _ in good if i % 50 == 0}
    want = set()
    for q, v in asks.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in top_k(e.where("id % 50 = 0"), e).collect()} == want
    # products beyond 64 bits are ranked as the numbers they are and told as the nearest long
    huge = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [1.0, 5.0]), (3, [2e30, 0.0]), (4, [-1e30, 0.0]), (5, [-2e30, 9.0]), (6, [3e18, 3e18]), (7, [])]
    h = spark.createDataFrame(huge, "vec_id long, embedding array<float>").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"))
    got = {r["rank"]: (r.vec_id, r.score) for r in top_k(h.where("id = 0"), h, 7).collect()}
    assert [got[i][0] for i in range(1, 8)] == [3, 1, 6, 2, 7, 4, 5] and got[1][1] == got[2][1] == 2**63 - 1 and got[5][1] == 0 and got[6][1] == got[7][1] == -(2**63)
    assert [r.vec_id for r in top_k(h.where("id = 2"), h, 2).orderBy("rank").collect()] == [3, 0]
    assert top_k(e.where("false"), e).count() == 0 and top_k(e.where("id = 0"), e.where("false")).count() == 0


def test_topk_huge_doubles(spark):
    """Doubles that 256 times over are infinite take no part; blocks of any size give the same answer."""
    from jobloom.llm import topk

    rows = [(0, [1e308, 1.0]), (1, [1.0, 2.0]), (2, [-1e308, 0.0]), (3, [1e300, 0.0]), (50, [1.0, 1.0])]
    h = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    assert [(r.query_id, r.vec_id) for r in topk.top_k(h.where("id % 50 = 0"), h).orderBy("rank").collect()] == [(50, 3), (50, 1)]


# -- toxicity ---------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_scores(spark):
    from jobloom.llm.toxicity import fit, score

    rnd = random.Random(3)
    plain = "the of and to in that is was for with on as by at from this have not are be".split()
    text = lambda toxic: " ".join(rnd.choices(plain, k=60)) + (f". you {rnd.choice(['grobnik', 'sklurp'])} {rnd.choice(['grobnik', 'sklurp'])}." if toxic else ".")
    rows = [(text(i % 8 == 0), int(i % 8 == 0)) for i in range(400)]
    model = fit(spark.createDataFrame(rows, "text string, toxic int"))
    d = spark.createDataFrame([(1, text(1)), (2, text(0)), (3, None), (4, "")], "doc_id long, text string")
    p = {r.doc_id: r.s for r in d.select("doc_id", score(d, model).alias("s")).collect()}
    assert p[1] > 0.7 and p[2] < 0.1 and p[3] == p[4] < 0.1
    none = fit(spark.createDataFrame([], "text string, toxic int"))
    assert 0 <= d.select(score(d, none).alias("s")).first().s <= 1


def test_toxicity_machine():
    from jobloom.llm.toxicity import Model, clause_matches, evidence, tokens_of

    m = Model(words={"moron": 5.0})
    e = lambda t: evidence(clause_matches(tokens_of(t), m), m.factors)
    assert e("you are a moron") > e("that moron") > e("he is not a moron") > 0 == e("a fine day")
    assert e("she said he is a moron") == e("She said: he is a moron") < e("he is a moron")
    assert e("i will kill you") > 0 == e("they kill. you") == e("they kill")
    assert e("moron") == e("moron! fine day") == e("") == 0
    assert e('she wrote "fine. he is a moron." he is a moron') == e("she said he is a moron. he is a moron")
    assert e("the moron and a moron") == 10 and e("x " * 50_000 + "moron") == 5


def test_toxicity_composition_against_all_paths():
    """The composed machine gives what sending every tape through one machine after the other gives."""
    from jobloom.llm.toxicity import END, GRAMMAR, SYMBOLS, Model, clause_matches

    word = {"I": "moron", "N": "not", "T": "you", "R": "said", "Q": '"', "H": "kill", "O": "day"}
    m = Model(words={"moron": 5.0})
    rnd = random.Random(12)

    def tapes(machine, tape, state):
        found = [((), state, ())]
        for x in tape:
            found = [((*out, y), t, (*labels, label)) for out, s, labels in found for t, y, label in machine.step(s, x)]
        return found

    for _ in range(400):
        text = rnd.choices(SYMBOLS, k=rnd.randint(0, 7))
        paths = [((*text, END), ())]
        for machine in GRAMMAR:
            paths = [(out, labels + more) for tape, labels in paths for out, _, more in tapes(machine, tape, machine.start)]
        want, got = {}, {}
        for tape, labels in paths:
            labels = frozenset(labels) - {None, "insult"}
            want[labels] = want.get(labels, 0) + (5.0 if "i" in tape else 1.0)
        for w, labels in clause_matches([word[x] for x in text], m):
            got[labels] = got.get(labels, 0) + w
        assert got == want, text


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_toxicity_query(spark):
    """Held-out labels, and edge rows with clashing names."""
    from jobloom.llm.toxicity import op2_toxicity, score, train

    out = {r.doc_id: r for r in op2_toxicity(spark, SF01).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [(labels[i], r.predicted) for i, r in out.items() if r.held_out and i in labels]
    assert sum(y == p for y, p in held) >= 0.9 * len(held)  # few labels: stems of other languages are not learned
    d = docs_of(spark).withColumns({"score": F.lit("x"), "toxic": F.lit(1)})
    rows = d.select("doc_id", "text", score(d, train(spark, SF01)).alias("s")).collect()
    assert len(rows) == len(EDGE) and len({r.s for r in rows if not r.text or r.text.isspace()}) == 1 and len({r.s for r in rows if r.doc_id == 5}) == 1


# -- decontamination ----------------------------------------------------------------------------------------------------------


def test_decontaminate_plants(spark):
    from jobloom.llm.decontaminate import flag

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    item = [word() for _ in range(30)]
    short = [word() for _ in range(7)]
    swapped = [w if i % 9 != 4 else word() for i, w in enumerate(item)]
    fill = lambda n: [word() for _ in range(n)]
    rows = [(1, " ".join(fill(50) + item + fill(50))), (2, " ".join(fill(5) + swapped).upper()), (3, " ".join(fill(300))), (4, " ".join(fill(9) + item[5:22] + fill(9))), (5, ", ".join(fill(3) + short + fill(3))), (6, " ".join(item[:6] + fill(40))), (7, None), (8, ""), (None, " ".join(item)), (9, " ".join(item[:7] + fill(20) + item[20:27]))]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short)), (2, "two words"), (3, None), (4, "a a a a a a a a a a a a a a")], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("contaminated", F.lit("x"))
    out = flag(d, bench).collect()
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.contaminated} == {1, 2, 4, 5}
    assert flag(d, bench.where("false")).where("contaminated").count() == 0 and flag(d.where("false"), bench).count() == 0


# -- chat -----------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    from jobloom.llm.chat import Formatter, Template, digest_chats, format_chats

    rnd = random.Random(2)
    alphabet = ["[INST]", "[/INST]", "</s>", "\\", "[SYS]", " ", "é", "\n", "[ROLE]", " [SAYS] ", "[ANS] ", "a", "[", "/", "<s>", "\\["]
    f = Formatter(Template())
    for _ in range(500):
        turns = [(rnd.choice(["user", "assistant", "system", "tool [/INST]", ""]), "".join(rnd.choices(alphabet, k=rnd.randint(0, 9)))) for _ in range(rnd.randint(1, 4))]
        assert f.read("".join(p for t in turns for p, _ in f.segments(*t))) == turns
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", None), (2, 0, "assistant", ""), (2, None, "user", "first"), (None, 0, None, "x"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    out = {r.conv_id: r for r in digest_chats(format_chats(c)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(out) == {1, 2, 3, None}
    assert out[1].turns_sha256 == sha("user\n\nassistant\nyes </s>\n") and out[1].loss_sha256 == sha("yes </s>") and out[1].loss_chars == 8 and out[1].valid
    assert out[2].turns_sha256 == sha("user\nfirst\nassistant\n\n") and out[2].n_turns == 2
    assert out[3].n_turns == 2 and not out[3].valid and out[None].n_turns == 1
    assert digest_chats(format_chats(c.where("false"))).count() == 0


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_chat_query(spark):
    """All conversations and conversation -7 against plain Python; a very long conversation."""
    from jobloom.llm.chat import digest_chats, format_chats, op4_chat

    said = "</s>[INST] ok [/INST]"
    turns = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for c, rows in turns.items():
        rows = sorted(rows)
        trained = "".join(t for _, role, t in rows if role == "assistant")
        want[c] = (len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(trained), sha(trained))
    out = op4_chat(spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == want and len(out) == len(want)
    long_ = spark.range(60_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("a [/INST] b").alias("text"))
    r = digest_chats(format_chats(long_)).first()
    assert (r.n_turns, r.loss_chars, r.valid) == (60_000, 30_000 * 11, True)


# -- near-duplicates ------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i) and find(a) != find(b):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_neardup_brute_force(spark):
    from jobloom.llm.neardup import dedup, near_duplicates

    rnd = random.Random(7)
    vocab = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = []
    for g in range(12):
        base = rnd.choices(vocab, k=rnd.choice([3, 8, 40, 150, 600]))
        for _ in range(rnd.choice([1, 2, 9, 25])):
            w = [rnd.choice(vocab) if rnd.random() < rnd.choice([0, 0.01, 0.03, 0.06]) else x for x in base]
            rows.append((len(rows) + 1000 * g, (" ".join(w)).title() if rnd.random() < 0.3 else "\t".join(w)))
    rows += [(90_001, None), (90_002, ""), (90_003, " \n "), (90_004, "one"), (90_005, "ONE"), (90_006, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0))
    out = near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = {r.doc_id for r in out if r.kept}
    assert {r.doc_id for r in dedup(df).collect()} == kept
    edge = near_duplicates(docs_of(spark)).collect()
    assert len(edge) == len(EDGE) and [r.component_id for r in edge if r.doc_id is None] == [None]
    assert near_duplicates(empty(spark)).count() == 0


def test_dedup_follows_each_text_of_a_repeated_id(spark):
    """A unique text stays though another row of its id is a copy; the set sizes at which bands are left out lose no link."""
    from jobloom.llm.neardup import MANY, dedup, near_duplicates

    rnd = random.Random(15)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, c = text(60), text(80), text(50)
    rows = [(3, a), (5, b), (5, a), (7, c), (7, c + " end"), (9, b + " end"), (9, b + " end"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"th": F.lit("mine"), "_id": F.lit(0)})
    kept = dedup(df)
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert kept.columns == df.columns and got in ([(0, a), (3, a), (5, b), (7, c)], [(0, a), (3, a), (5, b), (7, c + " end")])
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(df).collect()) == [(0, 0), (3, 3), (5, 3), (5, 5), (7, 7), (7, 7), (9, 5), (9, 5)]
    # sizes around MANY with a similarity just above the least
    pairs = []
    for i in range(60):
        n = MANY - 6 + i % 12
        w = text(n + 4).split()
        cut = int(n * 0.25)
        pairs += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join(w[: len(w) - cut]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert {k: (None, v) for k, v in got.items()} == {k: (None, v) for k, (_, v) in brute_components(pairs).items()}


def test_neardup_parts():
    from jobloom.llm.neardup import estimate, shingle_set, sketch, word_hashes

    long_ = ("lorem ipsum dolor " * 40_000).encode()
    assert len(np.unique(word_hashes(long_))) == 3 and len(word_hashes(long_)) == 120_000
    a, b = (shingle_set(" ".join(f"w{i}" for i in range(s, s + 2000))) for s in (0, 250))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(estimate(sketch(a)[None], sketch(b)[None])[0] - true) < 0.12


def test_decontaminate_brute_force(spark):
    """All overlaps of items of all lengths with random substitutions, against every diagonal."""
    from jobloom.llm.decontaminate import MIN_TOKENS, overlaps

    rnd = random.Random(17)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([*range(3, 26), 40])}
    items[90] = ["la", "li", "lo"] * 5 + [word() for _ in range(4)]  # repeats its seeds
    texts = {}
    for i, item in items.items():
        for subs in range(8):
            for _ in range(4):
                at = set(rnd.sample(range(len(item)), min(subs, len(item))))
                cut = rnd.choice((0, 0, 1, 3))
                texts[len(texts)] = [word() for _ in range(rnd.choice((0, 6)))] + [word() if k in at else w for k, w in enumerate(item)][cut:] + [word() for _ in range(rnd.choice((0, 6)))]
    want = {}
    for doc, text in texts.items():
        for i, item in items.items():
            best = 0
            for diagonal in range(-len(item) + 1, len(text)):
                now = 0
                for k, w in enumerate(item):
                    now = max(0, now + (1 if 0 <= diagonal + k < len(text) and text[diagonal + k] == w else -1))
                    best = max(best, now)
            n = len(item)
            if n >= MIN_TOKENS and best >= (n if n < 8 else min(10, n - 2)):
                want[doc, i] = best
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in overlaps(docs, bench).collect()} == want and len(want) > 300


def test_decontaminate_mask_hits_every_overlap():
    """The least substitutions with which an overlap that counts meets no window of a mask, over all patterns of equal tokens."""
    from jobloom.llm.decontaminate import MASKS

    span = max(map(len, MASKS))

    def least(score, length):
        """Over patterns of at most `length` tokens; a state is the last tokens and the score, its value the fewest zeros."""
        states = {((), 0): 0}
        for _ in range(length):
            nxt = dict(states)
            for (last, now), zeros in states.items():
                for bit in (0, 1):
                    tail = (*last, bit)[-span:]
                    if any(len(tail) >= len(m) and all(t or c == "0" for t, c in zip(tail[-len(m) :], m)) for m in MASKS):
                        continue
                    key = tail, now + (1 if bit else -1)
                    if key[1] > 0 and zeros + 1 - bit < nxt.get(key, 10**6):
                        nxt[key] = zeros + 1 - bit
            states = nxt
        return min((z for (_, now), z in states.items() if now >= score), default=None)

    assert least(10, 60) == 14
    for n in range(span, 12):
        assert least(n if n < 8 else min(10, n - 2), n) is None


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_decontaminate_query(spark):
    """The whole query against every diagonal of every document and item, and edge rows."""
    from jobloom.llm.decontaminate import MIN_TOKENS, flag, op3_decontaminate

    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    at = {}
    for i, w in items.items():
        for p, x in enumerate(w):
            at.setdefault(x, []).append((i, p))
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text, equal = split(r.text), {}
        for k, x in enumerate(text):
            for i, p in at.get(x, ()):
                equal.setdefault((i, k - p), set()).add(p)
        best = {}
        for (i, _), places in equal.items():
            n = len(items[i])
            need = n if n < 8 else min(10, n - 2)
            if n >= MIN_TOKENS and len(places) >= need:
                now = top = 0
                for p in range(n):
                    now = max(0, now + (1 if p in places else -1))
                    top = max(top, now)
                if top >= need:
                    best[i] = max(best.get(i, 0), top)
        want[r.doc_id] = (len(best), max(best.values(), default=None))
    assert {r.doc_id: (r.n_items, r.best_score) for r in op3_decontaminate(spark, SF).collect()} == want and sum(n > 0 for n, _ in want.values()) >= 2
    bench = spark.createDataFrame([(1, "word word word word"), (2, "one two three four five six seven eight nine"), (3, "same words again and"), (None, "x"), (4, None)], "item_id long, text string")
    rows = [*EDGE, (20, "say one two three four FIVE! six, zwei eight nine", "en", "a", 1)]
    out = flag(docs_of(spark, rows).withColumn("n_items", F.lit("x")), bench).collect()
    assert len(out) == len(rows) and {r.doc_id for r in out if r.contaminated} == {5, 8, 20}


# -- sharding ---------------------------------------------------------------------------------------------------------------------


def test_sharding_law(spark):
    from jobloom.llm.sharding import shard

    rnd = random.Random(1)
    rows = [(i, "same" * 9 if i % 3 == 0 else "é" * rnd.randint(0, 50), None, "s", 0) for i in range(900)] + EDGE
    out = shard(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    per, slots = {}, {}
    for r in out:
        per[r.shard] = per.get(r.shard, 0) + size(r.text)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, top = sum(per.values()), max(size(r.text) for r in out)
    assert all(b <= total / 16 + top for b in per.values()) and set(per) <= set(range(16))
    same = {}
    for r in out:
        same.setdefault(r.text or "", set()).add(r.shard)
    heavy = {t for t in same if sum(size(r.text) for r in out if (r.text or "") == t) * 1600 > total}
    assert all(len(x) == 1 for t, x in same.items() if t not in heavy) and sum(len(x) > 1 for x in same.values()) <= 15
    even = shard(docs_of(spark, rows[:900])).groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("b")).collect()
    assert len(even) == 16 and max(r.b for r in even) - min(r.b for r in even) <= 2 * 101
    assert shard(empty(spark)).count() == 0


def test_sharding_keeps_groups_together(spark):
    """Of many groups of copies none is divided; one of a third of all rows lies in contiguous shards, spread over parts."""
    from jobloom.llm import sharding

    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), (F.col("id") / 5).cast("long"))).alias("text"))
    out = sharding.shard(rows, 16).persist()
    per = out.groupBy("text").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.count_distinct("shard").alias("n"))
    assert [(r.text, r.hi - r.lo + 1 - r.n) for r in per.where("n > 1").collect()] == [("hot text", 0)]
    bytes_ = [r.b for r in out.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()]
    assert len(bytes_) == 16 and max(bytes_) - min(bytes_) <= 0.02 * sum(bytes_) / 16
    assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count_distinct("slot")).alias("gaps")).where("gaps <> 0").count() == 0
    out.unpersist()


def test_sharding_large_groups_and_repeated_rows(spark, monkeypatch):
    """A group of many rows with few bytes stays whole though several tasks hold it; equal rows are dealt to several parts."""
    from jobloom.llm import sharding

    monkeypatch.setattr(sharding, "PART_ROWS", 64)
    # 1,500 rows of one text, which are under a hundredth of a shard by their bytes; and 4,000 rows that agree in all
    rows = spark.range(1_500).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = rows.unionByName(spark.range(3_000).select((F.col("id") + 10_000).alias("doc_id"), F.repeat(F.col("id").cast("string"), 900).alias("text")))
    rows = rows.unionByName(spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("again and again").alias("text")))
    placed = sharding.global_positions(rows, F.col("text"), F.col("doc_id"), [F.col("doc_id").asc_nulls_first()], F.octet_length("text") + 1, 16)
    assert [r.n for r in placed.where("text = ''").select(F.count_distinct("cut").alias("n")).collect()] == [1]
    assert placed.select(F.count_distinct("row_no"), F.max("row_no"), F.count_distinct("offset")).first()[:] == (8_500, 8_499, 8_500)
    out = sharding.shard(rows, 16)
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("k"), F.sum(F.octet_length("text") + 1).alias("b")).collect()
    assert len(per) == 16 and all(r.n == r.k == r.m + 1 for r in per) and max(r.b for r in per) <= 1.03 * sum(r.b for r in per) / 16
    assert out.where("text = ''").select("shard").distinct().count() == 1


# -- lines ------------------------------------------------------------------------------------------------------------------------


def test_lines(spark):
    from jobloom.llm.lines import dedup_lines

    line = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old apple tree near the river bank today"
    rows = [(1, f"{line}\nunique words of one\n\n***"), (2, f"Another thing entirely here\n{line.upper()}!!\n\n***"), (3, line + "\n" + line), (4, None), (5, ""), (6, "ok\nOK"), (None, line), (7, "x" * 100_000)]
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1))).collect()}
    assert out[1].clean_text == rows[0][1] and out[1].n_lines == 4
    assert out[2].clean_text == "Another thing entirely here\n\n***" and out[2].n_removed == 1
    assert out[3].clean_text == "" and out[3].n_removed == 2
    assert out[4].clean_text is None and out[4].n_lines == 0 and out[5].clean_text == "" and out[6].clean_text == "ok" and out[None].clean_text == line
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_simhash():
    """Majorities against Python; a changed word leaves all blocks but two; the two ways to normalise agree."""
    from jobloom.llm import lines

    rnd = random.Random(8)
    sets = [[rnd.getrandbits(64) for _ in range(n)] for n in (1, 2, 3, 4, 5, 9, 14, 300)]
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    got = lines.simhashes(np.array([v for s in sets for v in s], np.uint64), first)
    bits = lambda v: np.unpackbits(np.array([v], np.uint64).view(np.uint8))
    for s, h in zip(sets, got, strict=True):
        assert (bits(h) == (sum(bits(v).astype(int) for v in s) * 2 > len(s))).all()
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(90)]
    texts = [words, [*words[:40], "another", *words[41:]], [*words[:40], "more", *words[40:]], words[1:]]
    _, pos, _, length, _, offsets, keys = lines.keys_of(["\n".join(map(" ".join, texts))])
    keys = [set(keys[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert list(pos) == [0, 1, 2, 3] and list(length) == [len(" ".join(t)) for t in texts]
    assert len(keys[0]) >= 10 and all(len(keys[0] - k) <= 2 for k in keys[1:])
    odd = ["A1--b  2,c", "é È½ x_y", " - ", "", "٣x 中 文İ", "ᾈ\u0301z"]
    text, pos, line, length, *_ = lines.keys_of(["\n".join(odd), "a0 b 0 c"])
    assert [(t, p) for t, p in zip(text, pos, strict=True)] == [(0, 0), (0, 1), (0, 4), (0, 5), (1, 0)] and line[0] == line[-1]
    assert [len(lines.normalised(odd[p]) if t == 0 else "a0 b 0 c") for t, p in zip(text, pos, strict=True)] == list(length)


def test_lines_distance():
    from jobloom.llm.lines import distance, within

    rnd = random.Random(3)
    for _ in range(300):
        a = " ".join("".join(rnd.choices("abc", k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 14)))
        b = a
        for _ in range(rnd.randint(0, 5)):
            k = rnd.randrange(len(b) + 1)
            b = (b[:k] + rnd.choice(["a", "d", " e ", ""]) + b[k + rnd.randint(0, 1) :]).strip() or "x"
        b = " ".join(b.split())
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert distance(a, b) == row[-1] and (distance(a, b, 2) <= 2) == (row[-1] <= 2) and within(a, b) == (row[-1] <= int(0.1 * max(len(a), len(b)) + 1e-9)), (a, b)


def test_lines_are_told_apart_early():
    """Counts of runs refuse most pairs of unlike lines and none within the limit; a distance beyond the limit ends long before the line does."""
    from jobloom.llm.lines import bags_of, distance, may_match, within

    rnd = random.Random(17)
    parts = ["th", "en", "er", "on", "ing", "tion", "re", "ha", "an", "ed", "ou", "ñ", "中"]
    line = lambda n: " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(n))
    pairs = []
    for n in (1, 2, 5, 20, 60, 90, 400):
        for share in (0, 0.02, 0.05, 0.09, 0.11, 0.3):
            for _ in range(4):
                x = line(n)
                y = list(x)
                for p in rnd.sample(range(len(x)), int(share * len(x))):
                    y[p] = rnd.choice(["", "q", y[p] + "x", " "])
                pairs.append((x, " ".join("".join(y).split()) or "x"))
    unlike = [(line(80), line(80)) for _ in range(60)]
    got = may_match(*map(list, zip(*pairs, *unlike, ("", "a"), ("ab", "ab"), strict=True)))
    near = [distance(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9) for x, y in pairs]
    assert sum(near) > 60 and near == [within(x, y) for x, y in pairs] and all(m for m, n in zip(got, near, strict=False) if n)
    assert sum(got[len(pairs) : -2]) <= 6 and got[-1]
    assert may_match([], []).tolist() == []
    for x, y in pairs:
        d = distance(x, y)
        assert all((distance(x, y, most) <= most) == (d <= most) for most in {0, max(d - 1, 0), d, d + 1, len(x) // 10, len(x) // 3})

    class Read(str):
        n = 0

        def __iter__(self):
            for c in super().__iter__():
                self.n += 1
                yield c

    for x, y in unlike:
        y = Read(y)
        most = max(len(x), len(y)) // 10
        assert distance(x, y, most) > most and y.n < 0.6 * len(y)
    bags = [bytes(rnd.randrange(256) for _ in range(32)) for _ in range(5)]
    assert bags_of(pa.array([bags[0], None, *bags[1:], None], pa.binary()).slice(1, 4)).tobytes() == b"".join(bags[1:4])
    assert bags_of(pa.array([None], pa.binary())).shape == (0, 32)


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_lines_against_all_pairs(spark):
    """All pairs of the distinct lines of a table by a full edit distance: no false link, and nearly every pair in one group."""
    from jobloom.llm import lines
    from jobloom.llm.common import Scratch
    from jobloom.llm.lines import distance

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    d = lines.occurrences(docs).persist()
    table = d.groupBy("line").agg(F.first("len").alias("len"), F.first("bag").alias("bag"), F.min(F.struct("id", "pos")).alias("first"))
    comp = {r.node: r.component for r in lines.groups(d.select("line", "id", "keys"), table, docs, Scratch(spark, "test")).collect()}
    texts = sorted(((r.line, r.norm) for r in lines.read_lines(table, docs).collect()), key=lambda x: len(x[1]))
    letters = {c: i for i, c in enumerate(sorted({c for _, t in texts for c in t}))}
    bags = np.zeros((len(texts), len(letters)), np.int32)
    for i, (_, t) in enumerate(texts):
        np.add.at(bags[i], [letters[c] for c in t], 1)
    pairs, true = [], {i: i for i, _ in texts}

    def root(x):
        while true[x] != x:
            x = true[x]
        return x

    for i, (a, ta) in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b, tb = texts[j]
            most = int(len(tb) * 0.1 + 1e-9)
            if len(tb) - len(ta) > most:
                break
            more = bags[j] - bags[i]
            if max(more[more > 0].sum(), -more[more < 0].sum()) <= most and len(tb) < 3_000 and distance(ta, tb) <= most:
                pairs.append((a, b))
                true[root(a)] = root(b)
    found = sum(comp.get(a, a) == comp.get(b, b) for a, b in pairs)
    assert len(pairs) >= 20 and found >= 0.95 * len(pairs), f"{found} of {len(pairs)}"
    long_ = {i for i, t in texts if len(t) >= 3_000}
    assert all(root(n) == root(c) for n, c in comp.items() if n not in long_ and c not in long_)


def test_lines_fuzzy(spark):
    """A copy with one letter changed goes, a shorter line of other order stays; repeated ids and very long lines are taken."""
    from jobloom.llm.lines import dedup_lines

    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(120)]
    near = words[:-1] + [words[-1][:-1] + "z"]
    long_ = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(20_000)]
    other = [w if i % 50 else "zz" for i, w in enumerate(long_)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words[:60]))), (4, " ".join(long_)), (5, " ".join(other)), (6, "tiny\ntinz\nten letters\nten lettres"), (6, "ten letter")]
    out = {(r.doc_id, r.n_lines): r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, 1): 0, (2, 1): 1, (3, 1): 0, (4, 1): 0, (5, 1): 1, (6, 4): out[6, 4], (6, 1): out[6, 1]}
    alone = dedup_lines(spark.createDataFrame([(1, "tiny\ntinz\nten letters\nten letterz\nten lettres")], "doc_id long, text string")).first()
    assert alone.clean_text == "tiny\ntinz\nten letters\nten lettres"


def test_lines_recall(spark):
    """Every pair of lines with one word or letter changed, added or lost, and most with three of a longer line, that edit similarity links."""
    from jobloom.llm.lines import dedup_lines, distance

    rnd = random.Random(23)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrst", k=rnd.randint(3, 7)))
    letter = lambda w: (lambda k: w[:k] + rnd.choice("uvwxyz") + w[k + 1 :])(rnd.randrange(len(w)))
    pairs = []
    for n in (1, 2, 6, 10, 11, 12, 13, 15, 20, 30):
        for kind in ("word", "letter", "add", "lose", "three"):
            for _ in range(4):
                a = [word() * (6 if n < 4 else 1) for _ in range(n)]
                b, k = list(a), rnd.randrange(n)
                for k in rnd.sample(range(n), 3 if kind == "three" and n >= 12 else 1):
                    b[k] = word() if kind == "word" and n >= 4 else letter(b[k])
                if kind == "add" and n >= 4:
                    b = a[:k] + [word()] + a[k:]
                if kind == "lose" and n >= 4:
                    b = a[:k] + a[k + 1 :]
                a, b = " ".join(a), " ".join(b)
                if min(len(a), len(b)) >= 20 and 0 < distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
                    pairs.append((a, b, kind))
    rows = [(i, "\n".join(p[:2])) for i, p in enumerate(pairs)]
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [p for i, p in enumerate(pairs) if got[i] != 1]
    # three changed words in a line of 12 to 15 leave few words together
    assert len(pairs) > 120 and len(lost) <= 0.1 * len(pairs) and all(kind == "three" for *_, kind in lost), lost


def test_lines_with_scattered_edits(spark):
    """Letters changed, lost and put in at random over lines of the real table, up to the allowed share: at least 0.9 of the pairs end in one group."""
    from pyspark.sql import Window as W

    from jobloom.llm.common import Scratch
    from jobloom.llm.lines import groups, normalised, occurrences, within

    rnd = random.Random(7)
    texts = [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").select("text").collect()]
    lines = sorted({normalised(x) for t in texts for x in t.split("\n")})

    def edited(x, share):
        x = list(x)
        for p in rnd.sample(range(len(x)), int(share * len(x))):
            kind = rnd.random()
            x[p] = rnd.choice("abcdefghijklmnopqrstuvwxyz") if kind < 0.6 else "" if kind < 0.8 else x[p] + rnd.choice("abcdefghij")
        return normalised("".join(x))

    pairs = []
    for lo, hi in ((20, 40), (40, 80), (80, 160), (160, 400), (400, 3000)):
        pool = [x for x in lines if lo <= len(x) < hi]
        for share in (0.01, 0.02, 0.03, 0.05, 0.08):
            pairs += [((lo, share), x, e) for x in rnd.sample(pool, min(len(pool), 40)) if (e := edited(x, share)) and e != x and within(x, e)]
    docs = [(i, t) for i, t in enumerate(lines)] + [(10**6 + i, e) for i, (_, _, e) in enumerate(pairs)]
    d = spark.createDataFrame(docs, "id long, text string").repartition(4)
    scratch = Scratch(spark, "test")
    occ = scratch.save(occurrences(d), "occurrences")
    named = {r.id: r.line for r in occ.select("id", "line").collect()}
    firsts = occ.withColumn("rn", F.row_number().over(W.partitionBy("line").orderBy("id"))).where("rn = 1").select("line", "len", "bag", F.struct("id", "pos").alias("first"))
    comps = {r.node: r.component for r in groups(occ.select("line", "id", "keys"), firsts, d, scratch).collect()}
    at = {x: i for i, x in enumerate(lines)}
    found = {}
    for i, (kind, x, _) in enumerate(pairs):
        a, b = named[at[x]], named[10**6 + i]
        found.setdefault(kind, []).append(a == b or comps.get(a, a) == comps.get(b, b))
    assert len(found) >= 20 and all(sum(v) >= 0.9 * len(v) for v in found.values()), {k: sum(v) / len(v) for k, v in found.items()}


def test_lines_by_common_runs_alone(spark):
    """Two lines whose only common keys are runs that many lines have, beside more runs of each that are rarer: they end in one group."""
    from jobloom.llm import lines
    from jobloom.llm.common import Scratch

    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    keys = lambda x: set(lines.keys_of([x])[-1].tolist())
    runs = lambda x: {x[i : i + 10] for i in range(len(x) - 9)}
    docs, planted = [], []
    while len(planted) < 3:
        x = " ".join(text(6) for _ in range(18))
        y = list(x)
        for p in rnd.sample([i for i, c in enumerate(x) if c != " "], 11):
            y[p] = "0"
        y = "".join(y)
        common = keys(x) & keys(y)
        own = [runs(z) for z in (x, y)]
        if not lines.within(x, y) or not 1 <= len(common) <= 2 or any(k % 2 == 0 for k in common):
            continue
        # lines that repeat a run of one of the two only, two times what a line once used, and many that repeat the common ones
        more = [f"{text(50)} {r} {text(46)}" for z in own for r in sorted(z)]
        rare = [m for m in more if (keys(m) & (keys(x) ^ keys(y)))]
        often = [m for m in more if keys(m) & common]
        per = [sum(len(keys(m) & (keys(z) - common)) > 0 for m in rare) for z in (x, y)]
        if min(per) <= 7 or not often:
            continue
        often = [f"{text(50)}{m[50:61]} {text(46)}" for m in often for _ in range(20)]
        planted.append((x, y))
        docs += [x, y, *rare, *often]
    d = spark.createDataFrame(list(enumerate(dict.fromkeys(docs))), "id long, text string").repartition(2)
    scratch = Scratch(spark, "test")
    occ = scratch.save(lines.occurrences(d), "occurrences")
    named = {r.text: r.line for r in occ.join(d, "id").collect()}
    table = occ.select("line", "len", "bag", F.struct("id", "pos").alias("first"))
    comps = {r.node: r.component for r in lines.groups(occ.select("line", "id", "keys"), table, d, scratch).collect()}
    assert all(comps.get(named[x], 0) == comps.get(named[y], 1) for x, y in planted)


def test_lines_meet_their_texts_in_rounds(spark, monkeypatch):
    """Lines of the same words in another order: nearly all are candidate pairs, none is linked but planted ones. All are compared, some at a time."""
    from jobloom.llm import lines
    from jobloom.llm.common import Scratch

    room = 4_000
    monkeypatch.setattr(lines, "ROOM_LINES", 2 * room, raising=False)
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(14)]
    texts = [" ".join(rnd.sample(words, len(words))) for _ in range(250)]
    texts += [t[:40] + "0" + t[41:] for t in texts[:5]]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    save, scratch = Scratch.save, Scratch(spark, "test")

    def described(self, df, name):
        spark.sparkContext.setJobDescription(f"rounds {name}")
        try:
            return save(self, df, name)
        finally:
            spark.sparkContext.setJobDescription(None)

    monkeypatch.setattr(Scratch, "save", described)
    occ = scratch.save(lines.occurrences(d), "occurrences")
    named = {r.id: r.line for r in occ.select("id", "line").collect()}
    table = occ.select("line", "len", "bag", F.struct("id", "pos").alias("first"))
    small = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(small)
    spark.conf.set(small, "-1")  # as with larger tables
    try:
        comps = {r.node: r.component for r in lines.groups(occ.select("line", "id", "keys"), table, d, scratch).collect()}
    finally:
        spark.conf.set(small, before)
    assert len(comps) == 10 and all(comps[named[i]] == comps[named[250 + i]] for i in range(5))
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    moved = [s.shuffleWriteRecords() for s in stages if s.description().isDefined() and s.description().get() == "rounds links"]
    assert sum(moved) > 28_000 and max(moved) < 1.5 * room, (sum(moved), max(moved))


# -- mixing -----------------------------------------------------------------------------------------------------------------------


def test_schedule_deviates_less_than_a_block():
    from jobloom.llm.mixing import parts, schedule

    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 0.9, "b": 0.07, None: 0.03}, {i: 1 + i % 7 for i in range(40)}):
        p, cycle = parts(weights)
        plan = schedule(p, cycle)
        assert sum(p.values()) == cycle and [s for *_, s in plan] == list(range(cycle))
        got = dict.fromkeys(p, 0)
        for k, j, release, due, slot in plan:
            assert release <= slot < due and got[k] == j
            got[k] += 1
            assert all(abs(got[x] - p[x] * (slot + 1) / cycle) < 1 for x in p)


def test_mix(spark):
    from jobloom.llm.mixing import mix

    rows = [(i, "t", "en", "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(3000)] + [(None, "t", "en", None, 1), (9000, "t", "en", None, 1)]
    d = docs_of(spark, rows).withColumn("slot", F.lit("mine"))
    out = mix(d, {"hot": 0.2, "s0": 0.3, "s1": 0.5}, block_rows=4).collect()
    assert len(out) == len(rows)
    placed = [r for r in out if r.slot is not None]
    assert len({r.position for r in placed}) == len(placed) and {r.source for r in placed} == {"hot", "s0", "s1"}
    inside = [r.source for r in out if r.in_mix]
    share = {s: inside.count(s) / len(inside) for s in ("hot", "s0", "s1")}
    assert abs(share["hot"] - 0.2) < 0.02 and abs(share["s0"] - 0.3) < 0.02
    assert mix(empty(spark)).count() == 0 and mix(docs_of(spark)).count() == len(EDGE)


def test_mix_keeps_its_share_with_rare_sources(spark):
    """One row of another or a null source, or a few, must not end the default mix."""
    from jobloom.llm.mixing import mix

    big = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    for more in ([("one", 1)], [(None, 1), ("few", 15)], [("some", 80), ("more", 413), (None, 9)]):
        rows = [(10**6 + 1000 * i + j, k) for i, (k, n) in enumerate(more) for j in range(n)]
        out = mix(big.unionByName(spark.createDataFrame(rows, "doc_id long, source string"))).persist()
        got = {r.source: (r.n, r.kept) for r in out.groupBy("source").agg(F.count("*").alias("n"), F.count_if("in_mix").alias("kept")).collect()}
        n = sum(v[0] for v in got.values())
        assert 0.89 * n < sum(v[1] for v in got.values()) < 0.92 * n
        assert all(got[k][1] >= min(v, 0.96 * v - 8) for k, v in more)
        assert out.select(F.count_distinct("position"), F.count_if(F.expr("release > slot or slot >= deadline"))).first()[:] == (n, 0)
        # rare rows lie all over the mix and not at its beginning
        places = [r.slot for r in out.where("source not in ('x', 'y')").orderBy("slot").collect()]
        assert len(rows) < 100 or places[len(places) // 2] > 0.3 * 0.9 * n / 8
        out.unpersist()
    # one document more of another source costs some rows at most, with explicit weights as well
    weights = {"x": 1 / 3, "y": 2 / 3, "one": 1 / 200_001}
    assert mix(big.unionByName(spark.createDataFrame([(-1, "one")], big.schema)), weights).where("in_mix").count() > 0.99 * 200_000


def test_mix_deals_repeated_ids(spark, monkeypatch):
    """Null and repeated ids, a third of all rows each, are ranked in pieces, without gaps and each row once."""
    from jobloom.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 64)
    ids = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long")
    d = spark.range(6_000).select(ids.alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").alias("source"), F.col("id").alias("mine"))
    out = mixing.mix(d).persist()
    assert out.select(F.count("*"), F.count_distinct("mine"), F.count_distinct("position")).first()[:] == (6_000, 6_000, 6_000)
    for source in ("source = 'a'", "source is null"):
        assert sorted(r.block for r in out.where(source).collect()) == [i // mixing.BLOCK_ROWS for i in range(3_000)]
    out.unpersist()


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_mixing_query(spark):
    """The whole query: blocks of each source without gaps, windows kept, no two rows at a place, less than two blocks from the weight."""
    from jobloom.llm.mixing import BLOCK_ROWS, op8_mixing, tempered

    out = op8_mixing(spark, SF01).collect()
    sizes = {}
    for r in spark.read.parquet(f"{SF01}/documents.parquet").collect():
        sizes[r.source] = sizes.get(r.source, 0) + 1
    assert len(out) == sum(sizes.values()) and len({r.position for r in out}) == len(out) and all(r.release <= r.slot < r.deadline for r in out)
    weights = tempered(sizes)
    inside = [r for r in sorted(out, key=lambda r: r.position) if r.in_mix]
    got = dict.fromkeys(sizes, 0)
    for s in sizes:
        blocks = sorted(r.block for r in out if r.source == s)
        assert blocks == [i // BLOCK_ROWS for i in range(sizes[s])]
    for n, r in enumerate(inside, 1):
        got[r.source] += 1
        if n % 100 == 0:
            assert all(abs(got[s] - n * w / sum(weights.values())) < 2 * BLOCK_ROWS + 0.02 * n for s, w in weights.items()), n
    assert len(inside) >= 0.85 * len(out)


# -- WARC -------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    from jobloom.llm.warc import read_warc, write_warc

    rows = [(i, f"http://a/{i}\r\nX: 1 %0A", "é" * (i % 7) if i % 2 else f"page {i}") for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "n", "page 2"), (102, "big", "y" * 300_000), (58, "again", "page 58")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("top", F.lit(1))
    m = write_warc(pages, f"file://{tmp_path}/w", 3, roll_bytes=2000)
    assert m.count() > 3 and m.agg(F.sum("records")).first()[0] == len(rows)
    out = read_warc(spark, f"file://{tmp_path}/w", True).collect()
    by = {}
    for i, _, h in rows:
        by[h or ""] = max(by.get(h or "", -1), -1 if i is None else i)
    assert sorted((repr(r.page_id), repr(r.url)) for r in out) == sorted((repr(i), repr(u)) for i, u, _ in rows)
    html = {(i, u): h or "" for i, u, h in rows}
    for r in out:
        h = html[r.page_id, r.url]
        assert r.payload_bytes == len(h.encode())
        if r.page_id == by[h]:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload).decode() == h
        else:
            assert r.record_type == "revisit" and r.refers_to == by[h]
    again = write_warc(pages.repartition(5), f"file://{tmp_path}/v", 3, roll_bytes=2000)
    assert {r.sha256 for r in again.collect()} == {r.sha256 for r in m.collect()}
    assert read_warc(spark, f"file://{tmp_path}/w").count() == len(rows)
    write_warc(pages.where("false"), f"file://{tmp_path}/e", 2)
    assert spark.read.parquet(f"file://{tmp_path}/e/_manifest").count() == 0


# -- token counts -----------------------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from jobloom.llm.token_counts import count_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(9)
    alphabet = ["a", "B", " ", "é", "İ", "'s", "123", "½", "<|endoftext|>", "\x1c", "ſ", "中", "!?", "\n", "ά", "word"]
    rows = [(i, "".join(rnd.choices(alphabet, k=rnd.randint(0, 30)))) for i in range(400)] + [(1000, None), (1001, "z" * 20_000)]
    t = Tokenizer.from_file(path)
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("x")), path).collect()
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in rows}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in out)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_token_counts_of_another_file(spark, tmp_path):
    """A file that splits in another way is counted by the library alone."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import json

    from tokenizers import Tokenizer

    from jobloom.llm.token_counts import count_tokens, splits_as_known

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        d = json.load(f)
    d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(d, f)
    assert splits_as_known(public_tokenizers.path("word_bpe_49k.json")) and not splits_as_known(path)
    texts = ["it's 2024, isn't it?", "abc123 don't", ""]
    t = Tokenizer.from_file(path)
    out = count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {texts[r.doc_id]: r.n_tokens for r in out} == {x: len(t.encode(x, add_special_tokens=False)) for x in texts}


def test_token_counts_specials_in_other_case(spark):
    """Only the exact special strings are special; in other case they are text."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from jobloom.llm.token_counts import count_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["<|ENDOFTEXT|>", "<|endofText|>", "a <|STARTOFTEXT|> b", "<|startoftext|>x<|EndOfText|>", "<|endoftext|>", "<|END", "!<|ENDOFTEXT|><|endoftext|>"]
    t = Tokenizer.from_file(path)
    out = count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {texts[r.doc_id]: r.n_tokens for r in out} == {x: len(t.encode(x, add_special_tokens=False)) for x in texts}


# -- queries and pipeline -----------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_topk_sql(spark):
    import duckdb

    from jobloom.llm.topk import ORACLE_SQL, op1_topk

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert {tuple(r) for r in op1_topk(spark, SF).collect()} == set(con.execute(ORACLE_SQL["op1_topk"]).fetchall())


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_pipeline_stages_take_edge_rows(spark):
    """Nulls, empty texts, repeated ids, an empty table, and columns of names that the stages use themselves."""
    import corpus_pipeline

    names = ("_score", "contaminated", "n_items", "slot", "in_mix", "position", "_id", "_th", "_doc", "_all")
    for rows, gone in ((EDGE, 1), ([], 0)):
        docs = spark.createDataFrame(rows, DOC).withColumns({n: F.lit("mine") for n in names})
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            kept = out.collect()
            assert all(r[n] == "mine" for r in kept for n in names)
            want = [r[0] for r in rows]
            got = [r.doc_id for r in kept]
            assert set(map(repr, got)) <= set(map(repr, want)), name
            # nothing here is toxic, alike (the repeated row is one document) or in the benchmark; a mix may leave rows out
            assert name == "mixing" or sorted(map(repr, got)) == sorted(map(repr, want)), name
        last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
        assert last.count() == len(rows) and set(last.columns) == {*docs.columns, "shard"}


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline
    from jobloom.llm.common import Scratch

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, columns = Scratch(spark, "test"), docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.save(stage(spark, before, SF), name.replace("-", "_"))
        assert docs.columns[: len(columns)] == columns and (n == 4 or docs.columns == columns)
        assert 0 < docs.count() <= before.count() and docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "near-duplicates":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            want = {i for i, (_, c) in brute_components(rows).items() if i == c}
            assert {r.doc_id for r in docs.collect()} == want
    assert docs.count() == docs.select("shard", "slot").distinct().count()


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_sharding_query(spark):
    """Against a brute-force reading of the law: order by the rows' own places, groups whole, bytes near equal."""
    from jobloom.llm.sharding import op6_sharding

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op6_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 and r.grown_shard is None and r.law == "bytes" for r in out)
    assert len({(r.shard, r.slot) for r in out}) == len(out)
    total, at, starts = sum(r.size for r in out), 0, {}
    for r in sorted(out, key=lambda r: (r.shard, r.slot)):
        starts.setdefault(texts[r.doc_id], (at, r.shard))
        begin, shard_ = starts[texts[r.doc_id]]
        own = at * 16 // total
        assert r.shard == own or r.shard == shard_ == begin * 16 // total
        at += r.size
    assert {r.shard for r in out} <= set(range(16)) and all(max(x.slot for x in out if x.shard == s) + 1 == sum(x.shard == s for x in out) for s in {r.shard for r in out})
