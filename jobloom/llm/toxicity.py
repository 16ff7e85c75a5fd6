"""Toxicity: a weighted finite-state grammar over clauses, with a lexicon and arc weights learned from labelled rows.

Each token of a text is read as a symbol: insult, threat, target, negation, report, quotation mark or other. Five weighted
transducers are tables of arcs: one marks an insult or a threat (insult and threat share a start), the others read its tape and
tell whether the mark is negated, reported, or aimed at a target. Their composition is worked out once, as the product of their states; a clause's
evidence is the sum over all accepted paths of the products of their weights. A clause of a single word is no clause and a
threat without a target is none, so isolated words score nothing. A document's score is a calibrated function of its clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table

#: Labelled documents that a model is fitted on, about (a hash of doc_id chooses them).
SAMPLE_DOCS = 12_000
STEMS = (4, 5, 6, 7, 8)
#: A term is listed when toxic texts hold it e**MIN_ODDS times as often as others; a listed insult that no label contradicts has SEED_ODDS.
MIN_ODDS, SEED_ODDS = 3.5, 5.0

# Fixed closed-class words of the grammar in the four languages of the corpus.
NEGATION = "not no never nor cannot isn't don't nicht kein keine nie pas ne jamais aucun nunca ni".split()
REPORT_WORDS = "said says quoted called wrote claims sagte sagt nannte schrieb dit disait appelle dijo dice llama".split()
TARGET = "you your yours u du dich dein ihr euch tu toi vous ton tes usted ustedes tus eres".split()
INSULT = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting dumb jerk bastard filth dummkopf abschaum trottel arschloch drecksau crétin imbécile connard ordure salaud estúpido imbécil basura escoria cabrón".split()
THREAT = "kill hurt destroy beat shoot burn attack töten schlagen verbrennen tuer frapper brûler matar golpear quemar".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]|[.!?;\n]+")
MARKS, QUOTES = frozenset(".!?;\n"), frozenset('"“”„«»')

# -- the grammar: machines as tables of arcs ---------------------------------------------------------------------------------

#: Symbols of the first tape. I and H of the later tapes are i and h where they are the marked insult or threat of a path.
SYMBOLS = "INTRQHO"
END = "$"


@dataclass(frozen=True)
class Machine:
    """(state, input) -> [(next state, output, label)]; any other input but the end is copied and leaves the state.

    A label names the weight of an arc. `end` says what a state makes of the end of a clause, as arcs do; a state that does not
    know an end accepts nothing. `keeps` are the states that the next clause starts in.
    """

    start: str
    arcs: dict
    end: dict
    keeps: frozenset = frozenset()

    def step(self, state: str, symbol: str) -> list[tuple]:
        if symbol.startswith(END):
            return self.end.get((state, symbol), [])
        return self.arcs.get((state, symbol), [(state, symbol, None)])


_SAME = {"$i": [("", "$i", None)], "$h": [("", "$h", None)]}


def _ends(states: str) -> dict:
    """Both kinds of clause end pass in these states."""
    return {(s, e): arcs for s in states.split() for e, arcs in _SAME.items()}


#: Insult and threat: a path marks one of them, or goes on without it.
MARK = Machine(
    "open",
    {("open", "I"): [("open", "I", None), ("insult", "i", "insult")], ("open", "H"): [("open", "H", None), ("threat", "h", "threat")]},
    {("insult", END): [("", "$i", None)], ("threat", END): [("", "$h", None)]},
)
#: A negation reaches two tokens far.
NEGATE = Machine(
    "free",
    {(s, "N"): [("two", "N", None)] for s in ("free", "two", "one")}
    | {(s, x): [(t, x, "negation" if x in "ih" else None)] for s, t in (("two", "one"), ("one", "free")) for x in "ITRQHOih"},
    _ends("free two one"),
)
#: What follows a word of report is reported up to the end of the clause, and in quotation marks up to the closing one.
REPORT = Machine(
    "plain",
    {("plain", "R"): [("reported", "R", None)], ("reported", "Q"): [("quoted", "Q", None)], ("quoted", "Q"): [("plain", "Q", None)]}
    | {(s, x): [(s, x, "report")] for s in ("reported", "quoted") for x in "ih"},
    _ends("plain reported quoted"),
    frozenset({"quoted"}),
)
#: A target anywhere in the clause; a threat needs one.
TARGET_SEEN = Machine(
    "none",
    {("none", "T"): [("seen", "T", None)]},
    {("none", "$i"): [("", "$i", None)], ("seen", "$i"): [("", "$i", "target")], ("seen", "$h"): [("", "$h", "target")]},
)
#: A clause has two words at least.
WORDS = Machine(
    "no",
    {("no", x): [("one", x, None)] for x in "INTRHOih"} | {("one", x): [("more", x, None)] for x in "INTRHOih"},
    _ends("more"),
)
GRAMMAR = (MARK, NEGATE, REPORT, TARGET_SEEN, WORDS)
LABELS = ("threat", "negation", "report", "target")


def compose(machines: tuple[Machine, ...]) -> tuple[dict, dict, dict]:
    """The product machine of all reachable states: arcs, ends, and the start of the clause that follows.

    arcs: (state, symbol) -> [(next state, labels)]; ends: state -> [labels] of accepted paths; a state is a tuple of states.
    """

    def through(states: tuple, symbol: str) -> list[tuple]:
        found = [((), symbol, ())]
        for m, s in zip(machines, states, strict=True):
            found = [((*at, t), y, (*labels, label) if label else labels) for at, x, labels in found for t, y, label in m.step(s, x)]
        return [(at, frozenset(labels)) for at, _, labels in found]

    begin = tuple(m.start for m in machines)
    arcs, ends, after, waiting = {}, {}, {}, [begin]
    while waiting:
        at = waiting.pop()
        if at in after:
            continue
        after[at] = tuple(s if s in m.keeps else m.start for m, s in zip(machines, at, strict=True))
        ends[at] = [labels for _, labels in through(at, END)]
        waiting.append(after[at])
        for x in SYMBOLS:
            arcs[at, x] = through(at, x)
            waiting += [t for t, _ in arcs[at, x]]
    return arcs, ends, after


ARCS, ENDS, AFTER = compose(GRAMMAR)
BEGIN = tuple(m.start for m in GRAMMAR)


@dataclass
class Model:
    """Lexicon weights (whole words and stems), arc weights, and the calibration score -> probability."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=lambda: {"negation": 0.5, "report": 0.5, "target": 1.5, "threat": 2.0})
    slope: float = 1.0
    bias: float = -3.0

    def insult(self, word: str) -> float:
        w = self.words.get(word)
        if w is not None:
            return w
        return max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0) if self.stems else 0.0


def symbol(token: str, model: Model) -> tuple[str, float]:
    """A token's symbol and the weight of its arc."""
    if token in QUOTES:
        return "Q", 1.0
    w = model.insult(token)
    return ("I", w) if w else (_KINDS.get(token, "O"), 1.0)


def clause_matches(tokens: list[str], model: Model) -> list[tuple[float, frozenset[str]]]:
    """The composed machine over one text: (weight, labels of arcs) of each clause's accepted paths, equal labels summed.

    Forward sums: for each state and set of labels the weight of all paths that lead there.
    """
    read = {t: symbol(t, model) for t in set(tokens) if t[0] not in MARKS}
    marked = {t for t, (x, _) in read.items() if x in "IH"}
    kept = {t for t, (x, _) in read.items() if x in "RQ"}
    out: list[tuple[float, frozenset[str]]] = []
    state, begin = BEGIN, 0
    for end in [*(i for i, t in enumerate(tokens) if t[0] in MARKS), len(tokens)] if marked else ():
        clause, begin = tokens[begin:end], end + 1
        # a clause without a word to mark accepts nothing; it matters where it opens or shuts what the next one starts in
        if state == BEGIN and marked.isdisjoint(clause) and kept.isdisjoint(clause):
            continue
        here: dict = {(state, frozenset()): 1.0}
        for t in clause:
            x, weight = read[t]
            nxt: dict = {}
            for (at, labels), w in here.items():
                for to, more in ARCS[at, x]:
                    key = to, labels | more
                    nxt[key] = nxt.get(key, 0.0) + w * (weight if more & _MARKED else 1.0)
            here = nxt
        found: dict = {}
        for (at, labels), w in here.items():
            for more in ENDS[at]:
                found[labels | more] = found.get(labels | more, 0.0) + w
        out.extend((w, labels - {"insult"}) for labels, w in found.items())
        # the path without a mark has read every token: its state is what the clause leaves
        state = AFTER[next(at for (at, labels) in here if not labels)]
    return out


_MARKED = frozenset({"insult", "threat"})
_KINDS = {w: k for k, ws in (("R", REPORT_WORDS), ("T", TARGET), ("N", NEGATION), ("H", THREAT)) for w in ws}


def evidence(matches: list[tuple[float, frozenset[str]]], factors: dict[str, float]) -> float:
    """Sum of the weights of all paths: lexicon weights times the weights of their labelled arcs."""
    return sum(w * math.prod(factors[a] for a in arcs) for w, arcs in matches)


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def probability(x: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * math.log1p(max(0.0, x))))))


def fit(labelled: DataFrame) -> Model:
    """Learns a model from (text, toxic 0/1) rows, which the caller has bounded (see `sample_labelled`).

    The lexicon holds words and stems whose counts in toxic and other documents differ more than chance explains for the number
    of terms tried. Arc factors are those of a small grid that fit the sample best; the calibration is a logistic regression.
    Without toxic or other rows nothing is learned: the list of plain insults stays and the calibration is the default one,
    with the smoothed share of toxic rows as its bias.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {t for t in tokens_of(text) if t[0] not in MARKS and t not in QUOTES}
                terms = {"w" + t for t in words} | {f"s{t[:k]}" for t in words for k in STEMS if len(t) >= k}
                (pos if toxic else neg).update(terms)
                n[1 - toxic] += 1
        terms = [*pos, *(t for t in neg if t not in pos)]
        terms, ps, ns = [*terms, ""], [*(pos[t] for t in terms), n[0]], [*(neg[t] for t in terms), n[1]]
        for i in range(0, len(terms), 20_000):
            yield pa.RecordBatch.from_pydict({"term": terms[i : i + 20_000], "pos": pa.array(ps[i : i + 20_000], pa.int64()), "neg": pa.array(ns[i : i + 20_000], pa.int64())})

    counts = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.persist()
    try:
        total = counts.where("term = ''").first()
        n_pos, n_neg = (total.pos, total.neg) if total else (0, 0)
        model = Model(words=dict.fromkeys(INSULT, SEED_ODDS), bias=math.log((n_pos + 0.5) / (n_neg + 4.5)))
        if not n_pos or not n_neg:
            return model
        tried = counts.where("pos > 0").count()
        p = n_pos / (n_pos + n_neg)
        n = F.col("pos") + F.col("neg")
        gain = F.col("pos") * F.log(F.col("pos") / (n * p)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - p)))).otherwise(0.0)
        odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
        top = counts.where("term <> ''").withColumns({"gain": gain, "odds": odds}).where((F.col("gain") > math.log(tried + 1) + 1) & (F.col("odds") > MIN_ODDS) & (F.col("pos") > 0)).collect()  # terms of the sample
        seen = {r.term[1:]: r for r in counts.where(F.col("term").isin(["w" + w for w in INSULT])).collect()}
    finally:
        counts.unpersist()
    # an insult that the labels speak about counts as they say
    told = {w: math.log((r.pos + 0.5) / (n_pos + 1)) - math.log((r.neg + 0.5) / (n_neg + 1)) for w, r in seen.items() if r.pos + r.neg >= 5}
    model.words = {w: x for w, x in (model.words | told).items() if x > MIN_ODDS}
    model.words |= {r.term[1:]: float(r.odds) for r in top if r.term[0] == "w"}
    model.stems = {r.term[1:]: float(r.odds) for r in top if r.term[0] == "s"}
    # a word that a stem explains is read through its stem; a stem that is one listed word adds nothing
    model.stems = {s: w for s, w in model.stems.items() if sum(x.startswith(s) for x in model.words) != 1}

    found = labelled.mapInPandas(_match_rows(model), "toxic int, x array<double>").toPandas()  # bounded by the sample
    grid = _grid()
    x = np.log1p(np.maximum(0, np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(grid))))
    y = found["toxic"].to_numpy(float)
    fits = [_logistic(x[:, j], y) for j in range(len(grid))]
    best = min(range(len(grid)), key=lambda j: fits[j][2])
    model.factors, (model.slope, model.bias, _) = grid[best], fits[best]
    return model


def _grid() -> list[dict[str, float]]:
    """Weights to choose from; each arc keeps a weight of its own in all of them."""
    return [{"negation": a, "report": b, "target": c, "threat": d} for a in (0.3, 0.7) for b in (0.3, 0.7) for c in (1.25, 2.0) for d in (1.0, 3.0)]


def _match_rows(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = _grid()
        for b in batches:
            matches = [clause_matches(tokens_of(t), model) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"].astype("int32"), "x": [[evidence(m, f) for f in grid] for m in matches]})

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope (not below 0), bias and loss of a ridge logistic regression in one variable, by Newton steps."""
    w = np.array([0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    a = np.stack([x, np.ones_like(x)], axis=1)
    ridge = np.array([1e-2, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[0] = max(0.0, w[0])
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The probability that a text is toxic, 0 to 1, for the rows of `docs`; a null text is scored as an empty one."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        listed = set(model.words)
        stems = set(model.stems)
        rest = frozenset(THREAT)
        for texts in batches:
            out = []
            for text in texts:
                tokens = tokens_of(text)
                kinds = set(tokens)
                # most texts hold no listed word: they skip the machine and get what it gives without a match
                hit = not listed.isdisjoint(kinds) or not rest.isdisjoint(kinds) or any(not stems.isdisjoint([t[:k] for t in kinds if len(t) >= k]) for k in STEMS)
                out.append(probability(evidence(clause_matches(tokens, model), model.factors) if hit else 0.0, model))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(scores, "double")(F.coalesce(F.col(text_col), F.lit("")))


def sample_labelled(docs: DataFrame, labels: DataFrame, held_out: Column, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic) of labelled, not held-out documents, about `sample_docs` of them, chosen by a hash of doc_id."""
    # several labels of one document count as one, toxic if any is
    y = labels.where("doc_id is not null and toxic is not null").where(~held_out).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = y.count()
    share = min(1.0, sample_docs / max(1, n))
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = min(n, int(1.2 * sample_docs))
    return docs.select("doc_id", "text").where("text is not null").join(small(y, rows), "doc_id").select("text", "toxic")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    """A model of the labelled rows of `docs` (default: documents) that are not held out; see `fit` for tables without such rows.

    Rows with a null id or text teach nothing, repeated rows count as often as they occur, and columns but doc_id and text are
    not looked at.
    """
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return fit(sample_labelled(docs, table(spark, sf_dir, "labels"), is_held_out(F.col("doc_id"))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score: null and empty texts have that of no match, repeated rows the same score each.

    Texts of any length are read whole. An empty table gives an empty result.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = score(d, train(spark, sf_dir, d))
    return d.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), s.alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
