"""Toxicity by a weighted finite-state pattern grammar.

Method: a clause is read by the composition of small transducers. The insult
transducer spells words against a learned, weighted lexicon of word beginnings;
the threat transducer needs a verb of violence after an intent or beside a
target; target, negation and reported-speech transducers carry the context in
which a match stands (next to "you", in the scope of "not", inside quotes or
after "said"). A match is scored with its context and its clause, so the same
word counts differently in an attack, a denial and a quotation. What each
context is worth is learned too (logistic regression over match scores).

Learning. A bounded sample of the labelled rows (``TRAIN_ROWS``, the smallest
hashes) gives, each text once, (1) the lexicon: word beginnings far more frequent in toxic
texts (log-likelihood ratio, counted by a Spark aggregation), at most
``MAX_TERMS``; (2) one small feature vector a row, on which the weights are
fitted. Scoring reads every whole text once, without a shuffle.

Edge cases: null and empty texts have no match and get the score of the
intercept; rows without label or id are not learned from; without labelled
rows every score is 0; labels that repeat an id count once each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, forget_words, store

TRAIN_ROWS = 20_000
MAX_TERMS = 5_000
#: Entries that a task counts or keeps before it hands on or forgets them.
FLUSH = 150_000
#: Word beginnings of these lengths are candidates.
SHORTEST, LONGEST = 3, 10
#: A term stands in at least this many toxic texts, and this share of them.
MIN_TEXTS, MIN_SHARE = 5, 0.01
#: It is at least this many times as frequent in toxic texts, by a
#: log-likelihood ratio of at least MIN_G2.
MIN_RATIO, MIN_G2 = 3.0, 25.0

# Function words of the grammar, by language: English, German, French, Spanish.
NEGATION = """not no never none nobody nothing neither nor without cannot isn't aren't wasn't weren't don't doesn't didn't won't
wouldn't can't shouldn't nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans ni nunca jamás ningún ninguna sin""".split()
REPORTED = """said says say called calls calling wrote writes claimed claims told tells quoted quotes reportedly allegedly according
sagte sagt nannte schrieb behauptet laut dit disait appelé écrit selon dijo dice llamó escribió según""".split()
TARGET = """you your yours yourself you're u he she they him her them his their those these du dich dir dein deine ihr euch sie
tu toi te ton ta vous votre ils elles tú ti usted ustedes vosotros él ella ellos ellas""".split()
INTENT = """will would gonna going shall should must i'll we'll 'll werde werden wird soll sollte vais va allons devrait voy vamos debe debería""".split()
THREAT = """kill killed murder hurt beat destroy die burn shoot stab hang smash punch strangle töten umbringen sterben schlagen verbrennen
tuer mourir frapper brûler matar morir golpear quemar""".split()

OTHER, INSULT, THREATEN, DENY, REPORT, AIM, INTEND, QUOTE, END = range(9)
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:…\n]+|[\"“”«»„]")
_FIXED = {w: c for c, ws in ((DENY, NEGATION), (REPORT, REPORTED), (AIM, TARGET), (INTEND, INTENT), (THREATEN, THREAT)) for w in ws}
PLAIN, AIMED, DENIED, REPORTED_AS = range(4)
N_FEATURES = 12


# --- transducers: (state, symbol) -> (state, mark) -------------------------------------

def _window(opening: int, reach: int):
    """Marks the ``reach`` symbols after ``opening``; a clause end closes it."""
    def step(state: int, symbol: int) -> tuple[int, bool]:
        if symbol == END:
            return 0, False
        if symbol == opening:
            return reach, state > 0
        return max(0, state - 1), state > 0
    return step


def _reported(state: int, symbol: int) -> tuple[int, bool]:
    """Bit 0: after a verb of saying, to the clause end; bit 1: inside quotes."""
    if symbol == QUOTE:
        return state ^ 2, state > 0
    if symbol == REPORT:
        return state | 1, state > 0
    if symbol == END:
        return state & 2, False
    return state, state > 0


def compose(*machines):
    """The product machine: its state is the tuple of states, its output the
    tuple of marks. Transitions are worked out once each."""
    table: dict = {}

    def step(state: tuple, symbol: int):
        got = table.get((state, symbol))
        if got is None:
            pairs = [m(s, symbol) for m, s in zip(machines, state, strict=True)]
            got = table[state, symbol] = tuple(p[0] for p in pairs), tuple(p[1] for p in pairs)
        return got

    return step, (0,) * len(machines)


FORWARD, START = compose(_window(AIM, 4), _window(INTEND, 4), _window(DENY, 5), _reported)
BACKWARD, BACK_START = compose(_window(AIM, 4))


class Grammar:
    """The composed grammar with a learned lexicon {word beginning: weight}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.lengths = sorted({len(t) for t in lexicon}, reverse=True)
        self.cache: dict[str, tuple[int, str]] = {}

    def symbol(self, token: str) -> tuple[int, str]:
        """Symbol class of a token and, for an insult, its lexicon entry."""
        got = self.cache.get(token)
        if got is None:
            got = self._spell(token)
            if len(self.cache) >= FLUSH:  # a bound on memory alone; entries are recomputed
                self.cache.clear()
            self.cache[token] = got
        return got

    def _spell(self, token: str) -> tuple[int, str]:
        if token[0] in ".!?;:…\n":
            return END, ""
        if token in "\"“”«»„":
            return QUOTE, ""
        fixed = _FIXED.get(token, OTHER)
        if fixed in (OTHER, THREATEN):  # a function word is none of the learned ones
            for n in self.lengths:
                if token[:n] in self.lexicon and n <= len(token):
                    return INSULT, token[:n]
        return fixed, ""

    def matches(self, text: str) -> tuple[list[tuple[int, str, int, int]], int, int]:
        """([(symbol, term, context, clause)], tokens, clauses) of a text."""
        read = [self.symbol(t) for t in _TOKEN.findall(text.lower())]
        symbols = [s for s, _ in read]
        clauses = 1 + symbols.count(END)
        if INSULT not in symbols and THREATEN not in symbols:
            return [], len(symbols), clauses
        state, back, marks, behind, clause = START, BACK_START, [], [], 0
        for s in symbols:
            state, m = FORWARD(state, s)
            marks.append((*m, clause))
            clause += s == END
        for s in reversed(symbols):
            back, m = BACKWARD(back, s)
            behind.append(m[0])
        out = []
        for (s, term), (aim, intent, deny, said, clause), later in zip(read, marks, reversed(behind), strict=True):
            if s == INSULT or s == THREATEN and (aim or later or intent):
                context = REPORTED_AS if said else DENIED if deny else AIMED if aim or later else PLAIN
                out.append((s, term, context, clause))
        return out, len(symbols), clauses

    def features(self, text: str | None) -> list[float]:
        found, n, clauses = self.matches(text or "")
        f = [0.0] * N_FEATURES
        if not found:
            return f
        by_clause: Counter = Counter()
        terms = set()
        for s, term, context, clause in found:
            if s == INSULT:
                w = self.lexicon[term]
                f[context] += w
                terms.add(term)
            else:
                w = 1.0
                f[4 if context <= AIMED else 5] += w
            by_clause[clause] += w
        total = sum(f[:4])
        f[:6] = [math.log1p(x) for x in f[:6]]
        f[6] = math.log1p(100 * total / n)
        f[7] = len(by_clause) / clauses
        f[8] = math.log1p(max(by_clause.values()))
        f[9] = math.log1p(len(terms))
        f[10] = math.log1p(n)
        f[11] = 1.0
        return f


# --- learning --------------------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, label) of at most ``TRAIN_ROWS`` labelled rows outside the held-out fold."""
    mine = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label"))
    mine = mine.where(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & (crc_fold(F.col("_id")) != 0))
    sample = mine.orderBy(F.xxhash64("_id"), "label").limit(TRAIN_ROWS)
    return (docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .join(F.broadcast(sample), "_id").select("text", "label").dropDuplicates())


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Word beginnings that mark toxic texts, with their log odds."""

    def count(batches):
        forget_words()
        seen: list[Counter] = [Counter(), Counter(), Counter(), Counter()]  # tokens of clean, toxic; texts of clean, toxic

        def flush():
            keys = sorted(set().union(*seen))
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.float64()) for c in seen)],
                                             names=["term", "c_tokens", "t_tokens", "c_texts", "t_texts"])
            for c in seen:
                c.clear()
            return out

        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                words = Counter(w for w in _TOKEN.findall(t.lower()) if w[0].isalnum())
                mine: Counter = Counter()
                for w, n in words.items():
                    for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                        mine[w[:k]] += n
                mine = Counter({w: 1 + math.log(n) for w, n in mine.items()})  # a word repeated in one text says less each time
                mine[""] = sum(1 + math.log(n) for n in words.values())  # the totals
                seen[y].update(mine)
                seen[2 + y].update(mine.keys())
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
        if any(seen):
            yield flush()

    counts = store(rows.mapInArrow(count, "term string, c_tokens double, t_tokens double, c_texts double, t_texts double").groupBy("term")
                   .agg(*(F.sum(c).alias(c) for c in ("c_tokens", "t_tokens", "c_texts", "t_texts"))).where("t_texts > 0"), "terms")
    total = counts.where("term = ''").first()
    if total is None:
        return {}
    rate_t, rate_c = F.col("t_tokens") / F.lit(max(1.0, total.t_tokens)), (F.col("c_tokens") + 0.5) / F.lit(max(1.0, total.c_tokens))
    share = total.t_tokens / max(1, total.t_tokens + total.c_tokens)
    expected = (F.col("t_tokens") + F.col("c_tokens")) * share
    g2 = 2 * (F.col("t_tokens") * F.log(F.col("t_tokens") / expected)
              + F.col("c_tokens") * F.log(F.greatest(F.col("c_tokens"), F.lit(1e-9)) / F.greatest(F.col("t_tokens") + F.col("c_tokens") - expected, F.lit(1e-9))))
    need = max(MIN_TEXTS, MIN_SHARE * total.t_texts)
    best = (counts.where((F.col("term") != "") & (F.col("t_texts") >= need)).select("term", F.log(rate_t / rate_c).alias("w"), g2.alias("g2"))
            .where((F.col("w") >= math.log(MIN_RATIO)) & (F.col("g2") >= MIN_G2))
            .orderBy(F.col("g2").desc(), F.length("term").desc(), "term").limit(MAX_TERMS).collect())
    lexicon: dict[str, float] = {}
    for r in best:  # the strongest evidence first; neither its beginnings nor its extensions after it
        if not any(r.term[:k] in lexicon for k in range(SHORTEST, len(r.term) + 1)) and not any(t.startswith(r.term) for t in lexicon):
            lexicon[r.term] = min(8.0, r.w)
    return lexicon


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Logistic regression with an intercept (last weight), by Newton steps. A
    step is halved until it lowers the loss: where a few features part the
    labels, whole steps overshoot and swing from side to side."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        while (then := loss(w - step)) > now and np.abs(step).max() >= 1e-8:
            step /= 2
        if np.abs(step).max() < 1e-8:
            break
        w, now = w - step, then
    return w


class Model:
    """Lexicon and context weights; small, sent to tasks with the function."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def __reduce__(self):
        return Model, (self.lexicon, self.weights)

    def scorer(self):
        g = Grammar(self.lexicon)
        if self.weights is None:
            return lambda text: 0.0
        w = self.weights

        def score(text: str | None) -> float:
            z = float(np.dot(w[:-1], g.features(text)) + w[-1])
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return score


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    rows = store(training_rows(docs, labels, key, text, label), "toxic-train")
    lexicon = learn_lexicon(rows)

    def run(batches):
        g = Grammar(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([g.features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("label")], names=["f", "label"])

    got = sorted(rows.mapInArrow(run, "f array<double>, label int").collect(), key=lambda r: (r.label, r.f))  # TRAIN_ROWS short vectors at most
    if not got:
        return Model(lexicon, None)
    return Model(lexicon, fit_weights(np.array([r.f for r in got]), np.array([r.label for r in got], float)))


# --- scoring ---------------------------------------------------------------------------

def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the matches of every text."""

    def run(batches):
        forget_words()
        s = model.scorer()
        for b in batches:
            p = [s(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    ids = F.col(key)
    return (docs.select(ids.alias("doc_id"), F.col(text).alias("text"), F.coalesce(crc_fold(ids) == 0, F.lit(False)).alias("held_out"))
            .mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""

    def run(batches):
        forget_words()
        s = model.scorer()
        for b in batches:
            yield b.filter(pa.array([s(t) < threshold for t in b.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def clause_matches(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per matched clause pattern: doc_id, clause, kind, term, context."""
    kinds, contexts = {INSULT: "insult", THREATEN: "threat"}, ("plain", "targeted", "negated", "reported")

    def run(batches):
        g = Grammar(model.lexicon)
        for b in batches:
            rows = [(i, c, kinds[s], t, contexts[x]) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, t, x, c in g.matches(v or "")[0]]
            if rows:
                i, c, k, t, x = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, b.column(0).type), pa.array(c, pa.int64()), pa.array(k), pa.array(t), pa.array(x)],
                                                 names=["doc_id", "clause", "kind", "term", "context"])

    return (docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, clause long, kind string, term string, context string"))
