"""Trained scorers of the second kind: TF-IDF, logistic regression, pseudo-perplexity."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from textguard.operators import features as FE
from textguard.operators import scoring as SC

TEXTS = ["the cat sat on the mat", "The dog sat", "a cat a cat a cat", "", None, "one", "dog cat mat the on", "Привет"]


def frame(spark, texts, extra=""):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for c in extra.split():
        df = df.withColumn(c, F.lit("x"))
    return df


def words(t):
    return re.findall("[a-z]+", (t or "").lower())


def test_pseudo_perplexity_brute_force(spark):
    new = ["the cat sat", "unseen words here", "cat", "", None, "the mat sat on the cat on the mat"]
    model = SC.TwoSided(frame(spark, TEXTS))
    got = {r.id: r for r in SC.pseudo_nll(frame(spark, new, "l w r nll _len"), model, "id").collect()}
    tri, lr, lw, wr, le, ri, vocab = Counter(), Counter(), Counter(), Counter(), Counter(), Counter(), set()

    def centres(t):
        p = ["", *words(t), ""]
        return [tuple(p[i - 1:i + 2]) for i in range(1, len(p) - 1)]

    for t in TEXTS:
        for l, w, r in centres(t):
            tri[l, w, r] += 1
            lr[l, r] += 1
            lw[l, w] += 1
            wr[w, r] += 1
            le[l] += 1
            ri[r] += 1
            vocab.add(w)
    assert len(got) == len(new)
    for i, t in enumerate(new):
        want = 0.0
        for l, w, r in centres(t):
            q = ((lw[l, w] + 1) / (le[l] + len(vocab)) + (wr[w, r] + 1) / (ri[r] + len(vocab))) / 2
            want -= math.log((tri[l, w, r] + q) / (lr[l, r] + 1))
        assert abs(got[i].nll_sum - want) < 1e-9 and got[i].n_pred == len(words(t))
    ppl = {r.id: r.ppl for r in SC.text_perplexity(SC.pseudo_nll(frame(spark, new), model, "id"), "id").collect()}
    assert ppl[0] < ppl[1] and ppl[2] is None


def test_both_sides_know_more_than_one(spark):
    """A word that its right neighbour gives away costs less with both sides."""
    ref = frame(spark, ["red fox ran", "blue sky ran", "red car sang", "blue cat sang"] * 5)
    one = SC.corpus_perplexity(SC.bigram_nll(ref, SC.train_bigrams(ref), "id")).first().corpus_ppl
    two = SC.corpus_perplexity(SC.pseudo_nll(ref, SC.TwoSided(ref), "id")).first().corpus_ppl
    assert two < one


def test_empty_reference(spark):
    none = frame(spark, [])
    assert SC.pseudo_nll(frame(spark, ["a b"]), SC.TwoSided(none), "id").first().n_pred == 2
    idf = FE.train_idf(none).first().idf
    assert len(idf) == FE.BUCKETS and set(idf) == {0.0}


def test_tfidf_brute_force(spark):
    import hashlib
    buckets = 64
    def b(w):
        return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets
    df = Counter(x for t in TEXTS for x in {b(w) for w in words(t)})
    idf = {x: math.log((len(TEXTS) + 1) / (df[x] + 1)) for x in range(buckets)}
    row = FE.train_idf(frame(spark, TEXTS), buckets=buckets).first().idf
    assert all(abs(row[x] - idf[x]) < 1e-12 for x in range(buckets))

    def vec(t):
        return {x: n * idf[x] for x, n in Counter(b(w) for w in words(t)).items()}

    pairs = [(s, t) for s in TEXTS for t in TEXTS[:4]]
    rows = spark.createDataFrame([(i, s, t, row) for i, (s, t) in enumerate(pairs)], "i int, s string, t string, idf array<double>")
    for r in rows.select("i", FE.tfidf_similarity("s", "t", F.col("idf"), buckets).alias("sim")).collect():
        x, y = (vec(t) for t in pairs[r.i])
        size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        want = sum(x[k] * y.get(k, 0) for k in x) / size if size else 0.0
        assert abs((r.sim or 0.0) - want) < 1e-9, pairs[r.i]


def test_rare_words_count_more(spark):
    corpus = frame(spark, ["common word here"] * 50 + ["rare token"])
    idf = FE.train_idf(corpus).first().idf
    row = spark.createDataFrame([("common rare", "common thing", "rare thing", idf)], "a string, b string, c string, idf array<double>")
    r = row.select(FE.tfidf_similarity("a", "b", F.col("idf")).alias("common"), FE.tfidf_similarity("a", "c", F.col("idf")).alias("rare")).first()
    assert r.rare > r.common


def test_logistic_learns_and_repeats(spark):
    rows = [(i, f"plain text number n{i % 7} fine" + (" awful" if i % 3 == 0 else " nice"), int(i % 3 == 0)) for i in range(200)] + [(900, None, None), (901, "", 0)]
    df = spark.createDataFrame(rows, "id long, text string, toxic int").withColumn("rawPrediction", F.lit("x")).withColumn("features", F.lit("x"))
    verdicts = []
    for parts in (1, 5):
        d = df.repartition(parts)
        got = FE.score_logistic(d, FE.train_logistic(d, features=1 << 12), out_col="p")
        assert got.columns == [*df.columns, "p"]
        verdicts.append({r.id: r.p >= 0.5 for r in got.collect()})
    assert verdicts[0] == verdicts[1]
    assert all(verdicts[0][i] == bool(y) for i, _, y in rows[:200]) and not verdicts[0][900]


def test_logistic_beats_bayes_on_the_held_out(spark):
    from textguard.plans import catalog
    acc = {r.model: r for r in catalog.m1_held_out(spark, "/root/testdata/sf0.01").collect()}
    assert set(acc) == {"naive_bayes", "logistic"} and acc["logistic"].accuracy >= acc["naive_bayes"].accuracy
