import numpy as np

from textguard.llm import toxicity as T

from llm_rows import documents


def grammar():
    return T.Grammar({"idiot": 4.0, "scum": 3.0})


def test_contexts():
    g = grammar()
    m = lambda t: [(x[0], x[1], x[2]) for x in g.matches(t)[0]]
    assert m("what an idiot.") == [(T.INSULT, "idiot", T.PLAIN)]
    assert m("you idiots there.") == [(T.INSULT, "idiot", T.AIMED)]
    assert m("an idiot, you are") == [(T.INSULT, "idiot", T.AIMED)]
    assert m("that is not an idiot") == [(T.INSULT, "idiot", T.DENIED)]
    assert m("never. what scum") == [(T.INSULT, "scum", T.PLAIN)]  # the clause end closes the negation
    assert m("he wrote of scum") [0][2] == T.REPORTED_AS
    assert m("“scum” is a word")[0][2] == T.REPORTED_AS
    assert m("will kill") == [(T.THREATEN, "", T.PLAIN)]
    assert m("kill the lights") == []
    assert m("I will hurt you")[0][2] == T.AIMED
    assert m("") == [] and m("...") == [] and m("a clean text") == []


def test_features_count_clauses():
    f = grammar().features("you idiot! fine. fine. scum.")
    assert f[T.AIMED] > 0 and f[T.PLAIN] > 0 and 0 < f[7] < 1
    assert grammar().features(None) == [0.0] * T.N_FEATURES


def test_learns_planted_words(spark):
    words = ["river stone walks home", "green tables stand there", "many small birds sing", "cold rain falls now"]
    texts = [f"{words[i % 4]} number{i} and {'you zorgify creature' if i % 4 == 0 else 'quiet people'} again" for i in range(400)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = T.learn(docs, labels)
    assert any(t.startswith("zorg") for t in model.lexicon)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert T.drop_toxic(docs, model).count() == 300
    kinds = {(r.kind, r.context) for r in T.clause_matches(docs, model).collect()}
    assert ("insult", "targeted") in kinds


def test_weights_rank_nearly_parted_labels():
    """Features that all but part the labels: whole Newton steps swung to weights that ranked label 1 last."""
    r = np.random.default_rng(0)
    y = (r.random(400) < 0.1).astype(float)
    marked = (y == 1) | (r.random(400) < 0.01)
    x = np.zeros((400, 4))
    x[marked] = r.uniform(2, 4, (marked.sum(), 4))
    w = T.fit_weights(x, y)
    z = x @ w[:-1] + w[-1]
    assert (z[y == 1][:, None] > z[y == 0][None, :]).mean() > 0.99


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = T.score(docs, T.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.97
    assert sum(r.predicted and r.toxic for r in rows) / sum(r.toxic for r in rows) >= 0.85


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (4, None, 0), (None, 0, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    model = T.learn(odd, labels)
    rows = T.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score(empty, model).count() == 0
    none = T.learn(empty, labels.where("false"))
    assert none.weights is None
    assert {r.score for r in T.score(odd, none).collect()} == {0.0}
    kept = T.drop_toxic(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()
