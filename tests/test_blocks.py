"""Blocks of texts: what a model is asked goes once per block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.operators import blocks as B
from textguard.operators import scoring as SC


def test_a_run_is_asked_for_once_per_block(spark):
    df = spark.range(600, numPartitions=2).select("id", F.lit("red fox ran red fox").alias("t"))
    blocks = SC._blocks(df, "id", ["t"], SC.DEFAULT_TOKEN_PATTERN)
    assert blocks.count() == 2 and all(sorted(r.words) == ["fox", "ran", "red"] for r in blocks.collect())
    model = SC.TwoSided(df, "t")
    assert model.words == 3
    names = sum(len(r.names) // 8 for r in model.counts.rows.collect())
    assert names == 2 * (5 + 5 + 5 + 4 + 4)  # 600 texts, 5 centres each: distinct runs alone are moved
    got = SC.pseudo_nll(df, model, "id", "t")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 600 and got.select("nll_sum", "n_pred", "n_tokens").distinct().count() == 1


def test_marks_nulls_and_repeated_keys(spark):
    rows = [(1, "a b", "A  b"), (1, "c", "a"), (None, "b b", "b b"), (3, None, ""), (4, "", None), (5, "x y", "y x y")]
    df = spark.createDataFrame(rows, "k int, s string, t string").coalesce(1)
    cells = [bytes(c) for c in SC._blocks(df, "k", ["s", "t"], SC.DEFAULT_TOKEN_PATTERN).first().cells]
    (n0, _), (n1, codes) = B._texts(cells, 0), B._texts(cells, 1)
    assert n0.tolist() == [2, 1, 2, -1, 0, 2] and n1.tolist() == [2, 1, 2, 0, -1, 3] and len(codes) == 8
    got = {r.k: (r.n_pred, r.n_tokens) for r in SC.bigram_nll(df, SC.train_bigrams(df, "s"), "k", "t").collect()}
    assert got == {1: (1, 2), None: (1, 2), 3: (0, 0), 4: (0, None), 5: (2, 3)}


@pytest.mark.parametrize("slices", [16, 1024])
def test_places_of_distinct_runs(slices):
    words = np.random.default_rng(0).integers(0, 300, 5000)
    h = B.hash_words([str(i) for i in range(300)])[:, words]
    name, at, n, place = B._distinct(h, slices)
    assert len(name) == len(set(words.tolist())) and n.sum() == 5000 and at[-1] == len(name)
    assert (name[place] == h[0]).all() and (n[place] == np.bincount(words)[words]).all()


def test_a_word_is_hashed_once_per_batch(spark):
    """TF-IDF vectors come from one pass over both texts; nulls and empty texts as before."""
    from textguard.operators import features as FE
    rows = [("a a b", "a c"), ("a b", "b a"), ("", "a"), (None, "a"), ("a", None), (None, ""), (None, None), ("a", "?")]
    df = spark.createDataFrame(rows, "s string, t string").coalesce(1)
    idf = F.lit([1.0] * FE.BUCKETS)
    out = df.select(FE.tfidf_similarity("s", "t", idf).alias("o"))
    assert "md5" not in out._jdf.queryExecution().executedPlan().toString()
    got = [r.o for r in out.collect()]
    assert got[:3] == pytest.approx([2 / 10 ** 0.5, 1.0, 0.0]) and got[3:] == [0.0] * 5
    n = df.select(FE.bucket_counts(SC.tokens("s"), SC.tokens("t")).alias("n")).collect()
    assert sorted((e.x, e.y) for e in n[0].n) == [(0, 1), (1, 0), (2, 1)] and n[6].n == []


def test_pivot_flow_stores_unchanged_texts_once(spark):
    from textguard.plans.flows import pivot_with_metrics
    df = spark.createDataFrame([(1, "keep me", None), (2, "edit me", None), (2, "edit me", None), (None, "edit no key", None), (4, None, 1)], "k int, t string, y int")
    scorer = lambda d, text, out: d.withColumn(out, F.when(F.col("t").startswith("edit"), 0.9).otherwise(0.1))
    for cache in (None, spark.createDataFrame([], "key string, value string")):
        rows, m, _ = pivot_with_metrics(df, "k", "t", scorer, lambda: lambda xs: [x.upper() for x in xs], None, None, label="y", forward_cache=cache)
        got = [(r.k, r.generated) for r in rows.collect()]
        edits = [(2, "EDIT ME")] * (4 if cache is not None else 2)  # a repeated key meets its edits as it did
        assert sorted(got, key=str) == sorted([(1, "keep me"), *edits, (None, "edit no key" if cache is not None else "EDIT NO KEY"), (4, None)], key=str)
        assert m.first().n_rows == len(got)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "pivot-rows" not in plan and "_changed" in plan


def test_cosines_of_blocks(spark):
    rows = [(1, "a a b", "a b b"), (2, "x", ""), (3, "", ""), (4, "The cat", "the CAT"), (None, None, "a"), (6, "a b", "c d"), (6, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, t string").coalesce(1)
    want = [r.o for r in df.select(SC.text_similarity("s", "t").alias("o")).collect()]
    got = B.cosines(SC._blocks(df, "k", ["s", "t"], SC.DEFAULT_TOKEN_PATTERN)).collect()
    assert [r.k for r in got] == [r[0] for r in rows] and [r.cos for r in got] == pytest.approx(want)


def test_words_are_split_and_summed_in_the_blocks(spark):
    """no word leaves the JVM by itself, and a score takes one row per text and its rewrite."""
    texts = ["Ab  c,Ab", None, "", "7", "é\u212Aa\u0130z", "x\ny", "", "tail", "a-b"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)] + [(None, "c c q", "C! c"), (0, "ab", "c")], "k int, s string, t string").coalesce(1)
    words = [r.w for r in df.select(SC.tokens("s").alias("w")).collect()]
    import pyarrow as pa
    lower = [r.s for r in df.select(F.lower("s").alias("s")).collect()]
    assert B.letter_words(pa.array(lower)).to_pylist() == words
    assert B.letter_words(pa.array(["skipped", *lower]).slice(1)).to_pylist() == words
    assert B.letter_words(pa.array([None, None], pa.string())).to_pylist() == [None, None] and len(B.letter_words(pa.array([], pa.string()))) == 0
    weights = spark.createDataFrame([("ab", 1.0), ("c", -0.25), ("a", 0.5)], "word string, weight double")
    parts = SC._nb_parts(df, weights, "k", ["s", "t"], SC.DEFAULT_TOKEN_PATTERN, by_text=True)
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in parts.collect())
    assert got == [(-1, 1, -0.5), (-1, 2, -0.5), (0, 1, 1.0), (0, 2, -0.25), (0, 3, 1.75), (8, 3, 0.5)]


def test_word_counts_of_a_model_are_taken_per_batch(spark):
    """the trainer explodes no text; labels other than 0 and 1 count for the vocabulary alone."""
    rows = [("A a b", 1), ("a c", 0), ("d", 2), (None, 1), ("b", None), ("", 0)]
    df = spark.createDataFrame(rows, "t string, y int").coalesce(1)
    w, prior = SC.train_naive_bayes(df, "t", "y", store=False)
    assert "Generate" not in w._jdf.queryExecution().executedPlan().toString()
    other, prior2 = SC.train_naive_bayes(df, "t", "y", "[a-z]{1,}", store=False)
    assert prior == prior2 and {r.word: r.weight for r in w.collect()} == pytest.approx({r.word: r.weight for r in other.collect()})


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_runs_of_two_sides_meet_in_turns(spark):
    """a row's text and rewrite name a run once, and a turn's names leave the disk before the next one."""
    words = np.random.default_rng(0).integers(0, 3000, (400, 500))
    texts = [" ".join("w" + "abcdefghij"[n % 10] * (n // 10 % 7 + 1) + chr(97 + n // 120) for n in row) for row in words.tolist()]
    df = spark.createDataFrame([(i, t, t.replace("waaa", "x", 3) if i % 9 == 0 else t + " ") for i, t in enumerate(texts)], "id int, s string, t string").repartition(2).cache()
    df.count()
    before = set(_shuffle_files(spark))
    got = {r.id: r for r in SC.pseudo_nll(df, SC.TwoSided(df, "s"), "id", "t").collect()}
    left = sum(n for name, n in _shuffle_files(spark).items() if name not in before)
    assert left < 8 * words.size  # one 64-bit name per word; there are three such kinds of runs in either text
    assert len(got) == 400 and all(r.n_pred == r.n_tokens == 500 for r in got.values())
    want = {r.id: r.nll_sum for r in SC.pseudo_nll(df, SC.TwoSided(df, "s", store=True), "id", "t").collect()}
    assert {i: r.nll_sum for i, r in got.items()} == pytest.approx(want)


def test_turns_keep_nulls_repeats_and_changed_texts(spark):
    """the same sums whether the corpus is a column of the frame, another frame or a stored table."""
    rows = [(1, "a b c a", "A  b c a"), (1, "c", "a b"), (None, "b b", "b b"), (3, None, ""), (3, None, None), (4, "", None), (5, "x y", "y x y"), (6, "a b c", None), (7, "né 5", "a")]
    df = spark.createDataFrame(rows, "k int, s string, t string").repartition(2).cache()
    reference = df.select(F.col("s").alias("text"))
    models = [SC.TwoSided(df, "s"), SC.TwoSided(reference), SC.TwoSided(reference, store=True)]
    got = [sorted(map(tuple, SC.pseudo_nll(df, m, "k", "t").collect()), key=str) for m in models]
    assert [r[0] for r in got[0]] == [r[0] for r in got[1]] == [r[0] for r in got[2]] and len(got[0]) == 7
    for one, two, three in zip(*got, strict=True):
        assert one[2:] == two[2:] == three[2:] and one[1] == pytest.approx(two[1]) == pytest.approx(three[1])
    n = {r[0]: r[2:] for r in got[0]}
    assert n[1] == (6, 4) and n[3] == (0, 0) and n[4] == (0, None) and n[6] == (0, None)
    none = spark.createDataFrame([], "k int, s string, t string")
    assert SC.pseudo_nll(none, SC.TwoSided(none, "s"), "k", "t").count() == 0


def test_hashes_of_words_of_any_length():
    import pyarrow as pa
    words = ["", "a", "ab", "abcdefgh", "abcdefghi", "a" * 16, "a" * 17, "a" * 64, "a" * 65, "a" * 300, "é", "\0", "\0\0"]
    h = B._hashes(pa.array(words))
    assert h.shape == (2, len(words) + 1) and all(len(set(x)) == len(x) for x in h.tolist()) and (h[:, -1:] == B._EDGE).all()
    assert (B._hashes(pa.array(["q", *words]).slice(1)) == h).all()
    assert (B._hashes(pa.array(words[::-1]))[:, :-1] == h[:, :-1][:, ::-1]).all()
    assert (B._hashes(pa.array([], pa.string())) == B._EDGE).all()


def test_names_and_counts_come_back_from_their_cells():
    h = np.random.default_rng(1).integers(0, 1 << 63, (2, 50)).astype(np.uint64)
    codes = np.random.default_rng(2).integers(0, 49, 3000).astype(np.int32)
    size = np.array([1000, 0, 2000])
    for run in [k for turn in B.centre_turns(codes, size, 49) for k in turn]:
        name, begins, n = B._named(h, run, 2000, 16)
        assert n.sum() == 2000 and begins[0] == 0 and begins[-1] == len(name)
        place = B._run_places(h, run, 16)
        assert (np.bincount(place[:2000], minlength=len(name)) == n).all() and len(place) == len(run[0])
        assert (name[place] == B._lane(h, run, 0)).all()
        for a, b in zip(begins, begins[1:]):
            assert (B._unpack_names(B._pack_names(name[a:b])) == name[a:b]).all()
            assert (B._unpack_planes(B._pack_planes(n[a:b]), "<u4") == n[a:b]).all()
