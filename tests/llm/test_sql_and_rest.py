"""Operators with SQL against DuckDB; html, forest and pipeline on fixtures."""

import math
import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline as C
from textguard.llm import catalog, html_paths, license_scan, mixing, quality_risk, rp_forest

from llm_rows import ODD, SF, documents

TABLES = ["documents", "labels", "pages", "embeddings", "benchmark"]


def _norm(v):
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    assert _rows(catalog.queries()[name](spark, SF).toPandas()) == _rows(con.execute(catalog.oracle_sql()[name]).df())


# --- mixing ---------------------------------------------------------------------------

def water_fill(words, weights):
    """Targets by the rule: share, stop at twice the size, reshare the excess."""
    left, target, open_ = 1.5 * sum(words), [0.0] * len(words), set(range(len(words)))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if target[i] + left * weights[i] / total > 2 * words[i] + 1e-9]
        if not over:
            for i in open_:
                target[i] += left * weights[i] / total
            break
        for i in over:
            left -= 2 * words[i]
            target[i] = 2.0 * words[i]
            open_.discard(i)
    return target


def test_targets_and_taken(spark, sample):
    rows = mixing.report(sample).join(sample.select("doc_id", "source"), "doc_id").collect()
    per = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        per.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    names = sorted(per)
    want = water_fill([per[s][0] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, w in zip(names, want, strict=True):
        assert abs(per[s][1] - w) < 1e-6 * max(1, w)
        assert abs(per[s][2] - w) <= 0.05 * w + 20


def test_mix_odd_rows(spark, odd, empty):
    rows = mixing.report(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.report(odd.repartition(3)).collect()), key=repr)
    assert mixing.report(empty).count() == 0
    out = mixing.mixed_rows(odd, length="n_chars")
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.mixed_rows(empty).count() == 0


def test_schedule_is_even_everywhere(spark):
    goals = spark.createDataFrame([("a", 5000, 6000.0, 0, 1 << 31, 10, 1200), ("b", 9000, 6000.0, 1 << 31, 1 << 32, 10, 1200)],
                                  "source string, words long, target double, lo long, hi long, block long, slots long")
    s = [r.source for r in mixing.schedule(goals).orderBy("slot").collect()]
    assert all(abs(s[i:i + 20].count("a") - 10) <= 2 for i in range(0, len(s) - 20, 7))


def test_a_tiny_source_changes_no_other_block(spark, sample):
    tiny = documents(spark, [(900_000, "three word source")]).select("doc_id", "text", "lang", "n_chars").selectExpr("*", "'zz-tiny' AS source")
    before = mixing.mix(sample)[2].collect()
    after = {r.source: r for r in mixing.mix(sample.unionByName(tiny))[2].collect()}
    assert all(after[r.source].block == r.block for r in before) and after["zz-tiny"].block == 1
    assert sum(r.slots for r in {r.block: r for r in after.values()}.values()) <= sum(r.slots for r in {r.block: r for r in before}.values()) + 20
    taken = {r.doc_id: r.taken for r in mixing.report(sample.unionByName(tiny)).collect()}
    assert 0 < taken[900_000] <= 6


# --- quality --------------------------------------------------------------------------

def test_repeat_words_and_counts(spark):
    eight = "one two three four five six seven eight"
    texts = [f"{eight} x {eight}", f"{eight} {eight} {eight}", "a\nb\na\n \n a\n", "#*$ | <> &%", None, "x " * 9]
    got = {r.doc_id: r for r in quality_risk.statistics(documents(spark, texts)).collect()}

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        return len({j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)})

    for i, t in enumerate(texts):
        assert got[i].n_repeat_words == brute(t or "")
    assert got[2].n_dup_lines == 1 and got[3].n_symbols == 8 and got[4].n_words == 0 and got[4].base_failed


def test_binomial_tail(spark):
    from pyspark.sql import functions as F
    cases = [(10, 0), (100, 3), (5000, 40), (7, 7)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_risk.log_binomial_tail(F.col("n"), F.col("k"), 0.01).alias("t"))
    for r in df.collect():
        exact = sum(math.comb(r.n, j) * 0.01 ** j * 0.99 ** (r.n - j) for j in range(r.k + 1))
        assert abs(math.exp(r.t) - exact) < 1e-9


def test_cutoffs_keep_good_documents(spark):
    good, bad = " ".join(f"plain{i}" for i in range(40)), " ".join(f"noisy{i}***" for i in range(40))
    docs = documents(spark, [good + f" g{i}" for i in range(3000)] + [bad + f" b{i}" for i in range(200)])
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in range(3200)], "doc_id long, quality int, toxic int")
    rows = quality_risk.judge(docs, labels).collect()
    assert sum(not r.kept for r in rows if r.doc_id < 3000) <= 0.05 * 3000
    assert not any(r.kept for r in rows if r.doc_id >= 3000)


def test_an_id_is_one_trial(spark):
    good = " ".join(f"plain{i}" for i in range(40))
    docs = documents(spark, [good + f" g{i}" for i in range(700)])
    once = spark.createDataFrame([(i, 1, 0) for i in range(700)], "doc_id long, quality int, toxic int")
    stats = quality_risk.statistics(docs)
    want = sorted((r.stratum or "", r.n) for r in quality_risk.cutoffs(stats, once).collect())
    again = once.unionAll(once).unionAll(spark.createDataFrame([(0, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int"))
    got = sorted((r.stratum or "", r.n) for r in quality_risk.cutoffs(stats.unionAll(stats), again).collect())
    assert sum(n for _, n in want) == 700 and sum(n for _, n in got) == 699


def test_cutoffs_equal_the_sql_where_some_pass(spark):
    """At sf0.1 a stratum has enough labels, so cutoffs pass and reject rows."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rows = catalog.queries()["op7_quality_risk"](spark, sf).collect()
    assert any(not r.kept and not r.base_failed for r in rows)
    want = con.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({quality_risk.SQL})").fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_risk.judge(odd, labels).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.n_words < 20)
    assert quality_risk.judge(empty, labels).count() == 0
    assert quality_risk.judge(odd, labels.where("false")).count() == len(ODD)


# --- licenses -------------------------------------------------------------------------

def test_many_licenses_in_one_text_cost_their_number(spark):
    import time
    line = "some words before it Licensed under the Apache License, Version 2.0. and after\n"
    took = []
    for n in (2000, 2000, 4000):  # the first one warms up
        began = time.time()
        rows = license_scan.scan(documents(spark, [line * n])).collect()
        took.append(time.time() - began)
        assert [r.template for r in rows if r.template == "apache-2.0-line"] and rows[0].first_word >= 0
    assert took[2] < 3 * took[1] + 2


def test_licenses_found(spark, odd, empty):
    t = license_scan.TEMPLATES
    texts = ["intro words " + t["mit-grant"] + " and more words", "x " + t["apache-2.0-line"], "Released under   the MIT license!", "nothing", t["mit-grant"][:120],
             " ".join(w for i, w in enumerate(t["mit-grant"].split()) if i != 30)]
    got = {}
    for r in license_scan.scan(documents(spark, texts)).collect():
        got.setdefault(r.doc_id, {})[r.template] = r
    assert got[0]["mit-grant"].containment == 1.0 and got[0]["mit-grant"].first_word <= 2
    assert "apache-2.0-line" in got[1] and "mit-line" in got[2] and 3 not in got and 4 not in got
    assert 0.8 <= got[5]["mit-grant"].containment < 1
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0
    with pytest.raises(ValueError, match="below"):
        license_scan.scan(empty, templates={"short": "two words"}).count()


# --- html -----------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a b"), ("<script>", ""), ("<p title='", ""), ("<!-- unclosed", ""),
    ("a &lt; b &amp; c <b>bold</b>er", "a < b & c bolder"), ("<body><div class='ad'>Buy now, cheap, good.</div><p>Tiny.</p>", "Tiny."),
    ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><header>Site</header><main><h1>Head</h1><p>First  one,\n then.</p>"
     "<p>Second<br>line.</p></main><aside>More</aside><section id=comments><p>Nice, very nice, really.</p></section><footer>&copy; me</footer>", "Head First one, then. Second line."),
    ("<article><h1>A</h1><p>Body &eacute;&#233; text.</p><form>Name</form><div class='cookie-notice'>We use cookies, yes.</div></article>", "A Body éé text."),
    ("<div id=x><p>Long sentence, with marks, and more.</p><p>Another one, with marks, too.</p></div><div class=menu><ul><li><a>One</a><li><a>Two</a></ul></div>",
     "Long sentence, with marks, and more. Another one, with marks, too."),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html_paths.main_text(page) == text


def test_given_pages(spark):
    """The given pages keep their article between its tags."""
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_paths.extract(pages).collect()}
    for r in pages.collect():
        a = r.html.split("<article>", 1)[-1].split("</article>")[0]
        a = re.sub(r"<[^>]*$", "", a) if "</article>" not in r.html else a
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?(?:p|h1|article)>", " ", a))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


SAID = "A long sentence, with marks in it, that goes on for a while."


def told(n):
    return f"<p>{' '.join([SAID] * n)}</p>"


@pytest.mark.parametrize("page", [
    f"<article><h1>Head</h1>{told(6)}<div class=x1><p>More from us</p><p>Our app</p></div>{told(5)}</article>",
    f"<article><h1>Head</h1>{told(6)}<div><ul><li>One story<li>Another story</ul></div>{told(5)}</article><div class=y><p>Ours.</p></div>",
    f"<div id=top><p>Our site</p></div><div id=text><h1>Head</h1>{told(6)}{told(5)}</div><div id=links><p>About us</p><p>Imprint</p></div>",
])
def test_ratios_decide(page):
    """Unmarked boxes go, in an article and on pages without one."""
    assert html_paths.main_text(page) == " ".join(["Head", *[SAID] * 11])


@pytest.mark.parametrize("page", [
    f"<div class=content><div id=part1><h2>One</h2>{told(6)}</div><div id=part2><h2>Two</h2>{told(2)}</div></div><div id=links><p>About us</p></div>",
    f"<section id=intro><h2>One</h2>{told(6)}</section><section id=end><h2>Two</h2>{told(2)}</section>",
    f"<article class='post first'><h2>One</h2>{told(6)}</article><article class='post last'><h2>Two</h2>{told(2)}</article>",
    f"<div class=lead><h2>One</h2>{told(6)}</div><div class=body><h2>Two</h2>{told(2)}</div>",
])
def test_every_part_stays(page):
    assert html_paths.main_text(page) == " ".join(["One", *[SAID] * 6, "Two", *[SAID] * 2])


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div class='hidden-sidebar'>{told(5)}</div></body>", " ".join([SAID] * 5)),
    (f"<article>{told(3)}<svg viewBox='0 0 1 1'><path d='M0'>{told(4)}</article>", " ".join([SAID] * 7)),
    (f"<article>{told(3)}<div class=share-price>{told(3)}</div></article><div class=share><p>Share this story</p></div>", " ".join([SAID] * 6)),
    (f"<article>{told(3)}<ul>" + "".join(f"<li><a href=/{i}>{SAID}</a></li>" for i in range(3)) + "</ul></article>", " ".join([SAID] * 6)),
    (f"<article>{told(3)}<script>let a = 1;", " ".join([SAID] * 3)),
])
def test_nothing_of_the_article_is_lost(page, text):
    assert html_paths.main_text(page) == text


def test_ratios_remove_blocks_of_the_given_pages(spark):
    """Blocks that HTML does not mark off go by their ratio."""
    rows = html_paths.page_blocks(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("ratio is not null and not kept")
    assert rows.count() > 0


def test_deep_nesting_is_cheap():
    import time
    took = []
    for n in (2000, 8000):
        began = time.process_time()
        assert html_paths.main_text("<div>some words" * n + told(3)).endswith(SAID)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<p>" + "long, text. " * 30_000, "x")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_paths.extract(df).collect()) == [0, 0, 12 * 30_000 - 1]
    assert html_paths.extract(df.where("false")).count() == 0
    assert html_paths.page_blocks(df).where("kept").count() == 1


# --- nearest neighbours ---------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_nearest(rows, k=20):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    return {q: sorted(((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q))[:k] for q in ok if q % 20 == 0}


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 15, 40):
        rows = [(i, rng.normal(size=8).round(3).tolist(), 0) for i in range(n)]
        got = {}
        for r in rp_forest.nearest(vectors(spark, rows)).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
        want = {q: w for q, w in brute_nearest(rows).items() if w}
        assert set(got) == set(want)
        for q, w in want.items():
            assert [got[q][i + 1][1] for i in range(len(w))] == [x[1] for x in w]
            assert np.allclose([got[q][i + 1][0] for i in range(len(w))], [x[0] for x in w], atol=1e-12)


def test_odd_vectors_and_ties(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(60)] + [(60, None, 0), (80, [], 0), (100, [0.0, 0.0], 0), (120, [float("nan"), 1.0], 0),
                                                      (140, [None, 1.0], 0), (160, [1.0], 0), (None, [1.0, 1.0], 0), (20, [1.0, 2.0], 0)]
    got = {}
    for r in rp_forest.nearest(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    for q, w in got.items():
        assert [x[1] for x in sorted(w)] == [i for i in range(22) if i != q][:20] and {x[2] for x in w} == {5.0}


def test_queries_are_dealt_in_blocks(spark, monkeypatch):
    """Blocks of vectors and of queries change no result."""
    rng = np.random.default_rng(4)
    df = vectors(spark, [(20 * i, rng.normal(size=8).round(3).tolist(), 0) for i in range(300)])
    result = lambda: sorted(map(tuple, rp_forest.nearest(df, leaves=4, visits=24).collect()))
    want = result()
    monkeypatch.setattr(rp_forest, "BLOCK", 40)
    assert "query_block" in rp_forest.nearest(df, leaves=4)._jdf.queryExecution().toString()
    assert rp_forest.n_blocks(300 * 24 / (12 * 4)) > 1 and result() == want


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    got = {}
    for r in rp_forest.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        true = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(true & found), total + 20
    assert len(got) == (ids % 20 == 0).sum() and hit / total >= 0.9


# --- pipeline -------------------------------------------------------------------------

def test_stages_on_the_sample(spark, sample):
    docs, counts = sample, []
    import tempfile
    folder = tempfile.mkdtemp(prefix="run-")
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == sample.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        counts.append(docs.count())
    assert counts[0] <= sample.count() and counts[1] < counts[0] and counts[2] == counts[1]
    last = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 2048 for r in last)
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "mix", "pack"]


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for _name, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns
        assert C.STAGES[-1][1](spark, docs, SF).count() >= 0
