"""Source divergence audit: how far the term frequencies of the sources of a
language are apart, by hash-consed segment trees.

Method: each (language, source) group is a segment tree over term ids whose
leaves are the group's counts. Nodes are hash-consed: subtrees of identical
counts are one node, whatever group and place they come from (the long tail of
rare terms collapses to a few nodes). Two groups are compared by walking their
trees at once from the roots; equal pairs of nodes are merged with their
multiplicity on each level, so each is followed and priced once. At the leaves
a pair of counts (c, d) is priced by its share of the chi-square divergence,
f = floor((p - q)^2 / q) with p = 1 + floor(SCALE * (c + 1) / (N + V)) of the
one group and q of the other; both directions come from one walk.

Terms are runs of letters (ASCII, A-Z in lower case) and non-ASCII characters.
A language keeps the V terms that stand in at least ``MIN_DOCS`` of its
documents; N is a group's occurrences of kept terms. All arithmetic is exact.

How it is dealt out: terms are counted per group inside each task before the
shuffle, in dictionaries of a bounded size, and summed on (lang, source, term),
so neither a hot source nor a frequent term is one task's work. The terms of a
language are dealt by hash into blocks of about ``BLOCK`` terms, each with
trees of its own, and the sources of a language into runs of ``SOURCES``: a
task holds one block of terms for two runs of sources, however large the
vocabulary or the number of sources. Its result is a sum per pair of sources.
The largest terms of a group are cut to the report's ranks before the shuffle.

Edge cases: null text, language and source are ''; a group without terms is
compared like any other (all counts 0); a language without kept terms has value
0 for each pair and no term rows; a language of one source has no pairs; rows
that share a doc_id are documents of their own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget_words, stored

MIN_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000
BLOCK, SOURCES = 4096, 32
#: Entries of a task's dictionaries, and bytes of a text counted at once.
ENTRIES, SLICE = 400_000, 4 << 20

#: Byte table: letters to lower case, bytes of non-ASCII characters as they are, the rest to a space.
_TERM = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded size."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + SLICE)
        part = text[at:end].translate(_TERM)
        if end < n:  # up to the last border of a term; a single term of that length is taken whole
            cut = part.rfind(b" ") + 1
            while not cut and end < n:
                end = min(n, end + SLICE)
                part = text[at:end].translate(_TERM)
                cut = part.rfind(b" ") + 1 if end < n else len(part)
            end = at + cut
            part = part[:cut]
        yield part.split()
        at = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group,
    and the group's documents that hold it."""

    def flush(n: dict, d: dict) -> Iterator[pa.RecordBatch]:
        for (la, so), counts in n.items():
            terms = list(counts)
            for lo in range(0, len(terms), 50_000):
                part = terms[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([la] * len(part), pa.string()), pa.array([so] * len(part), pa.string()),
                    pa.array(part, pa.binary()), pa.array([counts[t] for t in part], pa.int64()),
                    pa.array([d[la, so][t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]):
        forget_words()
        n: dict[tuple, Counter] = {}
        d: dict[tuple, Counter] = {}
        size = 0
        for b in batches:
            for t, la, so in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts = n.setdefault((la, so), Counter())
                had, seen = len(counts), set()
                for words in _words(t.as_py()):
                    counts.update(words)
                    seen.update(words)
                d.setdefault((la, so), Counter()).update(seen)
                size += len(counts) - had
                if size >= ENTRIES:
                    yield from flush(n, d)
                    n, d, size = {}, {}, 0
        yield from flush(n, d)

    whole = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), *_group(lang, source))
    rows = whole.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return (rows.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _group(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")]


def _share(count: str, total: str, terms: str) -> Column:
    """p of a count, in whole numbers of any size."""
    big = f"cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))"
    return F.expr(f"1 + ({big}) div cast({total} + {terms} as decimal(19,0))")


class Audit:
    """The stored tables of one audit.

    ``kept``: (lang, source, term, n, total) of the kept terms of each group,
    ``total`` being the language's occurrences; ``groups``: (lang, source, no,
    n_group, n_lang, terms, blocks, run, runs), no numbering the sources of a
    language from 0, in runs of ``sources``."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
                 block: int = BLOCK, sources: int = SOURCES):
        self.sources = sources
        counts = stored(term_counts(docs, text, lang, source), "term-counts").df
        term = W.partitionBy("lang", "term")  # a row for each source that has the term
        known = (counts.withColumn("total", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term))
                 .withColumn("first", F.min("source").over(term)).where(F.col("in_docs") >= min_docs))
        self.kept = stored(known.select("lang", "source", "term", "n", "total", (F.col("first") == F.col("source")).alias("first")), "kept-terms").df
        there = docs.select(*_group(lang, source)).distinct()
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count_if("first").alias("firsts"))
        per = there.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), F.coalesce("firsts", F.lit(0)).alias("firsts"))
        of_lang = W.partitionBy("lang")  # a row for each source
        per = per.select("lang", "source", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("no"), "n_group",
                         F.sum("n_group").over(of_lang).alias("n_lang"), F.sum("firsts").over(of_lang).alias("terms"), F.count("*").over(of_lang).alias("all"))
        runs = F.sequence(F.lit(0), F.floor((F.col("all") - 1) / sources).cast("int"))
        blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("int")
        self.groups = stored(per.withColumn("run", F.floor(F.col("no") / sources).cast("int")).withColumn("runs", runs).withColumn("blocks", blocks).drop("all"), "term-groups")

    def term_rows(self, ranks: int = RANKS) -> DataFrame:
        """Each group's terms that are more frequent than in its language."""
        rows = self.kept.join(self.groups.small(), ["lang", "source"])
        rows = rows.withColumn("p", _share("n", "n_group", "terms")).withColumn("q", _share("total", "n_lang", "terms"))
        rows = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
        return rows.withColumn("rank", F.row_number().over(_ranks())).where(F.col("rank") <= ranks)

    def pair_rows(self) -> DataFrame:
        """Each group against each other source of its language."""
        per = self.groups.small()
        placed = (self.kept.join(per.select("lang", "source", "no", "run", "runs", "blocks"), ["lang", "source"])
                  .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")))
        # frequent terms first, so that the long tail meets in the same subtrees
        inside = W.partitionBy("lang", "block").orderBy(F.col("total").desc(), "term")
        placed = stored(placed.select("lang", "block", "no", "run", "runs", (F.dense_rank().over(inside) - 1).alias("idx"), "n"), "term-cells").df
        size = placed.groupBy("lang", "block").agg((F.max("idx") + 1).cast("long").alias("n"))
        # a head for each group and block, also where the group has none of its terms: idx -1, N and V
        heads = size.join(per.select("lang", "no", "run", "runs", "n_group", "terms"), "lang").select(
            "lang", "block", "no", "run", "runs", F.lit(-1).alias("idx"), "n", "n_group", "terms")
        nothing = F.lit(None).cast("long")
        cells = heads.unionAll(placed.select("lang", "block", "no", "run", "runs", "idx", "n", nothing, nothing))
        cells = cells.withColumn("other", F.explode("runs")).select(
            "lang", "block", F.least("run", "other").alias("r0"), F.greatest("run", "other").alias("r1"), "no", "idx", "n", "n_group", "terms")
        sums = cells.groupBy("lang", "block", "r0", "r1").applyInArrow(_priced(self.sources), "lang string, a int, b int, value long")
        none = self.groups.df.where("terms = 0")  # languages without kept terms
        zero = none.select("lang", F.col("no").alias("a")).join(none.select("lang", F.col("no").alias("b")), "lang").where("a <> b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
        total = sums.unionAll(zero).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        name = self.groups.small()
        rows = (total.join(name.select("lang", F.col("no").alias("a"), "source"), ["lang", "a"])
                .join(name.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
                .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
        return rows.withColumn("rank", F.row_number().over(_ranks()))


def _ranks():
    return W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")


def consed_trees(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Segment trees of the rows of ``counts`` (groups x a power of two of
    leaves; values are leaf numbers). Returns the root of each row and, from
    the root's level down, the (left, right) children of each node."""
    nodes, levels = counts.astype(np.int64), []
    while nodes.shape[1] > 1:
        n = int(nodes.max()) + 1
        key, nodes = np.unique(nodes[:, 0::2] * n + nodes[:, 1::2], return_inverse=True)
        nodes = nodes.reshape(len(counts), -1)
        levels.append((key // n, key % n))
    return nodes[:, 0], levels[::-1]


def walk_pairs(root: np.ndarray, levels: list, s: int, others: np.ndarray):
    """Walks the tree of row ``s`` with those of ``others`` at once: (other,
    leaf of s, leaf of other, multiplicity), each pair of nodes followed once."""
    t, a, b, m = others.astype(np.int64), np.full(len(others), root[s]), root[others], np.ones(len(others), np.int64)
    rows = int(others.max()) + 1
    for left, right in levels:
        a, b = np.concatenate((left[a], right[a])), np.concatenate((left[b], right[b]))
        t, m = np.concatenate((t, t)), np.concatenate((m, m))
        n = int(max(a.max(), b.max())) + 1
        key, at = np.unique((a * n + b) * rows + t, return_inverse=True)
        m = np.bincount(at, m).astype(np.int64)
        t, a, b = key % rows, key // rows // n, key // rows % n
    return t, a, b, m


def _shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count, in whole numbers of any size."""
    return np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in counts], np.int64)


def _priced(run: int) -> Callable[[pa.Table], pa.Table]:
    """Sums of f over one block of terms, for the pairs of two runs of ``run`` sources."""

    def price(table: pa.Table) -> pa.Table:
        no, idx, n = (table.column(c).to_numpy() for c in ("no", "idx", "n"))
        head = np.flatnonzero(idx < 0)
        names, first = np.unique(no[head], return_index=True)
        head = head[first]
        size, terms = int(n[head[0]]), table.column("terms")[int(head[0])].as_py()
        total = [table.column("n_group")[int(i)].as_py() for i in head]
        cell = np.flatnonzero(idx >= 0)
        values, leaf = np.unique(n[cell], return_inverse=True)  # leaf 0: count 0, then the counts, then no term at all
        width = 1 << max(0, size - 1).bit_length()
        leaves = np.zeros((len(names), width), np.int64)
        leaves[:, size:] = len(values) + 1
        leaves[np.searchsorted(names, no[cell]), idx[cell]] = leaf + 1
        root, levels = consed_trees(leaves)
        values = np.concatenate(([0], values))
        share = [np.append(_shares(values, x, terms), 1) for x in total]  # beyond the terms p = q
        r0, r1 = table.column("r0")[0].as_py(), table.column("r1")[0].as_py()
        out: list[tuple[int, int, int]] = []
        for s in range(len(names)):
            # pairs within a run are met where both runs are the same
            others = np.array([t for t in range(s + 1, len(names)) if r0 == r1 or names[t] // run != names[s] // run], np.int64)
            if not len(others):
                continue
            t, a, b, m = walk_pairs(root, levels, s, others)
            p, q = share[s][a], np.stack(share)[t, b]
            d = (p - q) ** 2
            sums = np.zeros((2, len(names)), np.int64)
            np.add.at(sums[0], t, d // q * m)
            np.add.at(sums[1], t, d // p * m)
            for x in others.tolist():
                out += [(int(names[s]), int(names[x]), int(sums[0, x])), (int(names[x]), int(names[s]), int(sums[1, x]))]
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array([o[0] for o in out], pa.int32()),
                         "b": pa.array([o[1] for o in out], pa.int32()), "value": pa.array([o[2] for o in out], pa.int64())})

    return price


def report(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups."""
    audit = Audit(docs, text, lang, source)
    return audit.pair_rows().unionAll(audit.term_rows(ranks))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM tok GROUP BY ALL),
v AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
k AS (SELECT lang, source, term, CAST(c.n AS HUGEINT) AS n, total FROM c JOIN v USING (lang, term)),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM k WHERE k.lang = x.lang AND k.source = x.source), 0) AS n_group,
             coalesce((SELECT sum(n) FROM k WHERE k.lang = x.lang), 0) AS n_lang, (SELECT count(*) FROM v WHERE v.lang = x.lang) AS terms
      FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, v.term, 1 + ({SCALE} * (coalesce(k.n, 0) + 1)) // (g.n_group + g.terms) AS p, coalesce(k.n, 0) AS n,
             1 + ({SCALE} * (v.total + 1)) // (g.n_lang + g.terms) AS q
      FROM g JOIN v ON v.lang = g.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM p x JOIN p y ON x.term = y.term
                 WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
rows AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
         UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {RANKS}"""
