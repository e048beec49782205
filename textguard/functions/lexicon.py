"""Rule tables: ordered lexicons and regex rules, compiled to column
expressions.

A rule table is a small DataFrame (or list) ``priority int, kind string
('literal' | 'regex'), pattern string, replacement string, grp string``.
It is collected to the driver (rules are the user's list, not data, and stay
driver-side at any length) and compiled into one chained expression.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import python_repl_to_java
from .text import _c, _let, apply_rules, cleanse, java_pattern, remove_literals, remove_patterns

RULES_SCHEMA = "priority int, kind string, pattern string, replacement string, grp string"


@dataclass(frozen=True)
class Rule:
    priority: int
    kind: str  # 'literal' or 'regex'
    pattern: str
    replacement: str = ""
    grp: str = ""


def rules_from_frame(df: DataFrame) -> list[Rule]:
    rows = df.orderBy("priority").collect()
    return [Rule(int(r["priority"]), r["kind"], r["pattern"], r["replacement"] or "",
                 (r["grp"] if "grp" in r else "") or "") for r in rows]


def rules_to_frame(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.priority, r.kind, r.pattern, r.replacement, r.grp) for r in rules],
                                 RULES_SCHEMA)


def literal_rules(terms: list[str], grp: str = "terms", start: int = 0) -> list[Rule]:
    return [Rule(start + i, "literal", t, "", grp) for i, t in enumerate(terms)]


def compile_rules(c, rules: list[Rule]) -> Column:
    """Apply rules in priority order; consecutive literal deletions are
    chained, regexes substitute their replacement."""
    col = c
    for r in sorted(rules, key=lambda r: r.priority):
        if r.kind == "literal" and not r.replacement:
            col = remove_literals(col, [r.pattern])
        elif r.kind == "literal":
            from .regex import escape_literal
            col = apply_rules(col, [(escape_literal(r.pattern), r.replacement.replace("\\", "\\\\"))])
        else:
            col = apply_rules(col, [(r.pattern, r.replacement)])
    return col


def cleanse_with(c, rules: list[Rule]) -> Column:
    """C4 with a rule table: literal deletions, then regex deletions, guarded."""
    terms = [r.pattern for r in sorted(rules, key=lambda r: r.priority) if r.kind == "literal"]
    pats = [r.pattern for r in sorted(rules, key=lambda r: r.priority) if r.kind == "regex"]
    return cleanse(c, terms, pats)


def remove_with(c, rules: list[Rule]) -> Column:
    terms = [r.pattern for r in rules if r.kind == "literal"]
    pats = [r.pattern for r in rules if r.kind == "regex"]
    return remove_patterns(remove_literals(c, terms), pats)


def _scripts(term: str) -> set[str]:
    out = set()
    for ch in term:
        if ch.isalpha():
            name = unicodedata.name(ch, "")
            out.add(name.split(" ")[0] if name else "?")
    return out


def lint(terms: list[str]) -> list[dict]:
    """Report lexicon problems: exact duplicates, terms that contain an
    earlier term (mostly unreachable: the earlier deletion runs first) and
    terms mixing scripts (a look-alike letter never matches real text)."""
    issues = []
    seen: dict[str, int] = {}
    for i, t in enumerate(terms):
        low = t.lower()
        if low in seen:
            issues.append({"index": i, "term": t, "issue": "duplicate", "other": seen[low]})
            continue
        for j, e in enumerate(terms[:i]):
            if e and e.lower() in low:
                issues.append({"index": i, "term": t, "issue": "shadowed", "other": j})
                break
        if len(_scripts(t)) > 1:
            issues.append({"index": i, "term": t, "issue": "mixed_script", "other": None})
        seen[low] = i
    return issues


def rule_hits(c, rules: list[tuple[str, str]]) -> Column:
    """Per row and rule (python regex, replacement): does it match the text
    alone, and does it match what the rules before it have left? An
    ``array<struct<alone boolean, chain boolean>>`` in rule order. Where the
    rules before have changed nothing, both are one search."""
    src = _c(c)
    steps = [(java_pattern(p), python_repl_to_java(r)) for p, r in rules]

    def go(text: Column, i: int, hits: list[Column]) -> Column:
        if i == len(steps):
            return F.array(*hits).cast("array<struct<alone:boolean,chain:boolean>>")
        pattern, replacement = steps[i]

        def step(chain: Column) -> Column:
            alone = F.when(text == src, chain).otherwise(F.coalesce(src.rlike(pattern), F.lit(False)))
            left = F.when(chain, F.regexp_replace(text, pattern, replacement)).otherwise(text)
            return _let(left, lambda t: go(t, i + 1, [*hits, F.struct(alone.alias("alone"), chain.alias("chain"))]))
        return _let(F.coalesce(text.rlike(pattern), F.lit(False)), step)
    return go(src, 0, [])


def rule_report(df: DataFrame, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Which rules fire: per rule (``rule`` from 0, ``pattern``) the rows it
    matches alone (``n_alone``), the rows it matches in the chain (``n_chain``),
    those an earlier rule has taken from it (``n_shadowed``) and those an earlier
    rule has made (``n_made``). Rules that never fire are rows too."""
    hits = df.select(F.posexplode(rule_hits(text, rules)).alias("rule", "x"))
    alone, chain = F.col("x")["alone"], F.col("x")["chain"]
    counts = hits.groupBy("rule").agg(F.count_if(alone).alias("n_alone"), F.count_if(chain).alias("n_chain"),
                                      F.count_if(alone & ~chain).alias("n_shadowed"), F.count_if(chain & ~alone).alias("n_made"))
    names = df.sparkSession.createDataFrame([(i, p) for i, (p, _) in enumerate(rules)], "rule int, pattern string")
    out = names.join(F.broadcast(counts), "rule", "left")  # one row a rule
    return out.select("rule", "pattern", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_alone", "n_chain", "n_shadowed", "n_made")])
