"""Rules as nullable Columns, and as SQL of the dialect that the oracle speaks.

A rule that does not fire is null, which differs from a vote of 0. Patterns are searched for
anywhere, whatever the case; a dot crosses every character but a line feed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.catalog import Rule

JAVA = "(?idu)"


def found(text: Column, pattern: str) -> Column:
    return text.rlike(JAVA + pattern)


def vote(rule: Rule, text: Column) -> Column:
    hits = [found(text, p) for p in rule.patterns]
    if rule.kind == "own" and rule.build:
        out = rule.build(text)
    elif rule.kind == "any":
        out = F.when(hits[0], F.lit(rule.value))
    elif rule.kind == "all":
        out = F.when(reduce(lambda a, b: a & b, hits), F.lit(rule.value))
    elif rule.kind == "count":
        n = reduce(lambda a, b: a + b, [h.cast("int") for h in hits])
        out = F.when(n >= rule.steps[0][0], F.lit(rule.steps[0][1]))
        for least, value in rule.steps[1:]:
            out = out.when(n >= least, F.lit(value))
    elif rule.kind == "tiers":
        out = F.when(reduce(lambda a, b: a & b, hits), F.lit(rule.value)).when(hits[0], F.lit(rule.steps[0][1]))
    else:
        raise ValueError(f"no such kind of rule: {rule.kind}")
    if rule.unless:
        out = F.when(~found(text, rule.unless), out)
    return out.cast("double")


def score(votes: list[Column]) -> Column:
    """Mean of the votes cast; 0 if all abstain."""
    cast = F.filter(F.array(*votes), lambda v: v.isNotNull())
    return F.when(F.size(cast) > 0, F.aggregate(cast, F.lit(0.0), lambda a, v: a + v) / F.size(cast)).otherwise(0.0)


def sql_vote(rule: Rule, text: str) -> str:
    q = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    hits = [f"regexp_matches({text}, {q(p)})" for p in rule.patterns]
    if rule.kind == "any":
        out = f"CASE WHEN {hits[0]} THEN {rule.value:.1f} END"
    elif rule.kind == "all":
        out = f"CASE WHEN {' AND '.join(hits)} THEN {rule.value:.1f} END"
    elif rule.kind == "count":
        n = " + ".join(f"CAST({h} AS INT)" for h in hits)
        out = "CASE " + " ".join(f"WHEN {n} >= {k} THEN {v:.1f}" for k, v in rule.steps) + " END"
    else:
        out = f"CASE WHEN {' AND '.join(hits)} THEN {rule.value:.1f} WHEN {hits[0]} THEN {rule.steps[0][1]:.1f} END"
    if rule.unless:
        out = f"CASE WHEN NOT regexp_matches({text}, {q(rule.unless)}) THEN {out} END"
    return f"CAST({out} AS DOUBLE)"


def sql_score(votes: list[str]) -> str:
    return f"coalesce(list_avg(list_filter([{', '.join(votes)}], lambda v: v IS NOT NULL)), 0.0)"
