import hashlib
import hmac
import json
import re

import pytest
from pyspark.sql import functions as F

from quernstone import fixtures as X
from quernstone.catalog import DOMAIN, REDACTIONS
from quernstone.functions import rules as R
from quernstone.functions import security as S
from quernstone.operators import evidence as V
from quernstone.operators import rollup as U
from quernstone.operators import voting as O


def by_python(rule, text):
    hits = [bool(re.search(p, text, re.I)) for p in rule.patterns]
    if rule.unless and re.search(rule.unless, text, re.I):
        return None
    if rule.kind == "count":
        return next((v for n, v in rule.steps if sum(hits) >= n), None)
    if rule.kind == "tiers":
        return rule.value if all(hits) else rule.steps[0][1] if hits[0] else None
    return rule.value if all(hits) else None


@pytest.mark.parametrize("rule", DOMAIN.rules, ids=lambda r: r.name)
def test_rule_fires_as_its_pattern_says(spark, rule):
    cases = spark.createDataFrame(X.RULE_CASES, "case_id int, control string, text string").filter(F.col("control") == rule.control)
    got = cases.select("text", R.vote(rule, F.col("text")).alias("v")).collect()
    assert [r.v for r in got] == [by_python(rule, r.text) for r in got]
    assert any(r.v is not None for r in got) and any(r.v is None for r in got)


def test_all_abstain_is_zero_and_zero_is_a_vote(spark):
    texts = spark.createDataFrame([("PC2", "nothing"), ("PC2", "no dependency map; a dependency matrix")], "control string, text string")
    assert [r.rule_score for r in O.rule_scores(texts, DOMAIN).orderBy("text").collect()] == [0.5, 0.0]


def test_strict_parsing_sees_the_hyphen(spark):
    a = spark.createDataFrame([("NON-COMPLIANT",), (None,), ("",)], "answer string")
    assert [tuple(r) for r in a.select(O.parsed(F.col("answer")), O.parsed(F.col("answer"), True)).collect()] == [(1.0, 0.0), (None, None), (0.0, 0.0)]


def test_cache_spares_calls(spark):
    votes = spark.createDataFrame(X.VOTES, "field string, text string, model string, answer string")
    texts = votes.select("field", "text").distinct()
    every = O.asked_of(texts, ["m1", "m2", "m3"])
    cache = every.filter("model = 'm1'").select(S.cache_key(F.col("model"), F.col("field"), F.col("text")).alias("key"), F.lit(0.5).alias("vote"))
    seen = []

    class Counting(O.StoredVotes):
        def answers(self, asked):
            seen.extend(r.model for r in asked.select("model").collect())
            return super().answers(asked)

    got = O.cast_votes(texts, Counting(votes, ["m1", "m2", "m3"]), cache).collect()
    assert "m1" not in seen and len(got) == 18 and all(r.vote == 0.5 for r in got if r.model == "m1")


def test_prompts_carry_redacted_text_only(spark):
    texts = spark.createDataFrame([("f", "mail jane@example.org")], "field string, text string")
    r = O.asked_of(texts, ["m"]).first()
    assert "jane@" not in r.prompt and "[REDACTED_EMAIL]" in r.prompt and r.text == "mail jane@example.org"


def by_python_redacted(text):
    counts = {}
    for name, pattern, exact in REDACTIONS:
        text, n = re.compile(pattern, 0 if exact else re.I).subn(f"[REDACTED_{name.upper()}]", text)
        if n:
            counts[name] = n
    return text, counts


def test_redaction_in_sequence_and_idempotent(spark):
    t = spark.createDataFrame(X.UNTRUSTED, "id int, text string")
    got = t.select("text", S.redacted(F.col("text")).alias("r"), S.redacted(S.redacted(F.col("text"))["text"])["text"].alias("again")).collect()
    for r in got:
        assert (r.r.text, r.r.counts) == by_python_redacted(r.text) and r.again == r.r.text


def test_signature_is_hmac_of_canonical_json(spark):
    row = spark.createDataFrame([("naïve \"x\"\n", 1.5)], "name string, score double")
    entries = {"score": F.col("score").cast("string"), "name": S.quoted(F.col("name"))}
    for key in (b"short", b"k" * 80):
        i = row.select(S.signed(key, entries, F.lit("2024-01-01T00:00:00+00:00")).alias("i")).first().i
        payload = {"name": "naïve \"x\"\n", "score": 1.5, "_generated_at": i.generated_at}
        text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
        assert i.hmac == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    none = row.select(S.verified(b"k", entries, F.lit(None).cast("struct<hmac:string,generated_at:string,algorithm:string>"))).first()[0]
    assert none is False


def test_buckets_at_their_cuts(spark):
    got = spark.createDataFrame([(x,) for x in (80.0, 79.99, 65.0, 50.0, 35.0, 34.99)], "s double").select(U.maturity(F.col("s")).substr(1, 2), U.label(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("L5", "COMPLIANT"), ("L4", "COMPLIANT"), ("L4", "COMPLIANT"), ("L3", "PARTIAL"), ("L2", "PARTIAL"), ("L1", "NON_COMPLIANT")]


def test_evidence_follows_the_catalog_and_has_a_placeholder(spark):
    rows = [("c", "A", f"f{k}", k, float(s), b) for k, (s, b) in enumerate([(10, " x" * 300), (0, ""), (40, "y"), (49, "z"), (50, "m"), (70, "s")])]
    fields = spark.createDataFrame(rows, "corpus_id string, control string, field string, ordinal int, score double, best_chunk string")
    text = V.evidence_text(V.picked(fields)).first().evidence
    assert [w for w in text.split() if w[0] == "f" and w.endswith(":")] == ["f0:", "f1:", "f2:", "f4:", "f5:"]
    assert "f3" not in text and max(len(x) for x in text.split("\n")) <= 200


def test_verify_report_file(tmp_path, monkeypatch):
    from quernstone.plans import report as P

    monkeypatch.setenv(S.KEY_VARIABLE, "secret key")
    payload = {"scores": {"a": 1.5, "ü": None}, "findings": []}
    block = {"hmac": P.digest(payload, S.signing_key(), "now"), "generated_at": "now", "algorithm": S.ALGORITHM}
    good, bad, bare = (tmp_path / f"{n}.json" for n in "abc")
    good.write_text(json.dumps({**payload, "integrity": block}))
    bad.write_text(json.dumps({**payload, "findings": [1], "integrity": block}))
    bare.write_text(json.dumps(payload))
    assert [P.main(str(p)) for p in (good, bad, bare)] == [0, 1, 1]
    monkeypatch.delenv(S.KEY_VARIABLE)
    assert S.signing_key() == S.signing_key() and len(S.signing_key()) == 64
