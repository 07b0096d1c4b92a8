import json
import os

import pytest
from pyspark.sql import functions as F

from quernstone.plans import report as P
from quernstone.sources.report_format import verify_written, write_reports

KEY, AT = b"key", "2024-01-01T00:00:00+00:00"


def signed(spark, names):
    rows = [(n, {"scores": {"company_score": 1.5 + k, "ü": "é"}, "findings": {}}) for k, n in enumerate(names)]
    each = [(n, P.canonical(p), P.digest(p, KEY, AT), AT, "HMAC-SHA256") for n, p in rows]
    return spark.createDataFrame(each, "corpus_id string, report string, hmac string, generated_at string, algorithm string").repartition(3)


def test_all_reports_are_written_and_verified(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "reports")
    names = ["a", "b/c", "d é", "e"]
    write_reports(signed(spark, names), at)
    assert sorted(os.listdir(at)) == ["a.json", "b%2Fc.json", "d%20%C3%A9.json", "e.json"] and os.listdir(tmp_path) == ["reports"]
    assert [r.valid for r in verify_written(spark, at, KEY).collect()] == [True] * 4
    assert not any(r.valid for r in verify_written(spark, at, b"other").collect())
    text = (tmp_path / "reports" / "a.json").read_text()
    assert text.count("\n") > 5 and json.loads(text)["integrity"]["generated_at"] == AT
    monkeypatch.setenv("QUERNSTONE_SIGNING_KEY", "key")
    assert P.main(f"{at}/e.json") == 0
    (tmp_path / "reports" / "e.json").write_text("no json")
    assert sorted(r.valid for r in verify_written(spark, at, KEY).collect()) == [False, True, True, True]
    with pytest.raises(Exception):
        write_reports(signed(spark, ["x"]), at)
    assert len(os.listdir(at)) == 4 and os.listdir(tmp_path) == ["reports"]
    write_reports(signed(spark, ["x"]), at, overwrite=True)
    assert os.listdir(at) == ["x.json"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = signed(spark, ["a", "b", "c"]).withColumn("report", F.when(F.col("corpus_id") == "c", "no json").otherwise(F.col("report")))
    with pytest.raises(Exception):
        write_reports(bad, str(tmp_path / "reports"))
    twice = signed(spark, ["a"]).unionAll(signed(spark, ["a"]))
    with pytest.raises(Exception):
        write_reports(twice, str(tmp_path / "reports"))
    assert os.listdir(tmp_path) == []


def test_no_reports(spark, tmp_path):
    write_reports(signed(spark, ["a"]).filter("false"), str(tmp_path / "reports"))
    assert os.listdir(tmp_path / "reports") == []
