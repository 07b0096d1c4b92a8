"""Signed reports: scores and findings of a corpus as one JSON text, and its verification."""

from __future__ import annotations

import hashlib
import hmac
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import canonical as canonical_json
from quernstone.functions.security import ALGORITHM, hmac_sha256, quoted, signing_key
from quernstone.operators import evidence as V
from quernstone.operators import rollup as U
from quernstone.plans.scoring import Scores


def canonical(payload: dict) -> str:
    """Sorted keys, no spaces, escapes for all that is not ASCII."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))


def digest(payload: dict, key: bytes, generated_at: str) -> str:
    text = canonical({**payload, "_generated_at": generated_at})
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def sealed(report: Column, key: bytes, generated_at: Column) -> Column:
    """The signature of a canonical report: over its text with the time put in, whose key comes
    before all others."""
    head = F.concat(F.lit('{"_generated_at":'), quoted(generated_at), F.when(report == "{}", "").otherwise(","))
    return hmac_sha256(key, F.concat(head, F.substring(report, F.lit(2), F.length(report))))


def reports(scores: Scores, key: bytes, generated_at: str, provider: V.FindingProvider | None = None) -> DataFrame:
    """corpus_id, report (canonical JSON of scores and findings), hmac, generated_at,
    algorithm. Written in expressions; no row leaves the JVM."""
    said = V.findings(scores.controls, scores.fields, provider)
    by = said.groupBy("corpus_id").agg(F.map_from_entries(F.collect_list(F.struct("control", F.struct("finding", "remediation").alias("f")))).alias("findings"))
    whole = U.nested(scores.companies, scores.controls, scores.fields).join(by, "corpus_id")
    rows = whole.select("corpus_id", F.struct("findings", F.struct("company_score", "controls").alias("scores")).alias("payload"))
    out = rows.select("corpus_id", canonical_json.json(F.col("payload"), rows.schema["payload"].dataType).alias("report"))
    return out.select("corpus_id", "report", sealed(F.col("report"), key, F.lit(generated_at)).alias("hmac"), F.lit(generated_at).alias("generated_at"), F.lit(ALGORITHM).alias("algorithm"))


def verify(signed: DataFrame, key: bytes) -> DataFrame:
    """Adds valid to corpus_id, report, hmac, generated_at: whether the signature fits the report
    as it stands, which is canonical as reports() writes it. A missing part does not fit. JSON
    that was written anew in another form is for verify_parsed()."""
    fits = sealed(F.col("report"), key, F.col("generated_at")) == F.col("hmac")
    return signed.select("corpus_id", "report", "hmac", "generated_at", F.coalesce(fits, F.lit(False)).alias("valid"))


def valid(report: str | None, mac: str | None, generated_at: str | None, key: bytes) -> bool:
    """Whether a signature fits; a missing part or a broken text does not."""
    if report is None or mac is None or generated_at is None:
        return False
    try:
        payload = json.loads(report)
    except ValueError:
        return False
    return hmac.compare_digest(digest(payload, key, generated_at), mac)


def verify_parsed(signed: DataFrame, key: bytes) -> DataFrame:
    """verify() of reports in any form of JSON, parsed and made canonical in Python."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[["corpus_id", "report", "hmac", "generated_at"]].astype(object)
            yield f.assign(valid=[valid(r, m, g, key) for r, m, g in zip(f["report"], f["hmac"], f["generated_at"], strict=True)])

    return signed.select("corpus_id", "report", "hmac", "generated_at").mapInPandas(work, "corpus_id string, report string, hmac string, generated_at string, valid boolean")


def main(path: str) -> int:
    """Verifies one report file: a JSON object with an integrity block. Exit 0: it fits."""
    with open(path, encoding="utf-8") as f:
        payload = json.load(f)
    block = payload.pop("integrity", None) or {}
    ok = valid(json.dumps(payload), block.get("hmac"), block.get("generated_at"), signing_key())
    print("valid" if ok else "NOT valid")
    return int(not ok)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1]))
