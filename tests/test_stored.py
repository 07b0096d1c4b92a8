"""The stored index, the vote store and the ledger beyond what their queries show."""

import contextlib
import io
import json
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from quernstone.catalog import DOMAIN, Field
from quernstone.functions.security import cache_key
from quernstone.operators import index as I
from quernstone.operators import retrieve as R
from quernstone.operators import voting as O
from quernstone.plans.report import reports
from quernstone.plans.scoring import score_corpora
from quernstone.sources import sinks
from quernstone.sources.ledger import Calling, Ledger, LedgerFindings, LedgerVotes
from quernstone.sources.snapshots import Conflict, Snapshots
from quernstone.sources.stored_index import Search, StoredIndex
from quernstone.sources.vote_store import VoteStore

FIELDS = (Field("A", "x", "alpha beta beta"), Field("B", "x", "gamma Delta"), Field("C", "y", "nowhere"))


def texts(spark, n=120, seed=3):
    import random

    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", *(f"w{k}" for k in range(40))]
    rows = [(f"c{k % 3}", k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 900)))) for k in range(n)]
    return spark.createDataFrame([*rows, ("c0", 500, None), ("c0", 501, ""), ("c9", 502, "alpha")], "corpus_id string, doc_id int, text string").repartition(5)


def key(rows):
    return sorted((r.corpus_id, r.field, r.rank, r.doc_id, r.chunk_idx, r.score) for r in rows.collect())


def ranked(spark, docs, k):
    return key(R.top_k(R.bm25(I.chunk(docs), R.fields_frame(spark, FIELDS)), k))


def test_versions_have_one_writer(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.current() == (0, {})
    s.commit(1, {"a": 1})
    with pytest.raises(Conflict):
        s.commit(1, {"a": 2})
    assert s.current() == (1, {"a": 1})
    done = []
    threads = [threading.Thread(target=lambda k=k: done.append(s.update(lambda c: {**c, f"t{k}": k}))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert s.version() == 9 and s.read(9) == {"a": 1, **{f"t{k}": k for k in range(8)}}
    assert sorted(os.listdir(tmp_path / "s" / "_versions"))[-1] == "000000000009.json"


@pytest.mark.parametrize("pruned", [0, 10**9])
def test_search_of_segments_equals_a_rebuild(spark, tmp_path, pruned):
    docs, fields = texts(spark), R.fields_frame(spark, FIELDS)
    index = StoredIndex(spark, str(tmp_path / "i"), buckets=4, tile_bits=1)
    search = lambda k=7: key(index.search(fields, k, seeds=3, pruned_from=pruned))
    index.add(docs.filter("doc_id < 50"))
    assert search() == ranked(spark, docs.filter("doc_id < 50"), 7)
    index.add(docs.filter("doc_id >= 50"))
    index.remove(docs.filter("doc_id % 5 = 1").withColumn("text", F.lit("of no account")))
    left = docs.filter("doc_id % 5 != 1")
    assert search() == ranked(spark, left, 7)
    changed = docs.filter("doc_id % 7 = 2").withColumn("text", F.concat("text", F.lit(" alpha alpha gamma")))
    index.add(changed)
    now = docs.filter("doc_id % 5 != 1 AND doc_id % 7 != 2").unionAll(changed)
    assert search() == ranked(spark, now, 7)
    index.remove(spark.createDataFrame([("c0", 9999)], "corpus_id string, doc_id int"))
    before = len(index.snapshots.current()[1]["segments"])
    index.compact(2)
    after = index.snapshots.current()[1]
    assert len(after["segments"]) < before and not [g for g in after["removed"] if set(g["from"]) - {s["name"] for s in after["segments"]}]
    assert search() == ranked(spark, now, 7) and search(1) == ranked(spark, now, 1)
    want = I.doc_freq(I.term_freq(I.chunk(now))).orderBy("corpus_id", "term").collect()
    assert index.doc_freq().orderBy("corpus_id", "term").collect() == want
    assert index.windows().count() == I.chunk(now).count()


def test_pruning_skips_tiles_and_reads_the_asked_terms_only(spark, tmp_path):
    rare = [("c", k, "filler " * 50 + "alpha " * (40 if k in (7, 300) else 1)) for k in range(400)]
    index = StoredIndex(spark, str(tmp_path / "i"), buckets=16, tile_bits=2)
    index.add(spark.createDataFrame(rare, "corpus_id string, doc_id int, text string").coalesce(1))
    found = Search(index, {"A": {"alpha": 1}}, 2, (1.5, 0.75, 1.0), 2)
    assert found.bounds().count() == 100 and found.chosen().count() == 2
    assert [r.doc_id for r in found.best(0).orderBy("rank").collect()] == [7, 300]
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        found.bounds().explain("formatted")
    plan = shown.getvalue()
    scans = [x for x in plan.split("\n\n") if "ReadSchema" in x and "top_tf" in x]
    assert scans and all("PartitionFilters: [isnotnull(bucket" in x or "bucket" in x.split("PartitionFilters")[1].split("\n")[0] for x in scans)
    assert all("postings" not in x.split("ReadSchema")[1] and "EqualTo(term,alpha)" in x for x in scans)


def test_an_add_that_meets_another_loses_nothing(spark, tmp_path):
    docs, index = texts(spark, 40), StoredIndex(spark, str(tmp_path / "i"), buckets=2)
    parts = [threading.Thread(target=lambda k=k: index.add(docs.filter(f"doc_id % 2 = {k}"))) for k in range(2)]
    [t.start() for t in parts]
    [t.join() for t in parts]
    assert key(index.search(R.fields_frame(spark, FIELDS), 5)) == ranked(spark, docs, 5)


def test_nothing_indexed(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.stats()
    index.remove(texts(spark, 3))
    index.compact()
    assert index.snapshots.current()[1]["segments"] == []


def votes(spark, rows):
    return spark.createDataFrame(rows, "key string, vote double, seq long")


def test_two_writers_of_votes(spark, tmp_path):
    store = VoteStore(spark, str(tmp_path / "v"), buckets=4)
    writers = [threading.Thread(target=lambda k=k: [store.upsert(votes(spark, [(f"{k}-{i}-{n}", float(n), 0) for n in range(20)])) for i in range(3)]) for k in range(2)]
    [t.start() for t in writers]
    [t.join() for t in writers]
    assert store.table().count() == 120 and len(store._parts()) == 6
    store.upsert(votes(spark, [("0-0-1", 0.5, 1), ("0-0-1", 0.25, 2), ("0-0-2", None, 1), ("new", 1.0, 0)]))
    store.compact(2)
    assert len(store._parts()) == 1
    got = {r.key: r.vote for r in store.get(["0-0-1", "0-0-2", "new", "none"]).collect()}
    assert got == {"0-0-1": 0.25, "0-0-2": 2.0, "new": 1.0}
    asked = spark.createDataFrame([(1, "new"), (2, "none"), (3, "new")], "id int, key string")
    assert sorted(tuple(r) for r in store.lookup(asked).select("id", "vote").collect()) == [(1, 1.0), (3, 1.0)]


def test_a_lookup_opens_few_files(spark, tmp_path):
    store = VoteStore(spark, str(tmp_path / "v"), buckets=64)
    store.upsert(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit(1.0).alias("vote"), F.lit(0).alias("seq")))
    one = store.get([spark.range(1).select(F.sha2(F.lit("77"), 256).alias("k")).first().k])
    assert one.count() == 1
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        one.explain("formatted")
    assert "bucket" in shown.getvalue().split("PartitionFilters")[1].split("\n")[0] and "EqualTo(key" in shown.getvalue()


def counting(folder, fail=lambda model, prompt: False):
    """A provider that leaves a line for each call in a file of its process."""

    def call(model, prompt):
        name = uuid.uuid4().hex
        with open(f"{folder}/../{name}", "w") as f:
            f.write(json.dumps([model, prompt]))
        os.rename(f"{folder}/../{name}", f"{folder}/{name}")  # there whole or not at all
        if fail(model, prompt):
            raise TimeoutError("no answer")
        return "COMPLIANT"

    return call


def calls(folder):
    return sorted(tuple(json.loads(open(f"{folder}/{f}").read())) for f in os.listdir(folder))


def test_each_question_is_asked_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    own = Ledger(spark, str(tmp_path / "l"), Calling(base=0.0))
    rows = [("c", k, f"{f.query} {f.query} text {k}") for k, f in enumerate(DOMAIN.fields[:6])] + [("c", 50 + k, f"filler {k} and more of it") for k in range(30)]
    docs = spark.createDataFrame(rows, "corpus_id string, doc_id int, text string")
    provider = LedgerVotes(own, ["m1", "m2"], counting(tmp_path / "calls"))
    scores = score_corpora(docs, DOMAIN, provider)
    made = calls(tmp_path / "calls")
    asked = scores.evidence.select("field", "text").distinct().count()
    assert asked and len(made) == len(set(made)) == 2 * asked
    findings = LedgerFindings(own, "writer", counting(tmp_path / "calls"))
    for df in (scores.evidence, scores.fields, scores.controls, scores.companies):
        df.collect()
    for _ in range(2):
        reports(scores, b"k", "2024-01-01T00:00:00+00:00", findings).collect()
    after = [c for c in calls(tmp_path / "calls") if c[0] == "writer"]
    assert len(calls(tmp_path / "calls")) == len(made) + len(after) and len(after) == len(set(after)) > 0
    assert sinks.call_log(own.log()).filter("stream = 'errors'").count() == 0


def test_failures_are_logged_and_asked_again_later(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    asked = spark.createDataFrame([(f"{k:064x}", "m", f"q{k}") for k in range(40)], "key string, model string, prompt string")
    own = Ledger(spark, str(tmp_path / "l"), Calling(tries=3, base=0.0, batch=4), calls_a_task=10)
    told = own.ask(asked, counting(tmp_path / "calls", lambda m, p: p.endswith("3")))
    assert told.filter("answer IS NULL").count() == 4 and told.count() == 40
    assert len(calls(tmp_path / "calls")) == 36 + 3 * 4
    log = sinks.call_log(own.log())
    assert {r.stream: r["count"] for r in log.groupBy("stream").count().collect()} == {"calls": 36, "errors": 12}
    assert log.filter("error LIKE 'TimeoutError: no answer'").agg(F.max("attempt")).first()[0] == 3
    told = own.ask(asked, counting(tmp_path / "calls"))
    assert told.filter("answer IS NULL").count() == 0 and len(calls(tmp_path / "calls")) == 48 + 4


def test_a_job_that_dies_asks_no_more_than_what_was_in_flight(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    asked = spark.createDataFrame([(f"abc{k:061x}", "m", f"q{k}") for k in range(60)], "key string, model string, prompt string")
    own = Ledger(spark, str(tmp_path / "l"), Calling(tries=1, batch=5, concurrency=2))
    count = counting(tmp_path / "calls")
    marker = tmp_path / "died"

    def dying(model, prompt):
        out = count(model, prompt)
        if len(os.listdir(tmp_path / "calls")) > 31 and not marker.exists():
            marker.write_text("")
            os._exit(1)  # as a lost executor does
        return out

    with pytest.raises(Exception):
        own.ask(asked, dying)
    assert own.table().count() == 0
    assert own.ask(asked, dying).filter("answer = 'COMPLIANT'").count() == 60
    made = calls(tmp_path / "calls")
    assert set(made) == {("m", f"q{k}") for k in range(60)} and len(made) - 60 <= 5


def test_keys_and_redactions_of_a_ledger(spark, tmp_path):
    own = Ledger(spark, str(tmp_path / "l"), Calling(base=0.0))
    texts = spark.createDataFrame([("f", "write to a.b@example.org now")], "field string, text string")
    got = O.cast_votes(texts, LedgerVotes(own, ["m"], lambda m, p: ("PARTIAL", {"tokens": len(p)}) if "example.org" not in p else "leaked"))
    assert [r.vote for r in got.collect()] == [0.5]
    row = own.log().first()
    assert row.key == texts.select(cache_key(F.lit("m"), F.col("field"), F.col("text"))).first()[0]
    assert sum(row.redactions.values()) == 1 and json.loads(row.usage)["tokens"] > 0


def test_a_build_shuffles_no_postings_and_holds_each_text_once(spark, tmp_path):
    import random

    rng = random.Random(8)
    docs = spark.createDataFrame([("c", k, " ".join(f"word{rng.randrange(3000)}" for _ in range(900))) for k in range(200)], "corpus_id string, doc_id int, text string").repartition(4)
    at = str(tmp_path / "docs")
    docs.write.parquet(at)
    docs, disk = spark.read.parquet(at), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {(f := files.apply(i)).getPath(): f.length() for i in range(files.size()) if "shuffle" in files.apply(i).getName()}

    before = shuffled()
    index = StoredIndex(spark, str(tmp_path / "i"), tile_bits=2)
    index.add(docs)
    new = sum(n for p, n in shuffled().items() if p not in before)
    raw = docs.agg(F.sum(F.length("text"))).first()[0]
    assert new < raw / 4
    held = spark.read.parquet(f"{tmp_path}/i/*/texts")
    assert held.count() == 200 and held.agg(F.sum(F.length("text"))).first()[0] == raw
