"""A ledger of paid calls: an answer is written under its key before anything reads it.

Questions that have no answer yet are asked in one job, and all that the plans read later is the
table it leaves: no plan that is read twice, and no task that is run again, asks again. Within a
task each few answers go to a journal in the ledger's folder as they come; whoever takes up the
task after a lost executor, or the job after a lost driver, reads the journal first. So at most
the calls in flight, `batch` of a task, are ever made twice.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.security import cache_key, redacted
from quernstone.operators.evidence import finding_prompt
from quernstone.sources.snapshots import Snapshots, saved

TRIES = 4
#: Hex digits of a key that name its journal.
PREFIX = 3
TRIED = "array<struct<attempt: int, at: string, ms: long, error: string>>"
ANSWERS = f"key string, model string, prompt string, redactions map<string,int>, answer string, usage string, tries {TRIED}"


@dataclass(frozen=True)
class Calling:
    """How calls are made: tries of each with waits of base * 2 ** n seconds, longer or shorter
    by up to `jitter` of it, so many at once in a task, and so many answers to a journal file."""

    tries: int = TRIES
    base: float = 1.0
    jitter: float = 0.25
    concurrency: int = 4
    batch: int = 16
    sleep: Callable[[float], None] = time.sleep


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def called(call: Callable, model: str, prompt: str, how: Calling) -> dict:
    """answer (null if all tries fail), usage, and each try. call() gives an answer, or an answer
    and a dict of what it used."""
    tries = []
    for n in range(how.tries):
        at, began = _now(), time.perf_counter()
        try:
            got = call(model, prompt)
            error = None
        except Exception as e:  # whatever a provider raises is a failed call
            got, error = None, f"{type(e).__name__}: {e}"[:2000]
        tries.append({"attempt": n + 1, "at": at, "ms": int(1000 * (time.perf_counter() - began)), "error": error})
        if error is None:
            answer, usage = got if isinstance(got, tuple) else (got, None)
            return {"answer": answer, "usage": json.dumps(usage) if usage is not None else None, "tries": tries}
        if n + 1 < how.tries:
            how.sleep(how.base * 2**n * random.uniform(1 - how.jitter, 1 + how.jitter))
    return {"answer": None, "usage": None, "tries": tries}


class Journal:
    """Answers as they come: files of JSON lines by the first digits of their keys, on any file
    system that Arrow reaches from the tasks."""

    def __init__(self, at: str, run: str):
        from pyarrow import fs

        self.run = run
        self.files, self.at = fs.FileSystem.from_uri(at if ":" in at else f"file://{at}")
        self.selector = fs.FileSelector

    def read(self, prefix: str) -> dict[str, dict]:
        """What was answered, and what failed in this run, by key."""
        found: dict[str, dict] = {}
        for f in self.files.get_file_info(self.selector(f"{self.at}/{prefix}", allow_not_found=True)):
            if f.path.endswith(".jsonl"):
                with self.files.open_input_stream(f.path) as stream:
                    rows = [json.loads(x) for x in stream.read().decode().splitlines()]
                found.update({r["key"]: r for r in rows if r["answer"] is not None or r["run"] == self.run})
        return found

    def write(self, prefix: str, rows: list[dict]) -> None:
        if not rows:
            return
        folder, name = f"{self.at}/{prefix}", uuid.uuid4().hex
        self.files.create_dir(folder)
        with self.files.open_output_stream(f"{folder}/{name}.part") as stream:
            stream.write("".join(json.dumps({**r, "run": self.run}) + "\n" for r in rows).encode())
        self.files.move(f"{folder}/{name}.part", f"{folder}/{name}.jsonl")


class Ledger:
    """Answers in a folder, on a disk or store that driver and tasks share."""

    def __init__(self, spark: SparkSession, at: str, how: Calling | None = None, calls_a_task: int = 256):
        self.spark, self.at = spark, at.rstrip("/")
        self.snapshots, self.how, self.calls_a_task = Snapshots(spark, at), how or Calling(), calls_a_task

    def table(self) -> DataFrame:
        """ANSWERS of each question that was asked: a later answer replaces a failure."""
        parts = self.snapshots.current()[1].get("parts", [])
        frames = [self.spark.read.schema(ANSWERS).parquet(f"{self.at}/{p}") for p in parts] or [self.spark.createDataFrame([], ANSWERS)]
        if len(frames) == 1:
            return frames[0]
        each = reduce(DataFrame.unionAll, [f.withColumn("part", F.lit(k)) for k, f in enumerate(frames)])
        best = F.max_by(F.struct(*frames[0].columns), F.struct(F.col("answer").isNotNull(), "part")).alias("r")
        return each.groupBy("key").agg(best).select("r.*")

    def ask(self, asked: DataFrame, call: Callable[[str, str], object]) -> DataFrame:
        """asked: key, model, prompt (redactions). Calls for each key without an answer, once
        whatever the number of its rows, and gives the table of all answers."""
        if "redactions" not in asked.columns:
            asked = asked.withColumn("redactions", F.create_map().cast("map<string,int>"))
        each = asked.select("key", "model", "prompt", F.col("redactions").cast("map<string,int>").alias("redactions"))
        once = each.groupBy("key").agg(F.first(F.struct("model", "prompt", "redactions")).alias("q")).select("key", "q.*")
        known = self.table().filter("answer IS NOT NULL").select("key")
        missing = saved(once.join(known, "key", "left_anti"), "missing")
        n = missing.count()
        if n:
            run = uuid.uuid4().hex
            self._called(missing, call, run, -(-n // self.calls_a_task)).write.parquet(f"{self.at}/{run}")
            self.snapshots.update(lambda content: {"parts": [*content.get("parts", []), run]})
        return self.table()

    def _called(self, missing: DataFrame, call: Callable[[str, str], object], run: str, tasks: int) -> DataFrame:
        how, at = self.how, f"{self.at}/_journal"

        def answered(prefix: str, rows: list[dict], journal: Journal, pool: ThreadPoolExecutor) -> Iterator[dict]:
            done = journal.read(prefix)
            for r in rows:
                if r["key"] in done:
                    yield {**r, **{c: done[r["key"]][c] for c in ("answer", "usage", "tries")}}
            left = [r for r in rows if r["key"] not in done]
            for k in range(0, len(left), how.batch):
                some = left[k : k + how.batch]
                got = list(pool.map(lambda r: {**r, **called(call, r["model"], r["prompt"], how)}, some))
                journal.write(prefix, [{c: r[c] for c in ("key", "answer", "usage", "tries")} for r in got])
                yield from got

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            journal = Journal(at, run)
            with ThreadPoolExecutor(how.concurrency) as pool:
                for f in frames:
                    by: dict[str, list[dict]] = {}
                    for r in f.to_dict("records"):
                        r["redactions"] = dict(r["redactions"])
                        by.setdefault(r["key"][:PREFIX], []).append(r)
                    for prefix, rows in sorted(by.items()):
                        out = list(answered(prefix, rows, journal, pool))
                        yield pd.DataFrame(out)[["key", "model", "prompt", "redactions", "answer", "usage", "tries"]].astype(object)

        prefix = F.substring("key", 1, PREFIX)
        return missing.repartition(tasks, prefix).sortWithinPartitions("key").mapInPandas(work, ANSWERS)

    def log(self) -> DataFrame:
        """A row for each try: at, key, model, prompt, answer, error, attempt, ms, usage,
        redactions; as sinks.call_log() takes them."""
        each = self.table().select("*", F.explode("tries").alias("t"))
        return each.select("t.at", "key", "model", "prompt", F.when(F.col("t.error").isNull(), F.col("answer")).alias("answer"), "t.error", "t.attempt", "t.ms", "usage", "redactions")


class LedgerVotes:
    """A vote provider whose calls go through a ledger."""

    def __init__(self, ledger: Ledger, models: list[str], call: Callable[[str, str], object]):
        self.ledger, self.models, self.call = ledger, models, call

    def answers(self, asked: DataFrame) -> DataFrame:
        keyed = asked.withColumn("key", cache_key(F.col("model"), F.col("field"), F.col("text"))).withColumn("redactions", redacted(F.col("text"))["counts"])
        keyed = saved(keyed.select("key", "model", "field", "text", "prompt", "redactions"), "asked")
        told = self.ledger.ask(keyed, self.call).select("key", "answer")
        return keyed.select("key", "model", "field", "text").join(told, "key", "left").drop("key")


class LedgerFindings:
    """A finding provider whose calls go through a ledger."""

    def __init__(self, ledger: Ledger, model: str, call: Callable[[str, str], object]):
        self.ledger, self.model, self.call = ledger, model, call

    def answers(self, controls: DataFrame) -> DataFrame:
        prompt = finding_prompt(F.col("control"), F.col("score"), F.col("maturity"), F.col("evidence"))
        keyed = saved(controls.withColumn("prompt", prompt).withColumn("key", F.sha2(F.concat_ws(":", F.lit("finding"), F.lit(self.model), "prompt"), 256)), "asked")
        told = self.ledger.ask(keyed.select("key", F.lit(self.model).alias("model"), "prompt"), self.call).select("key", "answer")
        return keyed.drop("prompt").join(told, "key", "left").drop("key")
