"""Signed reports as files: df.write.format("quernstone_reports"), one pretty JSON document for
each corpus, all of them or none.

Tasks write into a folder aside; only when all have ended is it given its name, by one rename. A
job that fails leaves nothing, and a task that is run again writes its files anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quernstone.functions.security import ALGORITHM
from quernstone.plans.report import valid

FORMAT = "quernstone_reports"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def document(report: str, hmac: str, generated_at: str) -> str:
    """A report with its integrity block, for people to read."""
    block = {"algorithm": ALGORITHM, "generated_at": generated_at, "hmac": hmac}
    return json.dumps({**json.loads(report), "integrity": block}, indent=2, sort_keys=True) + "\n"


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.aside = f"{self.path}.writing-{uuid.uuid4().hex}"

    def _files(self, at: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(at if ":" in at else f"file://{at}")

    def write(self, iterator: Iterator) -> Written:
        files, at = self._files(self.aside)
        files.create_dir(at)
        names = []
        for r in iterator:
            names.append(f"{quote(str(r.corpus_id), safe='')}.json")
            with files.open_output_stream(f"{at}/{names[-1]}") as out:
                out.write(document(r.report, r.hmac, r.generated_at).encode())
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m for n in m.files]
        files, aside = self._files(self.aside)
        _, at = self._files(self.path)
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a corpus has several reports")
        files.create_dir(aside)
        from pyarrow import fs

        if files.get_file_info(at).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            files.delete_dir(at)
        files.move(aside, at)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, at = self._files(self.aside)
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


class ReportSource(DataSource):
    """Writes rows of reports(): corpus_id, report, hmac, generated_at. Option: path, a folder
    that is not there yet, unless the mode is overwrite."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "corpus_id string, report string, hmac string, generated_at string, algorithm string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], overwrite)


def write_reports(signed: DataFrame, path: str, overwrite: bool = False) -> None:
    signed.sparkSession.dataSource.register(ReportSource)
    # each corpus once in a job, so that a file has one writer
    signed.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def verify_written(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """path, valid of each report file of a folder. A file that is no JSON is not valid."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = []
            for text in f["content"]:
                try:
                    payload = json.loads(bytes(text))
                    block = payload.pop("integrity", None) or {}
                    told.append(valid(json.dumps(payload), block.get("hmac"), block.get("generated_at"), key))
                except (ValueError, AttributeError):
                    told.append(False)
            yield pd.DataFrame({"path": f["path"], "valid": told})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", "content")
    return files.mapInPandas(work, "path string, valid boolean")
