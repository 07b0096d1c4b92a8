"""A folder of documents as a Spark data source: spark.read.format("quernstone_corpus").

Partitions are made of files by their sizes, and a long pdf is several of them, by ranges of its
pages. A file that can't be read is a row with an error, and fails alone. Files are reached
through Arrow, on any file system that it knows.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quernstone.catalog import MIN_WORDS
from quernstone.functions import text as T
from quernstone.sources.documents import docx_text, drop_repeated_lines

FORMAT = "quernstone_corpus"
SCHEMA = "path string, kind string, part int, text string, error string"
#: Bytes of a partition's files, and of a pdf that is read by one task.
BYTES, PDF_BYTES = 32 << 20, 4 << 20
KINDS = ((re.compile(r"(?i)\.pdf$"), "pdf"), (re.compile(r"(?i)\.docx$"), "docx"), (re.compile(r"(?i)\.(txt|text)$"), "txt"))


def kind_of(path: str) -> str | None:
    return next((k for p, k in KINDS if p.search(path)), None)


@dataclass
class Share(InputPartition):
    """(path, part, of how many parts) of the files that one task reads."""

    files: list[tuple[str, int, int]]


def pdf_pages(data: bytes, part: int, parts: int) -> str:
    """The text layer of a range of a pdf's pages. Needs the optional package pdfplumber."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        n = len(pdf.pages)
        pages = [p.extract_text() for p in pdf.pages[part * n // parts : (part + 1) * n // parts]]
    return "".join(f"{t}\n" for t in pages if t)


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.at = options["path"]
        self.bytes, self.pdf_bytes = int(options.get("bytes", BYTES)), int(options.get("pdfBytes", PDF_BYTES))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.at if re.match("[a-zA-Z0-9+.-]+:", self.at) else f"file://{self.at}")

    def partitions(self) -> list[Share]:
        """Sizes alone are looked at: no file is opened here."""
        from pyarrow import fs

        files, at = self._files()
        info = files.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
        out: list[Share] = []
        held: list[tuple[str, int, int]] = []
        size = 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            if kind_of(f.path) == "pdf" and f.size > self.pdf_bytes:
                parts = -(-f.size // self.pdf_bytes)
                out += [Share([(f.path, k, parts)]) for k in range(parts)]
                continue
            if held and size + f.size > self.bytes:
                out.append(Share(held))
                held, size = [], 0
            held.append((f.path, 0, 1))
            size += f.size
        return [*out, *([Share(held)] if held else [])] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        files, _ = self._files()
        for path, part, parts in partition.files:
            kind, text, error = kind_of(path), None, None
            try:
                if kind is None:
                    raise ValueError("unsupported file type")
                with files.open_input_stream(path) as stream:
                    data = stream.read()
                text = data.decode("utf-8", "ignore") if kind == "txt" else docx_text(data) if kind == "docx" else pdf_pages(data, part, parts)
            except Exception as e:  # one bad file must not fail the job
                error = f"{type(e).__name__}: {e}"
            yield path, kind, part, text, error


class CorpusSource(DataSource):
    """Options: path; bytes (of a partition's files), pdfBytes (of a pdf that one task reads)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(dict(self.options))


def read_corpus(spark: SparkSession, path: str, least: int = MIN_WORDS, **options: int) -> DataFrame:
    """path, kind, text, error of all files below a folder. A document's parts are put together,
    lines of a pdf that repeat go, and what has fewer than `least` words is an error; a file is
    one row in the end, with a text or an error."""
    spark.dataSource.register(CorpusSource)
    rows = spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(path)
    parts = F.array_sort(F.collect_list(F.struct("part", F.coalesce("text", F.lit("")).alias("text"))))
    whole = rows.groupBy("path", "kind").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.max("error").alias("error"))
    pdf = F.coalesce(F.col("kind") == "pdf", F.lit(False))
    out = drop_repeated_lines(whole.filter(pdf), ["path", "kind", "error"]).unionByName(whole.filter(~pdf))
    n = F.size(T.tokens(F.col("text")))
    error = F.coalesce("error", F.when(n < least, F.concat(n.cast("string"), F.lit(f" words, fewer than {least}"))))
    return out.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
