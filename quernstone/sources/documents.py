"""Readers: files, pages and rows become documents of corpus_id, doc_id, text, source."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.catalog import MIN_WORDS, REPEATED_LINES
from quernstone.functions import text as T
from quernstone.operators.prefix import before

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCANNED_BELOW = 40


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then the tables' rows with cells parted by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    if body is None:
        return ""

    def said(p) -> str:
        out = []
        for x in p.iter():
            if x.tag == f"{WORD}t":
                out.append(x.text or "")
            elif x.tag == f"{WORD}tab":
                out.append("\t")
            elif x.tag in (f"{WORD}br", f"{WORD}cr"):
                out.append("\n")
        return "".join(out)

    parts = [t for p in body.findall(f"{WORD}p") if (t := said(p)).strip()]
    for row in body.findall(f"{WORD}tbl/{WORD}tr"):
        cells = ["\n".join(said(p) for p in c.findall(f"{WORD}p")).strip() for c in row.findall(f"{WORD}tc")]
        if line := " | ".join(c for c in cells if c):
            parts.append(line)
    return "\n".join(parts)


def pdf_text(data: bytes, ocr: Callable[[bytes], str | None] | None = None) -> str:
    """The text layer, page by page; ocr() where it has under 40 characters a page. Needs the
    optional package pdfplumber."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        pages = [p.extract_text() for p in pdf.pages]
    text = "".join(f"{t}\n" for t in pages if t)
    if pages and len(text) / len(pages) < SCANNED_BELOW and ocr:
        try:
            text = ocr(data) or text
        except Exception:  # a failed second reading leaves the first
            return text
    return text


def read_files(spark: SparkSession, paths: str | list[str], ocr: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """path, kind, text, error of files by their ending: txt (bytes that aren't UTF-8 are
    dropped), docx, pdf. Others, and files that can't be read, have an error and no text; they
    fail alone. Lines of a pdf that repeat over five times go."""
    files = spark.read.format("binaryFile").load(paths).select("path", T.routed(F.col("path")).alias("kind"), "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, kind, content in zip(f["path"], f["kind"], f["content"], strict=True):
                text = error = None
                try:
                    if kind == "txt":
                        text = bytes(content).decode("utf-8", "ignore")
                    elif kind == "docx":
                        text = docx_text(bytes(content))
                    elif kind == "pdf":
                        text = pdf_text(bytes(content), ocr)
                    else:
                        error = "unsupported file type"
                except Exception as e:  # one bad file must not fail the job
                    error = f"{type(e).__name__}: {e}"
                out.append((path, kind, text, error))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "error"])

    read = files.mapInPandas(work, "path string, kind string, text string, error string")
    pdf = F.col("kind") == "pdf"
    return drop_repeated_lines(read.filter(pdf), ["path", "kind", "error"]).unionByName(read.filter(~F.coalesce(pdf, F.lit(False))))


def drop_repeated_lines(docs: DataFrame, keys: list[str], most: int = REPEATED_LINES) -> DataFrame:
    """Lines whose stripped form occurs over `most` times in their text go; the others keep
    order and form. Blank lines are one group. keys tell the texts apart; no row is shuffled: a
    text's lines are sorted by their stripped form in an array of its own, where a line belongs
    to such a group if one as far as `most` from some neighbour is equal."""
    split = docs.select(*keys, "text", T.lines(F.col("text")).alias("lines"))
    short = F.size("lines") <= most
    # a generator keeps the sorted array a column; within the lambda it would be sorted each time
    pairs = F.transform("lines", lambda x, i: F.struct(T.stripped(x).alias("bare"), i.alias("at"), x.alias("line")))
    ordered = split.select(*keys, "text", F.explode(F.array(F.when(~short, F.array_sort(pairs)))).alias("by"), F.array_join("lines", "\n").alias("whole"))
    n = F.size("by")

    def often(x, i):
        first = F.sequence(F.greatest(i - most, F.lit(0)), i)
        return F.exists(first, lambda j: (j + most < n) & (F.get("by", j)["bare"] == x["bare"]) & (F.get("by", j + most)["bare"] == x["bare"]))

    kept = F.array_sort(F.transform(F.filter("by", lambda x, i: ~often(x, i)), lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    return ordered.select(*keys, F.when(F.col("by").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text"))


def enough_words(docs: DataFrame, least: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents of at least so many words, the others)."""
    n = F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0))
    return docs.filter(n >= least), docs.filter(n < least)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, error of pages fetched before: a page without any text has an error
    and no text."""
    out = pages.select("page_id", "url", F.coalesce(T.plain(F.col("html")), F.lit("")).alias("text"))
    empty = F.col("text") == ""
    return out.withColumn("error", F.when(empty, F.lit("no text found"))).withColumn("text", F.when(~empty, F.col("text")))


def from_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text of the pages that have any; read_pages() says which have none."""
    return read_pages(pages).filter("error IS NULL").drop("error")


def ingest(files: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """path, kind, text, error of one request: files (of read_files) if there are any, else the
    pages (of read_pages); neither is an error."""
    if files is not None and not files.isEmpty():
        return files.select("path", "kind", "text", "error")
    if pages is None:
        raise ValueError("neither files nor a page")
    return pages.select(F.col("url").alias("path"), F.lit("url").alias("kind"), "text", "error")


def spread(table: DataFrame) -> DataFrame:
    """Deals the rows out if the table has fewer files than there are cores: a file of one row
    group is one task. A table of many files, so any large one, is left as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def from_table(table: DataFrame, corpus: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """corpus_id, doc_id, text of any table."""
    return table.select(F.col(corpus).cast("string").alias("corpus_id"), F.col(doc).alias("doc_id"), F.col(text).alias("text"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports or scores written as JSON, by a schema that is given, not guessed."""
    return spark.read.schema(schema).json(path, multiLine=True)


def numbered(docs: DataFrame, by: str) -> DataFrame:
    """doc_id from 0 within each corpus, in the order of a column, counted in ranges of it."""
    return before(docs.drop("doc_id"), ["corpus_id"], [by], F.lit(1)).withColumnRenamed("before", "doc_id")
