"""Vectors of texts, by which a shortlist is reranked."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import index as I
from quernstone.operators.retrieve import DIGITS, cosine

DIMENSIONS = 384


class Embedder(Protocol):
    """embed() gives a vector for each text, or None if there is no model. It runs in the tasks
    that hold the texts, so load() is called once for each worker."""

    def load(self) -> Callable[[list[str]], np.ndarray] | None: ...


class HashingEmbedder:
    """The offline default: words and pairs of words, folded, hashed to signed dimensions."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def load(self) -> Callable[[list[str]], np.ndarray]:
        n = self.dimensions

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), n), np.float32)
            for k, text in enumerate(texts):
                words = text.lower().encode().split()
                grams = [*words, *(a + b" " + b for a, b in zip(words, words[1:], strict=False))]
                h = np.array([zlib.crc32(g) for g in grams], np.int64)
                np.add.at(out[k], h % n, np.where(h >> 20 & 1, 1.0, -1.0))
            return out

        return embed


def embedded(texts: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """texts with their vector: null for a null text, and throughout where the model is not
    available or fails, which stays so for the worker."""

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            embed = embedder.load()
        except Exception:  # without a model the order of ranks stays
            embed = None
        for b in batches:
            out: list = [None] * len(b)
            known = np.flatnonzero(b.notna())
            if embed is not None and len(known):
                try:
                    for k, v in zip(known.tolist(), np.asarray(embed(b.iloc[known].tolist()), np.float32), strict=True):
                        out[k] = v
                except Exception:  # as above
                    embed = None
            yield pd.Series(out, index=b.index, dtype=object)

    return texts.withColumn("vector", vector(F.col(text)))


def similarities(ranked: DataFrame, chunks: DataFrame, fields: DataFrame, embedder: Embedder) -> DataFrame:
    """corpus_id, field, doc_id, chunk_idx, similarity (cosine of the query's and the window's
    vector; null without vectors) of a shortlist: only its windows are embedded, each once."""
    asked = embedded(fields.select("field", "query"), embedder, "query").select("field", F.col("vector").alias("asked"))
    wanted = ranked.groupBy(*I.KEY).agg(F.collect_list("field").alias("fields"))
    texts = chunks.join(wanted, I.KEY).select(*I.KEY, "fields", I.chunk_text().alias("text"))
    each = embedded(texts, embedder).select(*I.KEY, "vector", F.explode("fields").alias("field"))
    return each.join(F.broadcast(asked), "field").select("corpus_id", "field", "doc_id", "chunk_idx", F.round(cosine(F.col("asked"), F.col("vector")), DIGITS).alias("similarity"))
