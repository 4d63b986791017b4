"""Embedding of texts by a pluggable model, in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import embedding_text
from docloom.schemas import DIM, EmbeddingError

BATCH = 32


class Embedder(Protocol):
    dim: int
    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words and pairs of words to a unit vector; the same everywhere, and needs no model file."""

    name = "hashing"

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            w = re.findall(r"\w+", t.lower())
            for term in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]:
                h = zlib.crc32(term.encode())
                out[i, h % self.dim] += 1.0 if h & 0x80000000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embed(df: DataFrame, text: str = "content", out: str = "embedding", embedder: Embedder | None = None) -> DataFrame:
    """df with the vector of each text and embedding_error; a text that fails alone has a null vector and says why."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            vectors: list = []
            errors: list = []
            texts = s.fillna("").tolist()
            for at in range(0, len(texts), BATCH):
                part = texts[at : at + BATCH]
                try:
                    vectors += list(model.embed(part))
                    errors += [None] * len(part)
                except Exception:  # the batch is tried again one by one
                    for t in part:
                        try:
                            vectors.append(model.embed([t])[0])
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"vector": vectors, "error": errors})

    made = df.withColumn("_e", run(embedding_text(F.col(text))))
    return made.withColumns({out: F.col("_e.vector"), "embedding_error": F.col("_e.error")}).drop("_e")


def embed_query(query: str, embedder: Embedder | None = None) -> list[float]:
    """The vector of one text, by the same preparation."""
    t = query.strip()
    t = re.sub(r"\s+", " ", t[:1997] + "..." if len(t) > 2000 else t)
    v = (embedder or HashingEmbedder()).embed([t])[0]
    if not np.isfinite(v).all():
        raise EmbeddingError("the model gave no finite vector")
    return [float(x) for x in v]
