"""Embedding nodes with an exchangeable encoder; offline, a hashed random projection."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.vectors import check_embeddings
from weftline.session import ship


class HashEncoder:
    """Texts as normalised sums of hashed word vectors: deterministic, no model, no network."""

    def __init__(self, dim: int = 32):
        self.dim = dim
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.stack([sum((self._word(w) for w in t.lower().split()), np.zeros(self.dim)) for t in texts])

    def _word(self, w: str) -> np.ndarray:
        if w not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            seed = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            self.known[w] = np.random.default_rng(seed).standard_normal(self.dim)
        return self.known[w]


def map_embeddings(df: DataFrame, column: str, encoder: Callable[[list[str]], np.ndarray], dim: int, output: str = "embedding", error_output: str = "error", batch: int = 64) -> DataFrame:
    """Add the vector of each text, checked and of length one; an unusable input gives null and a reason.

    The encoder is called with batches of at most ``batch`` texts.
    """
    ship(df.sparkSession)

    @F.arrow_udf(returnType="array<float>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            values = texts.to_pylist()
            out: list = [None] * len(values)
            full = [i for i, t in enumerate(values) if t is not None and t.strip()]
            for a in range(0, len(full), batch):
                at = full[a : a + batch]
                for i, v in zip(at, encoder([values[i] for i in at])):
                    out[i] = np.asarray(v, dtype=np.float32)
            yield pa.array(out, pa.list_(pa.float32()))

    checked = check_embeddings(df.withColumn(output, encode(F.col(column))), output, dim)
    reason = F.when(F.col(column).isNull() | (F.trim(F.col(column)) == ""), "no text").otherwise(F.col("error"))
    return checked.withColumn("error", reason).withColumnRenamed("error", error_output)


def document_spans(df: DataFrame, column: str, words: int = 200, overlap: int = 20) -> DataFrame:
    """Windows of ``words`` words with ``overlap`` in common: span_index and span."""
    if words <= overlap or overlap < 0:
        raise ValueError("overlap must be smaller than the window")
    tokens = F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("__w") - overlap - 1), F.lit(words - overlap))
    spans = F.transform(starts, lambda s: F.array_join(F.slice("__w", s + 1, words), " "))
    return df.withColumn("__w", tokens).where(F.size("__w") > 0).select("*", F.posexplode(spans).alias("span_index", "span")).drop("__w")


def verify_objects(df: DataFrame, content: str, digest: str, max_bytes: int = 8 << 20, output: str = "status") -> DataFrame:
    """Whether bytes have the named SHA-256 and an allowed size: ok, missing, too_large or sha256_mismatch."""
    c = F.col(content)
    value = (
        F.when(c.isNull(), "missing").when(F.octet_length(c) > max_bytes, "too_large").when(F.sha2(c, 256) != F.lower(F.col(digest)), "sha256_mismatch").otherwise("ok")
    )
    return df.withColumn(output, value)


def image_preflight(size: str, mime: str, width: str, height: str, max_bytes: int, mimes: list[str], min_side: int = 0, min_pixels: int = 0):
    """Why an announced image is not wanted, or null: an expression over its declared size, type and dimensions.

    Parameters of a type do not count, and ``application/octet-stream`` says nothing about the content.
    """
    s, m, w, h = F.col(size), F.lower(F.trim(F.split(F.col(mime), ";")[0])), F.col(width), F.col(height)
    return (
        F.when(s > max_bytes, "declared_size")
        .when(m.isNotNull() & ~m.isin(["application/octet-stream", *[x.lower() for x in mimes]]), "mime")
        .when(F.least(w, h) < min_side, "min_side")
        .when(w * h < min_pixels, "min_pixels")
    )
