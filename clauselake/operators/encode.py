"""Text encoders behind one interface. A model is made once per worker, equal texts are encoded once, and batches hold texts of like length.

The defaults need no model: hashed words, and counts of word lengths, which SQL can state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A batch of texts to a matrix of rows.
Encoder = Callable[[list[str]], np.ndarray]
#: Makes an encoder; called once per task that encodes, on the executor.
Loader = Callable[[], Encoder]
#: Most texts, and most characters (longest text times texts), of a batch that an encoder gets.
TEXTS, CHARACTERS = 256, 400_000
#: Texts of an Arrow batch, which a worker holds several times.
RECORDS = 1000


def hashed_words(dim: int = 64) -> Encoder:
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out

    return encode


def word_lengths(dim: int = 16) -> Encoder:
    """How many words have 1, 2, ... dim - 1 characters, and dim or more; words are separated by spaces."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([np.bincount([min(len(w), dim) - 1 for w in t.split(" ") if w], minlength=dim) for t in texts], dtype=np.float64).reshape(len(texts), dim)

    return encode


def batches_of(lengths: np.ndarray, texts: int = TEXTS, characters: int = CHARACTERS) -> Iterator[np.ndarray]:
    """Places of texts, shortest first, in batches that a padded matrix of the longest one bounds; a longer text stands alone."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or i - at >= texts or (i - at + 1) * lengths[order[i]] > characters:
            yield order[at:i]
            at = i


def _encoded(load: Loader, normalise: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for b in parts:
            encoder = encoder or load()
            lengths, texts, out = b["t"].str.len().to_numpy(), b["t"].to_numpy(), [None] * len(b)
            for at in batches_of(lengths):
                m = np.asarray(encoder(list(texts[at])), dtype=np.float64)
                if normalise:
                    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
                for i, v in zip(at, m.astype(np.float32), strict=True):
                    out[i] = v
            yield pd.DataFrame({"h": b["h"], "v": out})

    return run


def embed(rows: DataFrame, encoder: Encoder | None = None, text: str = "text", out: str = "v", normalise: bool = True, load: Loader | None = None) -> DataFrame:
    """rows plus an array<float> of each text, by an encoder or by one that `load` makes once per task. A null text is empty. Texts are told
    apart by their SHA-256: each distinct one moves and is encoded once, and what comes back to the rows is its vector."""
    load = load or (lambda: encoder)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"  # plans read it late, so it stays
    rows.sparkSession.conf.set(key, str(min(RECORDS, int(rows.sparkSession.conf.get(key)))))
    keyed = rows.withColumn("__h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    once = keyed.groupBy(F.col("__h").alias("h")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    vectors = once.mapInPandas(_encoded(load, normalise), "h string, v array<float>").select(F.col("h").alias("__e"), F.col("v").alias(out))
    return keyed.join(vectors, F.col("__h") == F.col("__e")).select(*[F.col(f"`{c}`") for c in rows.columns], out)
