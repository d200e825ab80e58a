"""Embeddings of texts: batched, retried, checked; offline by hashing words."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..plans.shipping import ship

DIMENSION, BATCH, RETRIES, DELAY_S, MAX_CHARS = 1536, 32, 3, 0.75, 2000


def hashed(texts: list[str], dimension: int = DIMENSION) -> list[list[float]]:
    """A deterministic stand-in: signed word hashes, of length one."""
    from zlib import crc32

    out = np.zeros((len(texts), dimension), np.float32)
    for k, text in enumerate(texts):
        for word in text.lower().split():
            h = crc32(word.encode())
            out[k, h % dimension] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def embed(spark, text: Column, provider: Callable[[list[str]], list[list[float]]] = hashed, *, dimension: int = DIMENSION, batch: int = BATCH, retries: int = RETRIES, delay_s: float = DELAY_S) -> Column:
    """The provider's vectors in order; a batch that fails is asked again, each time after a longer wait."""
    ship(spark)

    @F.pandas_udf("array<float>")
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            texts, out = s.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                for attempt in range(retries):
                    try:
                        got = provider(part)
                        if len(got) != len(part) or any(len(v) != dimension for v in got):
                            raise ValueError("the provider gave another number or size of vectors")
                        break
                    except Exception:
                        if attempt + 1 == retries:
                            raise
                        time.sleep(delay_s * (attempt + 1))
                out += got
            yield pd.Series(out)

    return vectors(text)


def embed_query(spark, text: Column, provider=hashed, **kw) -> Column:
    """Questions: white space collapsed, at most MAX_CHARS characters."""
    return embed(spark, F.substring(collapse(F.coalesce(text, F.lit(""))), 1, MAX_CHARS), provider, delay_s=0.5, **kw)
