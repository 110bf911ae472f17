"""Embedding columns: any callable over texts, and a deterministic one for tests."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def hashed(texts: list[str], width: int = 8) -> list[list[float]]:
    """A bag of words by FNV-1a modulo ``width``, of length 1; no words: the first axis."""
    out = []
    for text in texts:
        v = np.zeros(width)
        for word in _WORD.findall(text.lower()):
            h = 2166136261
            for b in word.encode():
                h = (h ^ b) * 16777619 & 0xFFFFFFFF
            v[h % width] += 1
        if not v.any():
            v[0] = 1
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def embed(texts: Column, model: Callable[[list[str]], list[list[float]]] = hashed, width: int = 8) -> Column:
    """An Arrow-batched column of vectors in the order of the texts; null for null. The model
    isn't called for an empty batch, and a wrong number or width of vectors is refused."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        known = [v for v in values if v is not None]
        made = iter(model(known) if known else [])
        out = [None if v is None else next(made, None) for v in values]
        if next(made, None) is not None or any(v is not None and (o is None or len(o) != width) for v, o in zip(values, out)):
            raise ValueError("the model returned a wrong number or width of vectors")
        return pd.Series(out)

    return run(texts)


def with_embeddings(chunks: DataFrame, model=hashed, width: int = 8) -> DataFrame:
    return chunks.withColumn("embedding", embed(F.col("text"), model, width))
