"""Vector functions on array columns."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products over the shorter length."""
    a, b = _col(a), _col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, *, same_length: bool = False) -> Column:
    """Cosine; 0 for a zero vector, and with ``same_length`` also for an empty one or other lengths (F-S5, F-S6)."""
    a, b = _col(a), _col(b)
    na, nb = norm(a), norm(b)
    ok = (na > 0) & (nb > 0)
    if same_length:
        ok = ok & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def l2_normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays (F-S4)."""
    a = _col(a)
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def hash_features(words: list[str], dims: int) -> list[float]:
    """Signed feature hashing of words and bigrams with log counts, as a unit vector (F-S3)."""
    out = np.zeros(dims)
    for feature, n in Counter([*words, *(f"{a}_{b}" for a, b in zip(words, words[1:]))]).items():
        raw = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        out[raw % dims] += (1.0 if raw >> 63 else -1.0) * (1.0 + math.log(n))
    size = math.sqrt(float(out @ out))
    return (out / size if size > 0 else out).tolist()


def hash_embed(tokens: Column | str, dims: int = 768) -> Column:
    """Feature-hash embedding of a column of word arrays, as a Pandas UDF; null or no words give zeros."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(col: pd.Series) -> pd.Series:
        return col.map(lambda w: hash_features([] if w is None else list(w), dims))

    return embed(_col(tokens))


@F.pandas_udf(T.StringType())
def blake_digest(text: pd.Series) -> pd.Series:
    """Digest of three bytes of a text (F-K2)."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=3).hexdigest())


@F.pandas_udf(T.DoubleType())
def mean_abs_delta(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean absolute difference of two byte buffers of equal length, over 255 (AG11); null if they differ in length or are empty."""

    def one(x: bytes | None, y: bytes | None) -> float | None:
        if not x or not y or len(x) != len(y):
            return None
        return float(np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).mean() / 255)

    return pd.Series([one(x, y) for x, y in zip(a, b)])
