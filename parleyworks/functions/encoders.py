"""Texts to vectors without a model: a stand-in for tests and offline work, and the form of an injected encoder."""

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def hashed_encoder(dim: int = 384) -> Callable[[str], Column]:
    """A function from a text column to unit vectors: signed hashes of words, weighted by 1 + log count. Null and wordless texts give null."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float] | None:
            words = _WORD.findall(text.lower()) if text else []
            if not words:
                return None
            v = np.zeros(dim, dtype=np.float32)
            for w, n in pd.Series(words).value_counts().items():
                h = zlib.crc32(w.encode())
                v[h % dim] += (1 if h >> 31 else -1) * (1 + np.log(n))
            size = float(np.sqrt((v * v).sum()))
            return (v / size).tolist() if size else None

        return texts.map(one)

    return lambda c: encode(F.col(c) if isinstance(c, str) else c)


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "", cut: int = 2_000) -> Callable[[str], Column]:
    """An encoder around a model: ``load`` runs once per Python worker and returns a function from texts to a matrix.

    Texts get the prefix and are cut to the model's limit; rows of the matrix are brought to unit length.
    """


    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            m = np.asarray(model([prefix + (t or "")[:cut] for t in texts]), dtype=np.float32)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            yield pd.Series([row.tolist() for row in m / np.where(norm > 0, norm, 1)])

    run = F.pandas_udf(encode, "array<float>")
    return lambda c: run(F.col(c) if isinstance(c, str) else c)
