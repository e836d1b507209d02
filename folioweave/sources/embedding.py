"""Text to unit vectors with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSIONS = 384
BATCH = 32


def embed_texts(docs: DataFrame, key: str, text: str = "text", dim: int = DIMENSIONS) -> DataFrame:
    """Offline default: hashed word and word-pair counts scaled to length one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    base = docs.select(key, words.alias("_w"))
    pairs = NGram(n=2, inputCol="_w", outputCol="_p").transform(base)
    terms = pairs.withColumn("_t", F.concat("_w", "_p"))
    hashed = HashingTF(numFeatures=dim, inputCol="_t", outputCol="_h").transform(terms)
    scaled = Normalizer(p=2.0, inputCol="_h", outputCol="_u").transform(hashed)
    return scaled.select(key, vector_to_array("_u", "float32").alias("vector"))


def embed_with(
    docs: DataFrame, key: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text"
) -> DataFrame:
    """Vectors of a caller's model; the model is made once per task.

    A text the encoder cannot handle keeps its row with a null vector.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_encoder()
        for texts in batches:
            out: list = []
            for start in range(0, len(texts), BATCH):
                part = [t or "" for t in texts.iloc[start : start + BATCH]]
                data = np.asarray(model(part), dtype=np.float32)
                length = np.linalg.norm(data, axis=1, keepdims=True)
                data = np.divide(data, length, out=np.zeros_like(data), where=length > 0)
                out.extend(row if np.isfinite(row).all() else None for row in data)
            yield pd.Series(out)

    return docs.select(key, encode(F.col(text)).alias("vector"))
