"""Models as pluggable functions: encoders, pair scorers and text generators, made once for each partition."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def encode(df: DataFrame, text_col: str, encoder: Callable[[], Callable[[list[str]], tuple[list, list]]], batch: int = 64) -> DataFrame:
    """df with dense (array<float>) and sparse (map<int,double>); rows of a failed batch keep nulls.

    `encoder()` makes the model; called with texts it returns their dense and sparse vectors.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("dense", T.ArrayType(T.FloatType())), T.StructField("sparse", T.MapType(T.IntegerType(), T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for f in frames:
            dense, sparse = [], []
            for at in range(0, len(f), batch):
                part = f[text_col].iloc[at : at + batch].fillna("").tolist()
                try:
                    d, s = model(part)
                except Exception:  # a model's failure costs the vectors of its batch, not the rows
                    d, s = [None] * len(part), [None] * len(part)
                dense += d
                sparse += s
            yield f.assign(dense=dense, sparse=sparse)

    return df.mapInPandas(run, schema)


def score_pairs(df: DataFrame, scorer: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query_col: str = "query", content_col: str = "content", batch: int = 64) -> DataFrame:
    """df with score (double) of each (query, content)."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "score"], T.StructField("score", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for f in frames:
            pairs = list(zip(f[query_col].fillna(""), f[content_col].fillna(""), strict=True))
            yield f.assign(score=[float(x) for at in range(0, len(pairs), batch) for x in model(pairs[at : at + batch])])

    return df.drop("score").mapInPandas(run, schema)


def generate(df: DataFrame, prompt_col: str, fn: Callable[[], Callable[[str], str]], retries: int = 3, wait: float = 0.0, out: str = "response") -> DataFrame:
    """df with the generated text; tried up to `retries` times with growing waits, empty where all fail."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fn()

        def answer(prompt: str) -> str:
            for n in range(retries):
                try:
                    return model(prompt) or ""
                except Exception:
                    time.sleep(wait * 2**n)
            return ""

        for f in frames:
            yield f.assign(**{out: [answer(p) if isinstance(p, str) else "" for p in f[prompt_col]]})

    return df.mapInPandas(run, schema)
