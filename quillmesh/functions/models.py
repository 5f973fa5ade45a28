"""Where models come in: encoders, recognisers and language models are callables over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64, unit: bool = False) -> Column:
    """Vectors of a text column, `batch` texts at a time. `load` is called once a task and gives a function from texts to
    vectors (truncation and pooling are the model's own); null counts as the empty text. unit: vectors of length one."""

    def scaled(v: list[float]) -> list[float]:
        size = sum(x * x for x in v) ** 0.5 if unit else 0
        return [x / size for x in v] if size else v

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            texts = b.fillna("").tolist()
            yield pd.Series([scaled(list(map(float, v))) for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])], dtype=object)

    return run(text)


def ask(rows: DataFrame, prompt: str, load: Callable[[], Callable[[str], str | None]], answer: str = "raw") -> DataFrame:
    """Adds a language model's answers to prompts; an exception of the model gives null, for the caller's error column."""
    schema = rows.withColumn(answer, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(p: str | None) -> str | None:
            try:
                return None if p is None else model(p)
            except Exception:  # noqa: BLE001
                return None

        for b in batches:
            yield b.assign(**{answer: [one(p) for p in b[prompt]]})

    return rows.mapInPandas(run, schema)


def recognise(text: Column, load: Callable[[], Callable[[list[str]], list[list[str]]]], batch: int = 64) -> Column:
    """Names that a recogniser finds in each text, `batch` texts at a time; null counts as the empty text."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            texts = b.fillna("").tolist()
            yield pd.Series([list(x) for i in range(0, len(texts), batch) for x in model(texts[i : i + batch])], dtype=object)

    return run(text)


def ask_twice(rows: DataFrame, prompt: str, load: Callable[[], Callable[[str, bool], tuple[str | None, int]]], answer: str = "raw", tokens: str = "tokens") -> DataFrame:
    """Adds answers and tokens: load() gives a function from (prompt, may it think?) to (text, tokens). An empty answer is
    asked for once more without thinking; tokens of both calls add up. A null prompt is not asked (null, 0 tokens), an
    exception gives null."""
    schema = rows.withColumn(answer, F.lit(None).cast("string")).withColumn(tokens, F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(p: str | None) -> tuple[str | None, int]:
            text, spent = None, 0
            for think in (True, False):
                if p is None or text:
                    break
                try:
                    text, used = model(p, think)
                    spent += used
                except Exception:  # noqa: BLE001
                    text = None
            return text, spent

        for b in batches:
            said = [one(p) for p in b[prompt]]
            yield b.assign(**{answer: [t for t, _ in said], tokens: [n for _, n in said]})

    return rows.mapInPandas(run, schema)
