"""Running a model over benchmark rows: batches go to a function that each Python worker builds once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Answer = Callable[[list[str]], list[str]]


def infer(benchmark: DataFrame, build: Callable[[], Answer], question: str = "question") -> DataFrame:
    """benchmark with prediction. build() makes the model; it runs on the executors, once a partition."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in benchmark.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = build()
        for b in batches:
            yield b.assign(prediction=answer(b[question].fillna("").tolist()))

    return benchmark.mapInPandas(run, f"{fields}, prediction string")
