"""Vectors for articles as they arrive; what of a reply is shown is in `replies`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .replies import shown_answers  # noqa: F401

#: Texts a provider is given at once.
BATCH = 16


def embedded(articles: DataFrame, embed: Callable[[list[str]], list[list[float]]], dims: int) -> DataFrame:
    """id and embedding of articles(id, text), by a provider that is given BATCH texts at a time; a reply of another size, or
    a vector of another length, fails the task, which Spark tries again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                vectors = embed(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dims for v in vectors):
                    raise ValueError("the provider's reply does not fit what it was asked")
                yield pd.DataFrame({"id": part["id"], "embedding": vectors})

    return articles.select("id", "text").mapInPandas(run, "id long, embedding array<double>")


def vectorise_stream(articles: DataFrame, embed: Callable[[list[str]], list[list[float]]], dims: int, out: str, checkpoint: str) -> StreamingQuery:
    """Write vectors of the articles of a stream that lack one. Each batch overwrites its own folder, so one that is run
    again leaves the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        waiting = batch.where(F.col("embedding").isNull())
        embedded(waiting, embed, dims).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
