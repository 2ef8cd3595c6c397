"""Recognition on streams: each document is one row, so no state outlives a row and batch code runs unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossaflow.functions import text as T
from glossaflow.operators import recognize


def text_stream(spark: SparkSession, path: str, schema: str = "doc_id string, text string", form: str = "json", per_batch: int = 1000) -> DataFrame:
    """A stream of documents from files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(path)


def recognise_stream(texts: DataFrame, index: DataFrame, keys: list[str], normalisers: str = "lowercase", pattern: str = T.TOKEN) -> DataFrame:
    """The entities of a stream of texts (keys, text), as a stream: stateless, joined with a static dictionary only."""
    tokenised = recognize.token_spans(texts.select(*keys, "text"), pattern=pattern)
    return recognize.match(tokenised, index, keys, normalisers).drop("n_toks")


def start(entities: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream of entities into ``write`` (batch, number). A batch that is repeated has the same number, so writes can be made idempotent."""
    return entities.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
