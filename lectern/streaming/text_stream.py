"""The normalisation and chunking of streams: stateless maps that run unchanged on a streaming table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.chunking import chunk_documents
from lectern.options import TextOptions


def chunk_stream(docs: DataFrame, o: TextOptions | None = None) -> DataFrame:
    """Chunks of a stream of doc_id, text; append mode, no state."""
    return chunk_documents(docs, o)


def normalized_stream(docs: DataFrame, o: TextOptions | None = None) -> DataFrame:
    """doc_id and normalised text of a stream."""
    return docs.select("doc_id", T.prepared(F.col("text"), o or TextOptions()).alias("text"))
