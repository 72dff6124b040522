"""Token counts without tokens: the dynamic programme of pieces.py carries, for each place of a text, only the
best score and its number of pieces, under the tokenizer's own rule on ties.

Defined results: null and empty texts count 0 with score 0; equal rows get equal results; an empty table gives
an empty result; other columns pass through `counted` unless they bear the names of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tandemlake.llm.common import small_batches, table, text_slices
from tandemlake.llm.op2_sentencepiece import ready
from tandemlake.llm.pieces import PieceModel, read_model


def counted(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """docs with n_tokens (long) and score (double, of the best segmentation) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ready(shared.value)
        for batch in batches:
            for part, _, _ in text_slices(batch, text):
                found = [pieces.count(x or "") for x in part.column(text).to_pylist()]
                part = part.append_column("n_tokens", pa.array([n for n, _ in found], pa.int64()))
                yield part.append_column("score", pa.array([s for _, s in found], pa.float64()))

    own = small_batches(docs).drop("n_tokens", "score")
    return own.mapInArrow(run, StructType([*own.schema.fields, StructField("n_tokens", LongType()), StructField("score", DoubleType())]))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, read_model(spark)).select("doc_id", "n_tokens", "score")
