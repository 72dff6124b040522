"""SentencePiece encoding and decoding: Aho-Corasick over the pieces drives a single-pass Viterbi (see pieces.py).

Defined results: null and empty texts have no pieces and decode to the empty text; equal rows get equal
results; an empty table gives an empty result; other columns pass through `encoded` unless they bear its name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tandemlake.llm.common import free_name, small_batches, table, text_slices
from tandemlake.llm.pieces import PieceModel, Pieces, read_model

_ready: dict[PieceModel, Pieces] = {}


def ready(model: PieceModel) -> Pieces:
    """One for each worker process."""
    if model not in _ready:
        _ready.clear()
        _ready[model] = Pieces(model)
    return _ready[model]


def encoded(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with `ids` (array<int>) of each whole text, and on demand what they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ready(shared.value)
        for batch in batches:
            for part, _, _ in text_slices(batch, text):
                found = [pieces.packed(x or "") for x in part.column(text).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                part = part.append_column(ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32))))
                if decoded:
                    part = part.append_column(decoded, pa.array([pieces.decode(array("i", x).tolist()) for x in found], pa.string()))
                yield part

    own = small_batches(docs).drop(ids, *([decoded] if decoded else []))
    added = [StructField(ids, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])]
    return own.mapInArrow(run, StructType([*own.schema.fields, *added]))


def decoded(rows: DataFrame, model: PieceModel, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ready(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [None if x is None else pieces.decode(x) for x in part.column(ids).to_pylist()]
                yield part.append_column(text, pa.array(found, pa.string()))

    own = small_batches(rows).drop(text)
    return own.mapInArrow(run, StructType([*own.schema.fields, StructField(text, StringType())]))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model(spark)
    back = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded="decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their piece ids and number of pieces."""
    ids = free_name(docs, "ids")
    return encoded(docs, read_model(spark), ids=ids).withColumn(free_name(docs, "n_pieces"), F.size(ids).cast("long"))
