"""From raw documents to piece ids: quality rules, near-duplicate removal, benchmark decontamination, masking of
personal data, SentencePiece encoding. Part of the corpus operators (tandemlake.llm).

Defined results: null and empty texts have too few words for the first stage and go; of repeated rows and of documents
that are near copies one stays, whatever their ids (a null id comes last); documents that are benchmark passages throughout go;
further columns, also under names that stages use, pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandemlake.llm import op2_sentencepiece, op3_pii, op4_decontamination, op5_quality_rules, op10_minhash_dedup
from tandemlake.llm.common import shared_folder, table

#: (name, function of the session, the documents that the stage before kept, and the folder of the tables). All but the
#: last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", op5_quality_rules.stage),
    ("near_duplicates", op10_minhash_dedup.stage),
    ("decontamination", op4_decontamination.stage),
    ("personal_data", op3_pii.stage),
    ("piece_encoding", op2_sentencepiece.stage),
]

#: SQL has no signature, index or segmentation; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each result but the last is written to the session's shared folder, so
    that a lost executor costs one stage's tasks at most; the tables stay there until the folder's owner clears it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
