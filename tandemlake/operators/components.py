"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder in spark.checkpoint.dir, which all machines must share. Where the session
    names none, to one of our own, but only in local mode, where all of Spark runs in this process."""
    _shared(df.sparkSession)
    return df.checkpoint()


def _shared(spark: SparkSession) -> str:
    if not spark.sparkContext.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="stages-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as kept has it, in columns and compressed: for large tables."""
    path = f"{_shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as shuffles have: rows that are small but costly must not be coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def computed(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with a costly column, computed here and once: as what is exploded, it isn't computed again for filters on it, which Spark would
    otherwise move before the step that dealt the rows."""
    return df.select("*", F.explode(F.array(column)).alias(name))


#: Rows of a table that one task sorts or groups, about.
TASK_ROWS = 500_000


def in_parts(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys into parts of about TASK_ROWS of its `rows`, and one for each core at least: what a task sorts doesn't grow with the table."""
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], share: int) -> DataFrame:
    """left joined with right, which has one row for each key. A key with more than `share` rows on the left (and a 5,000th of
    all, so that the list of these can be broadcast) is dealt over several parts, to each of which right's row goes."""
    counts = kept(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    share = max(share, (counts.agg(F.sum("n")).first()[0] or 0) // 5000)
    hot = F.broadcast(counts.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("hot_parts")))
    parts = F.coalesce("hot_parts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("hot_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("hot_parts")
    every = right.join(hot, keys, "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_parts")
    return spread(dealt, *keys, "hot_part").join(every, [*keys, "hot_part"]).drop("hot_part")


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of (u, v): the least node of its component.

    Each round takes the least label among neighbours and then the label of that label, so rounds grow with the
    logarithm of the longest path; all steps are equi-joins and map-side minima.
    """
    both = kept(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        step = kept(step.join(jump, step["next"] == jump["via"], "left").select("node", "label", F.least("next", F.coalesce("beyond", "next")).alias("next")))
        changed = step.filter("label <> next").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
