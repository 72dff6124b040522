"""Shared pieces of the corpus operators: reading tables and vectorised word handling on Arrow buffers.

Texts stay in their Arrow buffers: words are found with byte-class tables and numbered by comparing their bytes
(Arrow's dictionary encoding), so no Python object is made per word and equal numbers mean equal words. UTF-8
continuation bytes never fall in an ASCII class, hence byte classes and character classes agree.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; bounds a Python worker's memory (longer texts go alone).
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to a Python worker at once; long texts would make larger batches too large.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to BATCH_ROWS from now on: plans read that setting when they run."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "0")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def byte_class(chars: bytes, invert: bool = False) -> np.ndarray:
    """256 flags: True for the given bytes (or for all others)."""
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return ~flags if invert else flags


#: Words of [^\x20\x09-\x0D]+.
SPACED_WORD = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d", invert=True)
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-case.
ALNUM_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Parts of a batch with the bytes of their texts and the offsets of each; null counts as empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : end + 1]
        yield batch.slice(at, end - at), data[own[0] : own[-1]], own - own[0]
        at = end


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the index of the first word of each text (length n + 1)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[1:] = is_word[data]
    first, last = inside[1:] & ~inside[:-1], inside[1:].copy()
    last[:-1] &= ~inside[2:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins + 1]  # a text never continues the one before
    ends = begins[1:] - 1
    last[ends] = inside[ends + 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of ascending ranges that do not overlap, none of them empty."""
    steps = np.zeros(len(data) + 1, np.int8)
    steps[starts] += 1
    steps[stops] -= 1
    inside = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


def numbered(values: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """A number for each value and the distinct values in the order of these numbers."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def numbered_runs(numbers: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` values (a power of two), by its first; equal numbers mean equal runs."""
    span = 1
    while span < size:
        if len(numbers) <= span:
            return numbers[:0]
        numbers = pd.factorize(numbers[:-span] * (int(numbers.max()) + 1) + numbers[span:])[0]
        span *= 2
    return numbers


#: Keys of the two halves of a word's digest, of 16 characters each.
DIGEST_KEYS = ("first of two keys", "second of the two")


def digests(values: pa.LargeBinaryArray) -> np.ndarray:
    """Two 64-bit SipHash values of each value, under keys of their own: equal on every machine, and without the structure
    by which texts can be made to collide."""
    words = np.empty(len(values), object)
    words[:] = values.to_pylist()
    return np.stack([pd.util.hash_array(words, hash_key=key[:16], categorize=False) for key in DIGEST_KEYS], 1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, by its first word; words are digests themselves."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0xD1342543DE82EF95)) + words[k : n + k]
    return mix(out)


def counts_between(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall in each range of offsets."""
    return np.diff(np.searchsorted(positions, offsets))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines must share. Where the session names none, one of our own, but only
    in local mode, where all of Spark runs in this process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later reads survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for rows with texts: unlike a checkpoint it is compressed."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a few short columns that are worth a task of their own.
TASK_ROWS = 1 << 16


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """df, which has about so many short rows, in tasks of TASK_ROWS: each task of a shuffle leaves files, however little it has."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def fair_share(rows: int) -> int:
    """Rows of one key that a task may get: at most 5,000 keys have more, so a list of these may be broadcast."""
    return max(256, rows // 5000)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], share: int, counts: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key. Keys with more than `share` rows on the left are dealt over
    several parts, for each of which right's row is repeated. counts: keys and n, the rows on the left."""
    hot = counts.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("hot_parts"))
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    parts = F.coalesce("hot_parts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("hot_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("hot_parts")
    every = right.join(F.broadcast(hot), keys, "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_parts")
    return dealt.join(every, [*keys, "hot_part"], how).drop("hot_part")


def sizes(df: DataFrame, *keys: str) -> DataFrame:
    """keys and n, the rows of each."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that (u, v) names: label is the least node it is connected with.

    Alternates large and small stars; each round is two aggregations with map-side minima and two joins on the edges;
    hubs are dealt over several tasks. The number of rounds grows with the logarithm of the longest path.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = lambda e: e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    state = lambda e: low(both(e)).agg(F.sum("n"), F.max("n")).first()
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(narrowed(edges, edges.count()))
    while before[0]:
        share, few = fair_share(before[0]), lambda df: narrowed(df, before[0])  # noqa: B023
        edges = few(edges)
        meet = lambda e, least: spread_join(e, least.drop("n"), ["u"], share, least) if before[1] > share else e.join(least.drop("n"), "u")  # noqa: B023, E731
        near = both(edges)
        large = meet(near.filter("v > u"), low(near).withColumn("m", F.least("u", "m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(few(large.filter("u <> v")).distinct())
        least = few(low(large))
        small = meet(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        last = edges
        small = few(small.union(least.select("u", F.col("m").alias("v"))))
        edges = few(cut(few(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())))
        after = state(edges)
        if after == before and not edges.join(last, ["u", "v"], "left_anti").limit(1).count():
            break  # as many edges as before, and no other
        before = after
    own = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(own)
