"""Line dedup: lines that many documents share lose all their occurrences.

1. Each document's distinct line keys, as 128-bit digests, are counted over all documents by an aggregation with map-side
   sums.
2. The distinct digests are dealt into shards of about SHARD_KEYS. Each shard becomes one row: a minimal perfect hash, a
   32-bit fingerprint and the count of each key in arrays of the narrowest type.
3. Digests of a document's lines visit the arrays of their shard, which stand before them in the same sorted stream, so a
   task holds one shard at a time and no line is joined with a line. A shard with more than its share of visitors (it has
   a line of a third of all documents, say) is dealt over several tasks, each with the arrays.
4. Numbers of the lines to drop go back to their document, which is found by its id and text.

A row is a document: of equal rows each counts. The digests are keyed SipHash values (common.digests); two lines that
agree in 128 bits would be one.

Defined results: a null or empty text is one empty line; keys shorter than `least_chars` are never dropped; what is left of a
text without lines to keep is the empty text; equal rows get equal results; a null doc_id takes part; an empty table
gives an empty result; other columns pass through unless they bear the names of the operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tandemlake.llm.common import cut, digests, fair_share, free_name, mix, numbered, sizes, small_batches, spread_join, table, text_slices, written

#: Distinct keys of one shard, about: its arrays take some six bytes a key. A task gets so many visitors with one copy of them.
SHARD_KEYS = 1 << 14
SHARD_VISITORS = 1 << 16
#: Bits of a level for each key that is still without a place.
ROOM = 2
WHITE = " \t\n\x0b\x0c\r"


class PerfectHash:
    """Places 0 to n-1 for n keys of 2 x 64 bits. In each level a key has one bit; keys that are alone on theirs stay, the
    others go on to the next level. A key's place is the number of set bits before its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x, dtype=np.int32) - 1 for x in levels]

    @staticmethod
    def spots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + mix(b + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(a):
            size = ROOM * len(a) + 7
            at = cls.spots(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            a, b = a[~alone[at]], b[~alone[at]]
        return cls(levels)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; for keys that it was not built for, any place or -1."""
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for k, bits in enumerate(self.levels):
            at = self.spots(a[open_], b[open_], k, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out


class LineIndex:
    """Counts by key: a perfect hash, fingerprints and counts."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.hashed, self.prints, self.counts = hashed, prints, counts

    @staticmethod
    def print_of(b: np.ndarray) -> np.ndarray:
        return (b >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> LineIndex:
        hashed = PerfectHash.of(a, b)
        at = hashed.places(a, b)
        prints, own = np.zeros(len(a), np.uint32), np.zeros(len(a), np.min_scalar_type(int(counts.max(initial=0))))
        prints[at], own[at] = cls.print_of(b), counts
        return cls(hashed, prints, own)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for keys whose fingerprint it does not have."""
        at = self.hashed.places(a, b)
        out = np.zeros(len(a), np.int64)
        known = np.flatnonzero(at >= 0)
        known = known[self.prints[at[known]] == self.print_of(b[known])]
        out[known] = self.counts[at[known]]
        return out

    def packed(self) -> bytes:
        head = np.array([len(self.counts), self.counts.itemsize, *map(len, self.hashed.levels)], np.int64)
        return b"".join((np.int64(len(head)).tobytes(), head.tobytes(), self.prints.tobytes(), self.counts.tobytes(), *(np.packbits(x).tobytes() for x in self.hashed.levels)))

    @classmethod
    def unpacked(cls, blob: bytes) -> LineIndex:
        size = int(np.frombuffer(blob, np.int64, 1)[0])
        n, width, *level_sizes = np.frombuffer(blob, np.int64, size, 8).tolist()
        at = 8 * (size + 1)
        prints, counts = np.frombuffer(blob, np.uint32, n, at), np.frombuffer(blob, f"u{width}", n, at + 4 * n)
        at += (4 + width) * n
        levels = []
        for bits in level_sizes:
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, (bits + 7) // 8, at), count=bits).astype(bool))
            at += (bits + 7) // 8
        return cls(PerfectHash(levels), prints, counts)


def first_lines(texts: pa.Array, least_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """Of whole texts: their lines (a list for each), for each line the number within its text of the first line with its
    key (-1 for keys under least_chars), those flat line numbers that are first, and the keys of these."""
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    keys = pc.ascii_lower(pc.utf8_trim(flat, WHITE))
    per_text = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.repeat(np.cumsum(per_text) - per_text, per_text)
    text = np.repeat(np.arange(len(per_text)), per_text)
    numbers, _ = numbered(keys.cast(pa.large_binary()))
    _, first, group = np.unique(numbers * len(per_text) + text, return_index=True, return_inverse=True)
    counted = pc.greater_equal(pc.utf8_length(keys), least_chars).to_numpy(zero_copy_only=False)
    own = np.where(counted, first[group] - begin, -1)
    firsts = np.sort(first[counted[first]])
    return lines, own, firsts, keys.take(pa.array(firsts)).cast(pa.large_binary())


def _digests(keys: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    numbers, distinct = numbered(keys)
    both = digests(distinct)[numbers]
    return both[:, 0], both[:, 1]


def _counted(batches: Iterator[pa.RecordBatch], text: str, least_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in text_slices(batch, text):
            *_, keys = first_lines(part.column(text).fill_null("").cast(pa.large_string()), least_chars)
            a, b = _digests(keys)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _visitors(batches: Iterator[pa.RecordBatch], text: str, least_chars: int) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int, bool]] = set()  # a task's documents; a copy has the result of the first
    for batch in batches:
        for part, _, _ in text_slices(batch, text):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("i", "t", "no_id")), strict=True))
            new = []
            for k, row in enumerate(rows):
                if row not in seen:
                    seen.add(row)
                    new.append(k)
            part = part.take(pa.array(new, pa.int64()))
            lines, _, firsts, keys = first_lines(part.column(text).fill_null("").cast(pa.large_string()), least_chars)
            a, b = _digests(keys)
            ends = np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            doc = np.searchsorted(ends, firsts, "right")
            line = firsts - np.concatenate(([0], ends))[doc]
            ids = [part.column(c).take(pa.array(doc)) for c in ("i", "t", "no_id")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(line.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["i", "t", "no_id", "line", "a", "b"])


def _built(rows: pa.Table) -> pa.Table:
    a, b = (rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    counts = rows.column("n").to_numpy()
    blob = LineIndex.of(a, b, counts).packed()
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "visitors": pa.array([int(counts.sum())], pa.int64()), "arrays": pa.array([blob], pa.binary())})


def _probed(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of one shard follow each other, its arrays first."""
    index: LineIndex | None = None
    for batch in batches:
        has = batch.column("arrays").is_valid().to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(has).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            if has[begin]:
                index = LineIndex.unpacked(batch.column("arrays")[begin].as_py())
                begin += 1
            own = batch.slice(begin, end - begin)
            if not own.num_rows:
                continue
            if index is None:
                raise ValueError("lines came before the arrays of their shard")
            a, b = (own.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b"))
            hit = np.flatnonzero(index.lookup(a, b) >= least_docs)
            if len(hit):
                yield own.take(pa.array(hit)).select(["i", "t", "no_id", "line"])


def line_index(docs: DataFrame, text: str = "text", least_chars: int = 1) -> DataFrame:
    """(shard, visitors, arrays), a row for each shard of the distinct line digests of all rows of docs; visitors is the sum of
    their counts. A digest's shard is its first half modulo the number of shards."""
    lines = small_batches(docs).select(text).mapInArrow(lambda x: _counted(x, text, least_chars), "a long, b long")
    counts = cut(sizes(lines, "a", "b"))
    shards = max(1, math.ceil(counts.count() / SHARD_KEYS))
    return counts.withColumn("shard", F.pmod("a", F.lit(shards))).groupBy("shard").applyInArrow(_built, "shard long, visitors long, arrays binary")


def shared_lines(docs: DataFrame, text: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(i, t, no_id, lines): for each document, found by these three (see _identity), the numbers of the first lines with
    keys that least_docs rows or more have. docs needs doc_id."""
    index = written(line_index(docs, text, least_chars), "line-index")
    shards, total = index.agg(F.count(F.lit(1)), F.sum("visitors")).first()
    named = small_batches(docs).select(*_identity(text), text)
    lines = named.mapInArrow(lambda x: _visitors(x, text, least_chars), "i long, t long, no_id boolean, line int, a long, b long")
    lines = lines.withColumn("shard", F.pmod("a", F.lit(max(1, shards))))
    share = max(SHARD_VISITORS, fair_share(total or 0))
    hot = F.broadcast(index.filter(F.col("visitors") > share).select("shard", F.ceil(F.col("visitors") / share).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = lines.join(hot, "shard", "left").withColumn("part", F.pmod(F.xxhash64("i", "t", "line"), parts).cast("int")).drop("parts")
    every = index.select("shard", "arrays").join(hot, "shard", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    stream = dealt.unionByName(every, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("arrays").isNull())
    found = stream.mapInArrow(lambda x: _probed(x, least_docs), "i long, t long, no_id boolean, line int")
    return found.groupBy("i", "t", "no_id").agg(F.collect_set("line").alias("lines"))


def _identity(text: str) -> list[Column]:
    """What a document is found by: its id, whether that is null, and a hash of its text."""
    return [F.coalesce("doc_id", F.lit(0)).cast("long").alias("i"), F.xxhash64(text).alias("t"), F.col("doc_id").isNull().alias("no_id")]


def without_shared_lines(docs: DataFrame, text: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """docs with n_lines (before), n_dropped and `kept`, the text without the lines whose key least_docs rows or more have."""
    found = shared_lines(docs, text, least_docs, least_chars)
    own = [c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped", "kept"}]
    source = docs.select(*own) if text in own else docs.select(*own, text)
    keys = {name: free_name(source, f"_{name}") for name in ("i", "t", "no_id", "lines")}
    named = source.withColumns({keys[name]: c for name, c in zip(("i", "t", "no_id"), _identity(text), strict=True)})
    for name, free in keys.items():
        found = found.withColumnRenamed(name, free)
    by = [keys[name] for name in ("i", "t", "no_id")]
    counts = sizes(named, *by)
    met = spread_join(named, found, by, fair_share(counts.agg(F.sum("n")).first()[0] or 0), counts, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch, text):
                lines, first, _, _ = first_lines(part.column(text).fill_null("").cast(pa.large_string()), least_chars)
                n = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(n)
                begins = ends - n
                drops = part.column(keys["lines"]).fill_null([])
                doc = np.repeat(np.arange(len(n)), drops.value_lengths().to_numpy(zero_copy_only=False))
                marked = np.zeros(int(n.sum()), bool)
                marked[begins[doc] + drops.flatten().to_numpy(zero_copy_only=False)] = True
                gone = (first >= 0) & marked[np.repeat(begins, n) + np.maximum(first, 0)]
                kept = np.flatnonzero(~gone)
                per_text = np.diff(np.searchsorted(kept, np.concatenate((begins, ends[-1:]))))
                offsets = pa.array(np.concatenate(([0], np.cumsum(per_text))).astype(np.int32))
                texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.flatten().take(pa.array(kept))), pa.scalar("\n", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(n), pa.array(n - per_text), texts], [*own, "n_lines", "n_dropped", "kept"])

    fields = [*(source.schema[c] for c in own), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())]
    return met.mapInArrow(run, StructType(fields))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with d as (select row_number() over () rid, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
e as (select rid, unnest(range(1, len(l) + 1)) i, l from d),
k as materialized (select rid, i, l[i] line, translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from e),
many as (select k from k where k <> '' group by 1 having count(distinct rid) >= 10),
kept as (select rid, string_agg(line, chr(10) order by i) t, count(*) n from k where k not in (select k from many) group by 1)
select doc_id, cast(len(l) as bigint) n_lines, cast(len(l) - coalesce(n, 0) as bigint) n_dropped, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (rid)
"""
