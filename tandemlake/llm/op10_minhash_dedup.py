"""Near-duplicate documents by circulant MinHash.

1. Each whole text becomes its set of distinct word shingles (64-bit hashes over keyed digests of the words), a 128-bit
   fingerprint of that set, and the band keys of its signature (two permutations, see CirculantMinHash).
2. Texts with equal sets are one class, found by an aggregation with map-side minima.
3. In each bucket of equal band keys the classes are compared with one centre (the least), on full sets. That
   joins large groups of near copies without any pair among their other members.
   Sets are made again only for a row of each class that shares a bucket; a filter of fixed size tells these rows.
4. Buckets whose members are then still in several components are settled exactly: inside bounded blocks of
   such a bucket, every two members of different components are compared on full sets. The main component's
   members meet only the others. Only links leave a block, never pairs.
5. Connected components of all links.

Joins on keys that a large group shares (a band key, a centre, a class of copies, a hub of the links) deal the rows of
such a key over many tasks (spread_join).

Bands and their rows follow from the threshold (banding), so that a pair at it shares no band with probability MISS at
most: 48 bands of 8 rows at 0.85, (1 - 0.85^8)^48 = 2.4e-7; 51 of 6 at the pipeline's 0.80, (1 - 0.80^6)^51 = 1.9e-7. No
other link is missed.

Defined results: null and empty texts have the empty set, are linked with nothing and are their own component;
equal rows are linked (the first by id stays); rows of one doc_id with different texts are different documents
which share that id; a null doc_id takes part, comes last in order and is never `kept`; rows that share a null or equal
id, however many, are looked up by id and text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.llm.common import LOWER, SPACED_WORD, components, cut, digests, fair_share, find_words, free_name, mix, narrowed, numbered, pieces_of, sizes, small_batches, spread_join, table, text_slices, window_hashes

#: The probability that a pair at the threshold is missed, at most; and the bands for which more rows are still taken.
MISS, MOST_BANDS = 2.4e-7, 52
#: Shingles in one block of step 4, on either side.
BLOCK_SHINGLES = 1 << 18
#: Bits of the filter that tells rows of candidates from others, whatever their number; on the driver and in each worker.
FILTER_BITS = 1 << 26


def banding(num: int, den: int) -> tuple[int, int]:
    """(bands, rows) for a threshold of num / den: the most rows that need MOST_BANDS or less for MISS, one row at least."""
    bands = lambda rows: math.ceil(math.log(MISS) / math.log1p(-min(num / den, 1 - 1e-9) ** rows))
    rows = max((r for r in range(1, 33) if bands(r) <= MOST_BANDS), default=1)
    return bands(rows), rows


class CirculantMinHash:
    """Signatures from two permutations of a universe of `universe` places.

    The first permutation places a shingle; the second, read from that place on and once around, gives the
    shingle's value under every shift. Coordinate k of a set is the least value of its shingles under shift k,
    so one contiguous row of the second permutation serves all coordinates of a shingle.
    """

    def __init__(self, bands: int, rows: int, universe: int = 1 << 20, seed: int = 20240229):
        self.bands, self.rows, self.size, self.universe = bands, rows, bands * rows, universe
        rng = np.random.default_rng(seed)
        self.places = rng.permutation(universe).astype(np.int32)
        values = rng.permutation(universe).astype(np.int32)
        ring = np.concatenate((values, values[: self.size]))
        self.shifted = np.lib.stride_tricks.sliding_window_view(ring, self.size)
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places[(hashes & np.uint64(self.universe - 1)).astype(np.int64)]
        out = np.full(self.size, self.universe, np.int32)
        for k in range(0, len(at), 1024):
            np.minimum(out, self.shifted[at[k : k + 1024]].min(axis=0), out=out)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """A row of `bands` 64-bit keys for each signature; equal keys mean an equal band."""
        values = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        keys = np.broadcast_to(self.salts, values.shape[:2]).copy()
        for k in range(self.rows):
            keys = mix(keys * np.uint64(0xD1342543DE82EF95) + values[:, :, k])
        return keys


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes of each text: of its `words`-word runs, or of all its words if fewer; and a
    128-bit fingerprint of each set, whose halves come from independent digests of the words."""
    data = LOWER[data]
    starts, stops, first = find_words(data, offsets, SPACED_WORD)
    numbers, distinct = numbered(pieces_of(data, starts, stops))
    both = digests(distinct)[numbers].T
    runs = [window_hashes(x, words) for x in both]
    sets, prints = [], np.zeros((len(offsets) - 1, 2), np.int64)
    for k in range(len(offsets) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= words:
            own, other = (x[a : b - words + 1] for x in runs)
        else:
            own, other = (window_hashes(x[a:b], int(b - a)) for x in both)
        own, at = np.unique(own, return_index=True)
        sets.append(own)
        prints[k] = mix(own).sum().astype(np.int64), (mix(other[at]).sum() + np.uint64(len(own))).astype(np.int64)
    return sets, prints


_hashers: dict[tuple[int, int], CirculantMinHash] = {}


def _sketched(batches: Iterator[pa.RecordBatch], words: int, shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    if shape not in _hashers:
        _hashers[shape] = CirculantMinHash(*shape)
    hasher = _hashers[shape]
    for batch in batches:
        for part, data, offsets in text_slices(batch):
            sets, prints = shingle_sets(data, offsets, words)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = hasher.band_keys(np.array([hasher.signature(sets[k]) for k in full], np.int32).reshape(-1, hasher.size)).view(np.int64)
            counts = np.zeros(len(sets) + 1, np.int32)
            counts[np.array(full, np.int64) + 1] = hasher.bands
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), bands],
                ["doc_id", "t", "n_shingles", "a", "b", "bands"],
            )


def _filter_bit(no_id: np.ndarray, i: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (mix(mix(i.view(np.uint64) + no_id.astype(np.uint64)) ^ t.view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = _filter_bit(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("no_id", "i", "t")))
        yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.uint64(1) << (bits & 63).astype(np.uint64)).view(pa.int64())], ["word", "bits"])


def row_filter(rows: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set where a row (no_id, i, t) falls: any row's bit tells that it may be one of them."""
    words = rows.mapInArrow(_marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _with_sets(batches: Iterator[pa.RecordBatch], words: int, held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of rows that the filter lets through; of a row that a task meets again, once."""
    seen: set[tuple] = set()
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("no_id", "i", "t")]
        bits = _filter_bit(*keys)
        chosen = []
        for k in np.flatnonzero((held[bits >> 6] >> (bits & 63)) & 1).tolist():
            row = tuple(x[k] for x in keys)
            if row not in seen:
                seen.add(row)
                chosen.append(k)
        if not chosen:
            continue
        for _, data, offsets in text_slices(batch.take(pa.array(chosen))):
            sets, prints = shingle_sets(data, offsets, words)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["a", "b", "shingles"])


def _block_links(block: pa.Table, num: int, den: int) -> pa.Table:
    """Links that join different components within a block: on the sets of its members, at most one for each join."""
    nodes, labels = block.column("node").to_pylist(), block.column("label").to_pylist()
    sides = np.array(block.column("main").to_pylist(), bool)
    lists = block.column("shingles").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    _, flat = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    sizes = np.diff(ends)
    parent = {x: x for x in labels}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    number = {x: k for k, x in enumerate(parent)}
    group = np.array([number[x] for x in labels])
    marks = np.zeros(len(flat) and flat.max() + 1, bool)
    us, vs = [], []
    for k in np.flatnonzero(~sides):
        own = flat[ends[k] : ends[k + 1]]
        marks[own] = True
        shared = np.add.reduceat(marks[flat], ends[:-1])
        marks[own] = False
        near = (den * shared >= num * (sizes + sizes[k] - shared)) & (group != group[k])
        for other in np.flatnonzero(near):
            x, y = root(labels[k]), root(labels[other])
            if x != y:
                parent[max(x, y)] = min(x, y)
                us.append(nodes[k])
                vs.append(nodes[other])
    return pa.table({"u": pa.array(us, pa.string()), "v": pa.array(vs, pa.string())})


def duplicate_classes(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Sketches (doc_id, t, n_shingles, a, b) of every row, t being a hash of its text, and (a, b, component_id, keeper, n) of
    every class of equal sets: n is its number of rows, keeper the (no_id, doc_id, t) of its component's first row.

    docs needs doc_id and text. Documents are linked where den * |intersection| >= num * |union|.
    """
    docs = small_batches(docs).select("doc_id", "text")
    shape = banding(num, den)
    hashed = docs.withColumn("t", F.xxhash64("text"))
    sketches = cut(hashed.mapInArrow(lambda x: _sketched(x, words, shape), "doc_id long, t long, n_shingles long, a long, b long, bands array<long>"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("one")  # a row that has the set
    full = sketches.filter("n_shingles > 0")
    classes = cut(full.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), one, F.first("bands").alias("bands")))
    node = lambda a="a", b="b": F.concat(F.hex(a), F.lit("-"), F.hex(b))

    rows = classes.select(F.explode("bands").alias("key"), "a", "b")
    # read for their sizes, for hot ones, and by the join: every band of every class is shuffled for them
    found = cut(rows.groupBy("key").agg(F.min(F.struct("a", "b")).alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    size = found.agg(F.sum("n")).first()[0]
    if not size:
        return sketches.drop("bands"), classes.select("a", "b", F.col("first").alias("component_id"), F.col("one").alias("keeper"), "n")
    found = narrowed(found, size)
    members = narrowed(cut(spread_join(rows, found.select("key", "centre"), ["key"], fair_share(size), found)), size)

    candidates = cut(members.select("a", "b").distinct().join(classes.drop("bands", "n"), ["a", "b"]))
    n = candidates.count()
    candidates = narrowed(candidates, n)
    wanted = candidates.select("one.no_id", F.coalesce("one.doc_id", F.lit(0)).cast("long").alias("i"), "one.t")
    held = docs.sparkSession.sparkContext.broadcast(row_filter(wanted))
    given = docs.select("text", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("i"), F.xxhash64("text").alias("t"))
    sets = given.mapInArrow(lambda x: _with_sets(x, words, held.value), "a long, b long, shingles array<long>")
    sets = sets.join(candidates.select("a", "b"), ["a", "b"]).dropDuplicates(["a", "b"])
    sets = cut(sets.withColumn("node", node()))

    pairs = members.select("a", "b", node("centre.a", "centre.b").alias("u")).distinct().filter(F.col("u") != node())
    centres = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    sides = pairs.join(sets.select("a", "b", F.col("node").alias("v"), F.col("shingles").alias("y")), ["a", "b"]).select("u", "v", "y")
    shared = F.size(F.array_intersect("x", "y"))
    linked = spread_join(sides, centres, ["u"], fair_share(n), sizes(pairs, "u"))
    linked = linked.select("u", "v", (F.size("x") + F.size("y")).alias("total"), shared.alias("shared"))
    links = cut(linked.filter(F.col("shared") * den >= (F.col("total") - F.col("shared")) * num).select("u", "v"))

    labels = narrowed(_labels(narrowed(links, links.count()), n), n)
    placed = cut(
        members.select("key", node().alias("node")).join(labels, "node", "left")
        .join(sets.select("node", F.size("shingles").cast("long").alias("n")), "node")
        .select("key", "node", F.coalesce("label", "node").alias("label"), "n")
    )
    placed = narrowed(placed, size)
    more = _settle(placed, sets, num, den, fair_share(size))
    # what was found so far is one node for each label
    own = candidates.select("a", "b", "first", "one", node().alias("node")).join(labels, "node", "left")
    own = narrowed(cut(own.select("a", "b", "first", "one", F.coalesce("label", "node").alias("label"), "node")), n)
    label_of = lambda x: own.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    more = narrowed(more, more.count())
    joined = more.join(label_of("u"), "u").join(label_of("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    whole = components(joined).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    by_label = own.groupBy("label").agg(F.min("first").alias("first"), F.min("one").alias("one"), F.count(F.lit(1)).alias("n"))
    by_label = narrowed(cut(by_label.join(whole, "label", "left").withColumn("whole", F.coalesce("whole", "label"))), n)
    by_whole = by_label.groupBy("whole").agg(F.min("first").alias("component_id"), F.min("one").alias("keeper"))
    by_label = by_label.join(by_whole, "whole").select("label", "n", "component_id", "keeper")
    moved = cut(spread_join(own.select("a", "b", "label"), by_label.drop("n"), ["label"], fair_share(n), by_label.select("label", "n")).select("a", "b", "component_id", "keeper"))
    placed = classes.join(moved, ["a", "b"], "left")
    return sketches.drop("bands"), placed.select("a", "b", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("keeper", "one").alias("keeper"), "n")


def _labels(links: DataFrame, n: int) -> DataFrame:
    """(node, label) of the nodes of links (u a centre, v a member): equal labels mean connected. Members stand with the
    least of their centres, so that only centres take part in the rounds of `components`."""
    nearest = narrowed(cut(links.groupBy("v").agg(F.min("u").alias("c")).select(F.col("v").alias("node"), "c")), n)
    centres = narrowed(cut(links.select(F.col("u").alias("node")).distinct()), n)
    between = links.join(nearest.withColumnRenamed("node", "v"), "v").select("u", F.col("c").alias("v"))
    between = between.union(nearest.join(centres, "node").select(F.col("node").alias("u"), F.col("c").alias("v"))).filter("u <> v").distinct()
    found = components(between)
    labelled = narrowed(cut(centres.join(found, "node", "left").select(F.col("node").alias("c"), F.coalesce("label", "node").alias("label"))), n)
    of_members = spread_join(nearest, labelled, ["c"], fair_share(n), sizes(nearest, "c")).select("node", "label")
    return cut(of_members.union(labelled.join(nearest, labelled["c"] == nearest["node"], "left_anti").select("c", "label")))


def _settle(placed: DataFrame, sets: DataFrame, num: int, den: int, share: int) -> DataFrame:
    """Links between different components that share a bucket; placed: key, node, label, n (its shingles)."""
    by_label = placed.groupBy("key", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("members"))
    buckets = by_label.groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("labels"), F.sum("members").alias("members")
    )
    parts = lambda x: F.greatest(F.ceil(x / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    buckets = buckets.filter("labels > 1").select("key", "members", F.col("top.label").alias("top"), parts(F.col("top.n")).alias("mains"), parts(F.col("total") - F.col("top.n")).alias("others"))
    split = spread_join(placed, buckets.drop("members"), ["key"], share, buckets.select("key", F.col("members").alias("n"))).withColumn("main", F.col("label") == F.col("top"))
    split = split.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_main = F.transform(each("mains"), lambda k: F.struct(F.col("part").alias("i"), F.lit(1).alias("kind"), k.alias("j")))
    among = F.transform(each("others"), lambda k: F.struct(F.least("part", k).alias("i"), F.lit(0).alias("kind"), F.greatest("part", k).alias("j")))
    of_main = F.transform(each("others"), lambda k: F.struct(k.alias("i"), F.lit(1).alias("kind"), F.col("part").alias("j")))
    blocks = F.when(F.col("main"), of_main).otherwise(F.when(F.col("others") > 1, F.concat(with_main, among)).otherwise(with_main))
    rows = split.select("node", "label", "main", "key", F.explode(blocks).alias("g")).select("node", "label", "main", "key", "g.*")
    rows = rows.join(sets.select("node", "shingles"), "node")
    return cut(rows.groupBy("key", "i", "kind", "j").applyInArrow(lambda x: _block_links(x, num, den), "u string, v string").distinct())


def _with_components(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Sketches with the component_id of their class; null for rows without words. A class of any size is dealt over tasks."""
    classes = cut(classes)
    share = fair_share(classes.agg(F.sum("n")).first()[0] or 0)
    full = spread_join(sketches.filter("n_shingles > 0"), classes.drop("n", "keeper"), ["a", "b"], share, classes.select("a", "b", "n"))
    return full.unionByName(sketches.filter("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long")))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _with_components(*duplicate_classes(table(spark, sf_dir, "documents")))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five-word shingles, similarity 0.8 or more) one document, that with
    the least doc_id, null last, and of several texts with that id the one with the least hash; one row of it if rows are
    repeated. Documents without words all stay."""
    own = docs.columns
    _, classes = duplicate_classes(docs, words=5, num=80)
    stays = classes.select(F.col("keeper.doc_id").alias("i"), F.col("keeper.t").alias("t")).distinct()
    t = free_name(docs, "t")
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(wordy).withColumn(t, F.xxhash64("text"))
    held = rows.join(stays, rows["doc_id"].eqNullSafe(stays["i"]) & (rows[t] == stays["t"]), "left_semi").dropDuplicates(["doc_id", t])
    return held.select(*own).union(docs.filter(~wordy).select(*own))


_WHITE = r"\x20\x09-\x0D"
SQL = rf"""
with recursive w as materialized (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_WHITE}]+') w from documents),
s as (select rid, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) i from w),
g as materialized (select distinct rid, array_to_string(w[i:i + 2], ' ') g from s),
n as materialized (select rid, count(*) n from g group by 1),
pairs as (select a.rid u, b.rid v, count(*) c from g a join g b using (g) where a.rid < b.rid group by 1, 2),
links as materialized (select u, v from pairs join n x on x.rid = u join n y on y.rid = v where 100 * c >= 85 * (x.n + y.n - c)),
ways as materialized (select u, v from links union select v, u from links),
reach(node, other) as (select rid, rid from n union select reach.node, ways.v from reach join ways on reach.other = ways.u),
least_id as (select node, min(doc_id) component_id from reach join w on w.rid = reach.other group by 1)
select doc_id, cast(coalesce(n, 0) as bigint) n_shingles, case when n > 0 then component_id else doc_id end component_id, coalesce(doc_id = case when n > 0 then component_id else doc_id end, false) kept
from w left join n using (rid) left join least_id on least_id.node = w.rid
"""
