"""Sharding over fixed virtual slots, in DataFrame operations only.

Records hash into a fixed number of virtual slots. Bytes and rows are summed for each slot (at most
VIRTUAL_SLOTS rows, whatever the input), and a versioned map, kept as a table with a folder for each version, places slots
on shards: first by giving the largest slots to the least loaded shard, later by edits that move only the slots they
must. Since the slots are even in number of records and thousands for each shard, shards come out near equal in bytes:
two of them differ by the bytes of the largest slot at most.

The law is `bytes`, for rows one by one: equal texts under different ids hash apart and are not held together. A row's
virtual slot is a hash of its id, size, checksum and copy number, which counts rows that are equal in these; so it depends on no
other row, nor on how the table is parted, and repeated rows spread like others. Equal rows are counted first and
numbered in stretches of COPIES, so a row that makes up a third of the table is many tasks' work.

A row's place in its shard is the number of rows in the shard's earlier slots plus its place in its own slot;
no window spans more than one virtual slot.

Defined results: a null text has size 1 and checksum 0; null and repeated doc_ids hash with size and checksum; a single
text larger than a fair share fills its shard alone; an empty table gives an empty result and maps of empty slots; other
columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlake.llm.common import cut, shared_folder, table

VIRTUAL_SLOTS = 8192
SHARDS = 16
#: Equal rows that one step numbers.
COPIES = 20_000


def records(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot, a row for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    own = ["doc_id", "size", "text_crc32"]
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = sized.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    dealt = counted.filter(F.col("n") > COPIES).repartition(*own, "first").unionByName(counted.filter(F.col("n") <= COPIES))
    copies = dealt.select(*own, F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES, "n") - 1)).alias("copy"))
    return copies.select(*own, F.pmod(F.xxhash64(*own, "copy"), F.lit(slots)).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """vslot, bytes, rows: combined before the shuffle, one row a slot after it."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def build_map(loads: DataFrame, shards: int = SHARDS, version: int = 1, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """(version, vslot, shard) of every slot, those without rows included: slots in descending order of bytes, each to the shard with the fewest so far.

    The fold runs over one array of at most VIRTUAL_SLOTS entries.
    """
    every = loads.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    loads = every.join(loads, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    listed = loads.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("slots"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.expr("cast(array() as array<struct<vslot: int, shard: int>>)").alias("placed"),
    )

    def place(state: Column, slot: Column) -> Column:
        best = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        now = F.transform(state["loads"], lambda load, k: F.when(k == best, load - slot["less"]).otherwise(load))
        new = F.struct(slot["vslot"].alias("vslot"), best.alias("shard"))
        return F.struct(now.alias("loads"), F.concat(state["placed"], F.array(new)).alias("placed"))

    folded = listed.select(F.explode(F.aggregate("slots", start, place)["placed"]).alias("p"))
    return folded.select(F.lit(version).alias("version"), "p.vslot", "p.shard")


def store_map(mapped: DataFrame, folder: str) -> None:
    """Adds a version to the maps in `folder`; earlier ones stay as they are."""
    mapped.write.mode("append").partitionBy("version").parquet(folder)


def stored_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the maps in `folder`, the latest by default. Only that version's files are read."""
    maps = spark.read.parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version).select("version", "vslot", "shard")


def grow(mapped: DataFrame, loads: DataFrame) -> DataFrame:
    """The next version with one more shard: each shard gives it slots until it has no more than an equal share.
    Nothing else moves; slots without rows stay."""
    total = loads.agg(F.sum("bytes").alias("total"))
    count = mapped.agg((F.max("shard") + 1).alias("shards"), F.max("version").alias("last"))
    rows = mapped.join(loads.select("vslot", "bytes"), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    own = Window.partitionBy("shard")
    in_turn = own.orderBy(F.md5(F.col("vslot").cast("string"))).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("held", F.sum("bytes").over(own)).withColumn("given", F.sum("bytes").over(in_turn))
    rows = rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(count))  # one row each
    gives = (F.col("bytes") > 0) & (F.col("given") <= F.col("held") - F.col("total") / (F.col("shards") + 1))
    return rows.select((F.col("last") + 1).alias("version"), "vslot", F.when(gives, F.col("shards")).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalance(mapped: DataFrame, loads: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The next version of a map for changed loads: shards above the mean by more than the tolerance give up slots
    (smallest first, only as many as needed), which go, largest first, to the shard that then has least."""
    rows = mapped.join(loads.select("vslot", "bytes"), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    own = Window.partitionBy("shard")
    in_turn = own.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    shards = mapped.agg((F.max("shard") + 1).alias("shards"), F.max("version").alias("last"))
    mean = rows.agg(F.sum("bytes").alias("total")).crossJoin(F.broadcast(shards)).select((F.col("total") / F.col("shards")).alias("mean"), "shards", "last")
    rows = rows.withColumn("held", F.sum("bytes").over(own)).withColumn("given", F.sum("bytes").over(in_turn)).crossJoin(F.broadcast(mean))
    over = F.col("held") - F.col("mean") * (1 + tolerance)
    rows = rows.withColumn("moves", (F.col("bytes") > 0) & (over > 0) & (F.col("given") - F.col("bytes") < over))
    state = rows.groupBy().agg(
        F.sort_array(F.collect_list(F.when(F.col("moves"), F.struct((-F.col("bytes")).alias("less"), "vslot")))).alias("slots"),
        F.collect_list(F.when(~F.col("moves"), F.struct("shard", "bytes"))).alias("stay"),
        F.collect_list(F.when(~F.col("moves"), F.struct("vslot", "shard"))).alias("placed"),
        F.max("shards").alias("shards"), F.max("last").alias("last"),
    )
    held = F.transform(
        F.sequence(F.lit(0), F.col("shards") - 1),
        lambda k: F.aggregate(F.filter("stay", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda s, x: s + x["bytes"]),
    )

    def place(st: Column, slot: Column) -> Column:
        best = (F.array_position(st["loads"], F.array_min(st["loads"])) - 1).cast("int")
        now = F.transform(st["loads"], lambda load, k: F.when(k == best, load - slot["less"]).otherwise(load))
        return F.struct(now.alias("loads"), F.concat(st["placed"], F.array(F.struct(slot["vslot"].alias("vslot"), best.alias("shard")))).alias("placed"))

    start = F.struct(held.alias("loads"), F.col("placed"))
    moved = state.filter("shards IS NOT NULL").select((F.col("last") + 1).alias("version"), F.explode(F.aggregate("slots", start, place)["placed"]).alias("p"))
    return moved.select("version", "p.vslot", "p.shard")


def place(rows: DataFrame, loads: DataFrame, mapped: DataFrame) -> DataFrame:
    """rows with shard and slot, the place within the shard (0, 1, ...). The map and the loads have at most
    VIRTUAL_SLOTS rows and are broadcast."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    begins = mapped.join(loads, "vslot").select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    inner = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(inner).cast("long") - 1)
    return numbered.join(F.broadcast(begins), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("begin") + F.col("at")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(records(table(spark, sf_dir, "documents")))
    loads = cut(slot_loads(rows))
    maps = f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
    store_map(build_map(loads), maps)
    return place(rows, loads, stored_map(spark, maps)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


def slot_map_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of three versions over the operator's own slots: the first, one with a further shard, and one rebalanced after
    every second id has come once more. For each version and shard: rows, bytes, and the rows that came from another
    shard of the version before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut(records(docs))
    loads = cut(slot_loads(rows))
    again = docs.filter(F.col("doc_id") % 2 == 0).unionByName(docs)
    later = cut(slot_loads(records(again)))
    maps = f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
    store_map(build_map(loads), maps)
    store_map(grow(stored_map(spark, maps), loads), maps)
    store_map(rebalance(stored_map(spark, maps), later), maps)
    out = []
    for version, own in ((1, loads), (2, loads), (3, later)):
        before = stored_map(spark, maps, max(1, version - 1)).select("vslot", F.col("shard").alias("from"))
        placed = own.join(stored_map(spark, maps, version), "vslot").join(before, "vslot")
        sums = (F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("from") != F.col("shard"), F.col("rows")).otherwise(0)).alias("moved"))
        out.append(placed.groupBy("version", "shard").agg(*sums))
    return out[0].unionByName(out[1]).unionByName(out[2])


def slot_map_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit of a map for one more shard: every slot with its bytes, its shard and its shard afterwards. Slots and the
    first map are plain remainders here, so that SQL can follow."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    sized = docs.select(F.pmod("doc_id", F.lit(VIRTUAL_SLOTS)).cast("int").alias("vslot"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"))
    loads = cut(slot_loads(sized))
    first = loads.select(F.lit(1).alias("version"), "vslot", (F.col("vslot") % SHARDS).alias("shard"))
    grown = grow(first, loads).select("version", "vslot", F.col("shard").alias("grown_shard"))
    return first.drop("version").join(loads.select("vslot", "bytes"), "vslot").join(grown, "vslot").select("version", "vslot", "bytes", "shard", "grown_shard")


GROWTH_SQL = f"""
with l as (select cast(doc_id % {VIRTUAL_SLOTS} as int) vslot, cast(sum(strlen(coalesce(text, '')) + 1) as bigint) bytes from documents where doc_id is not null group by 1),
m as (select *, cast(vslot % {SHARDS} as int) shard from l),
r as (select *, sum(bytes) over (partition by shard) held, sum(bytes) over (partition by shard order by md5(cast(vslot as varchar)) rows unbounded preceding) given, sum(bytes) over () total, max(shard) over () + 1 shards from m)
select 2 as version, vslot, bytes, shard, cast(case when bytes > 0 and given <= held - total / (shards + 1) then shards else shard end as int) grown_shard from r
"""
