"""Views of the driver's tables in the shapes that the operators take, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlake.functions.sequences import revcomp
from tandemlake.operators.components import in_parts
from tandemlake.operators.graph import string_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit for each lineitem: its order is the read, its quantity the length."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.col("l_quantity").cast("int")
    end = F.sum(length).over(rows)
    lines = table(spark, sf_dir, "lineitem")
    return in_parts(lines, lines.count(), "l_orderkey").select(
        F.col("l_orderkey").alias("read_id"), F.row_number().over(order).cast("long").alias("unit_ord"), (end - length).alias("start"), end.alias("end"), length.alias("ulen")
    )


UNITS = """units_v as (
  select l_orderkey as read_id, row_number() over w as unit_ord,
    cast(sum(cast(l_quantity as int)) over w - cast(l_quantity as int) as bigint) as start,
    cast(sum(cast(l_quantity as int)) over w as bigint) as "end", cast(l_quantity as int) as ulen
  from lineitem
  window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice rows between unbounded preceding and current row))"""


def orders_as_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.lit(512).alias("length"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters a, c, g and t of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("seq"))


READS = "reads_v as (select doc_id as read_id, regexp_replace(lower(text), '[^acgt]', '', 'g') as seq from documents)"


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlap for each lineitem between its supplier and its part, of all kinds but `contains`."""
    kind = F.when(F.col("l_orderkey") % 1000 == 0, 2).otherwise(F.col("l_orderkey") % 2)
    s = (500 + (F.col("l_orderkey") * 37 + F.col("l_partkey") * 11) % 8000).cast("int")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_suppkey").cast("int").alias("a_read_id"), F.col("l_partkey").cast("int").alias("b_read_id"), (F.col("l_linenumber") % 2).alias("strand"),
        kind.cast("int").alias("kind"), s.alias("s"), F.round(F.col("l_discount") * 20, 2).alias("diff"),
    ).filter("a_read_id < b_read_id")
    # kind and s make the places, and places tell them; so rows are shuffled, and once, before there are places
    rows = in_parts(rows, lines.count(), "a_read_id", "b_read_id", "strand").distinct()
    by = lambda zero, one, two: F.when(F.col("kind") == 0, zero).when(F.col("kind") == 1, one).otherwise(two)
    n, s = F.lit(10000), F.col("s")
    return rows.select(
        "a_read_id", "b_read_id", "strand", by(s, F.lit(0), F.lit(0)).alias("a_start"), by(n, n - s, n).alias("a_end"), n.alias("a_len"),
        by(F.lit(0), s, s).alias("b_start"), by(n - s, n, s + n).alias("b_end"), by(n, n, F.lit(20000)).alias("b_len"), "diff",
    )


OVERLAPS = """overlaps_v as (
  select distinct a_read_id, b_read_id, strand, case when kind = 0 then s else 0 end as a_start, case when kind = 1 then 10000 - s else 10000 end as a_end, 10000 as a_len,
    case when kind = 0 then 0 else s end as b_start, case when kind = 0 then 10000 - s when kind = 2 then s + 10000 else 10000 end as b_end,
    case when kind = 2 then 20000 else 10000 end as b_len, diff
  from (select cast(l_suppkey as int) as a_read_id, cast(l_partkey as int) as b_read_id, l_linenumber % 2 as strand,
      cast(case when l_orderkey % 1000 = 0 then 2 else l_orderkey % 2 end as int) as kind, cast(500 + (l_orderkey * 37 + l_partkey * 11) % 8000 as int) as s,
      round(l_discount * 20, 2) as diff from lineitem) x
  where a_read_id < b_read_id)"""
CLASSIFIED = """classified_v as (
  select *, case when a_start > 0 and strand = 0 then case when g_end = b_len then 'contains' else 'suffix-prefix' end
    when a_start > 0 then case when g_start = 0 then 'contains' else 'suffix-suffix' end
    when a_end = a_len then 'contained'
    when strand = 0 then case when g_start = 0 then 'contains' else 'prefix-suffix' end
    else case when g_end = b_len then 'contains' else 'prefix-prefix' end end as kind
  from (select *, case when strand = 1 then b_len - b_end else b_start end as g_start, case when strand = 1 then b_len - b_start else b_end end as g_end from overlaps_v) y)"""
INNER = "inner_v as (select a_read_id as read_id from classified_v where kind = 'contained' union select b_read_id from classified_v where kind = 'contains')"
EDGES = """edges_v as (
  select distinct e.* from (select unnest(case kind
      when 'suffix-prefix' then [{src_id: b_read_id, src_end: 'B', dst_id: a_read_id, dst_end: 'B', length: a_start, diff: diff}, {src_id: a_read_id, src_end: 'E', dst_id: b_read_id, dst_end: 'E', length: b_len - g_end, diff: diff}]
      when 'suffix-suffix' then [{src_id: b_read_id, src_end: 'E', dst_id: a_read_id, dst_end: 'B', length: a_start, diff: diff}, {src_id: a_read_id, src_end: 'E', dst_id: b_read_id, dst_end: 'B', length: g_start, diff: diff}]
      when 'prefix-suffix' then [{src_id: a_read_id, src_end: 'B', dst_id: b_read_id, dst_end: 'B', length: g_start, diff: diff}, {src_id: b_read_id, src_end: 'E', dst_id: a_read_id, dst_end: 'E', length: a_len - a_end, diff: diff}]
      when 'prefix-prefix' then [{src_id: a_read_id, src_end: 'B', dst_id: b_read_id, dst_end: 'E', length: b_len - g_end, diff: diff}, {src_id: b_read_id, src_end: 'B', dst_id: a_read_id, dst_end: 'E', length: a_len - a_end, diff: diff}] end) as e
    from classified_v where a_read_id not in (select read_id from inner_v) and b_read_id not in (select read_id from inner_v)) z)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_graph(overlaps(spark, sf_dir))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between neighbouring orders of a customer, by date: simple paths of any length."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    linked = table(spark, sf_dir, "orders").withColumn("next", F.lead("o_orderkey").over(order)).filter("next IS NOT NULL")
    return linked.select(
        F.col("o_orderkey").alias("src_id"), F.lit("E").alias("src_end"), F.col("next").alias("dst_id"), F.lit("E").alias("dst_end"),
        (F.col("o_orderkey") % 97 + 1).cast("int").alias("length"), ((F.col("o_orderkey") % 7) * 1.0).alias("diff"),
    )


#: Of the genomes that are made of texts: bases of a unit and of a flank, copies of the unit; of their reads: length and step.
UNIT, FLANK, COPIES, READ, STEP = 90, 200, 12, 700, 130


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, unit, genome): a tandem repeat for each benchmark item of UNIT letters or more. Its letters, four by four the
    same base, make the unit; each copy has another base in one place of its own; flanks are spelt from hashes of the text."""
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac")
    spelt = lambda k: F.translate(F.md5(F.concat("text", F.lit(str(k)))), "0123456789abcdef", "acgtacgtacgtacgt")
    flank = lambda k: F.substring(F.concat(*(spelt(k + n) for n in range(FLANK // 32 + 1))), 1, FLANK)

    def copied(j):
        at = (j * 7) % UNIT
        return F.concat(F.col("unit").substr(F.lit(1), at), F.translate(F.col("unit").substr(at + 1, F.lit(1)), "acgt", "cgta"), F.col("unit").substr(at + 2, F.lit(UNIT)))

    own = table(spark, sf_dir, "benchmark").filter(F.length(letters) >= UNIT).select("item_id", "text", F.substring(letters, 1, UNIT).alias("unit"))
    copies = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(COPIES)), copied), "")
    return own.select("item_id", "unit", F.concat(flank(0), copies, flank(100)).alias("genome"))


def genome_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq, length, item_id, true_start, true_strand): reads of every genome at every STEP bases, each other one reversed."""
    starts = F.posexplode(F.sequence(F.lit(0), F.length("genome") - READ, F.lit(STEP))).alias("k", "true_start")
    rows = genomes(spark, sf_dir).select("item_id", "genome", starts).withColumn("piece", F.col("genome").substr(F.col("true_start") + 1, F.lit(READ)))
    seq = F.when(F.col("k") % 2 == 1, revcomp("piece")).otherwise(F.col("piece"))
    return rows.select((F.col("item_id") * 100 + F.col("k")).alias("read_id"), seq.alias("seq"), F.lit(READ).alias("length"), "item_id", "true_start", (F.col("k") % 2).alias("true_strand"))
