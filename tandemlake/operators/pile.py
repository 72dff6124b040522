"""Majority consensus of groups of any size, as a pile of variants that partial sums merge.

Each distinct sequence of a group is aligned once with the group's seed, its variants are counted with map-side sums,
columns are voted on by (group, position, place), and what the votes change is put into the seed. A group is never
one task's work: sequences of a large one are dealt over many, and columns are rows of their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tandemlake.functions.consensus import ORDER, edited, log_prob_columns
from tandemlake.functions.kernels import variant_list
from tandemlake.operators.components import dealt_join

#: Distinct sequences of a group that one task aligns, at least; a larger group is dealt.
SHARE = 2000


def seeds(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seed and total of each group: the sequence of median length (from the longest down, equal lengths in order).
    counted: keys, seq, n. Lengths are summed first, so only sequences of one length are put in order."""
    lengths = counted.groupBy(*keys, F.length("seq").alias("size")).agg(F.sum("n").alias("m"))
    order = Window.partitionBy(*keys).orderBy(F.col("size").desc())
    before = F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    lengths = lengths.withColumns({"before": before, "total": F.sum("m").over(Window.partitionBy(*keys))})
    middle = F.floor(F.col("total") / 2)
    lengths = lengths.filter((F.col("before") <= middle) & (middle < F.col("before") + F.col("m"))).select(*keys, "size", "total", (middle - F.col("before")).alias("at"))
    own = counted.withColumn("size", F.length("seq")).join(lengths, [*keys, "size"])
    by_seq = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = own.withColumn("until", F.sum("n").over(by_seq))
    return until.filter((F.col("until") > F.col("at")) & (F.col("until") - F.col("n") <= F.col("at"))).select(*keys, F.col("seq").alias("seed"), "total")


def pile(counted: DataFrame, templates: DataFrame, keys: list[str], seq: str = "seq", template: str = "seed") -> DataFrame:
    """(keys, pos, place, op, base, n): how often each difference from its group's template occurs. counted: keys, seq and its number n;
    templates: one row for each group."""
    each = dealt_join(counted.select(*keys, seq, "n"), templates.select(*keys, template), keys, SHARE)
    found = each.select(*keys, "n", F.explode(variant_list(template, seq)).alias("v"))
    return found.groupBy(*keys, "v.pos", "v.place", "v.op", "v.base").agg(F.sum("n").alias("n"))


@F.pandas_udf(StringType())
def _edited(template: pd.Series, edits: pd.Series) -> pd.Series:
    put = lambda es: [(e["pos"], e["place"], e["base"]) for e in es] if es is not None else []
    return pd.Series([edited(t, put(es)) for t, es in zip(template, edits, strict=True)])


def _rank(base: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(base) == c, k) for c, k in ORDER.items()), F.lit(len(ORDER)))


def consensus_of(rows: DataFrame, keys: list[str], seq: str = "seq", name: str = "consensus") -> DataFrame:
    """(keys, name): the majority consensus of each group's sequences, seeded with that of median length; nulls have no
    vote, groups without any other sequence no row."""
    counted = rows.filter(F.col(seq).isNotNull()).groupBy(*keys, F.col(seq).alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    seeded = seeds(counted, keys)
    counts = pile(counted, seeded, keys).groupBy(*keys, "pos", "place", "base").agg(F.sum("n").alias("n"))
    columns = counts.groupBy(*keys, "pos", "place").agg(F.sum("n").alias("voted"), F.min(F.struct((-F.col("n")).alias("less"), _rank(F.col("base")).alias("rank"), "base")).alias("top"))
    met = columns.join(seeded, keys)
    rest = F.when(F.col("place") == 0, F.substring("seed", F.col("pos") + 1, F.lit(1))).otherwise(F.lit("-"))
    held = F.struct((F.col("voted") - F.col("total")).alias("less"), _rank(rest).alias("rank"), rest.alias("base"))
    edits = met.filter((F.col("voted") >= F.col("total")) | (F.col("top") < held))
    edits = edits.groupBy(*keys).agg(F.collect_list(F.struct("pos", "place", F.col("top.base").alias("base"))).alias("edits"))
    return seeded.drop("total").join(edits, keys, "left").select(*keys, _edited("seed", "edits").alias(name))


@F.pandas_udf(DoubleType())
def _columns_prob(length: pd.Series, total: pd.Series, columns: pd.Series, p: pd.Series) -> pd.Series:
    rows = zip(length, total, columns, p, strict=True)
    return pd.Series([log_prob_columns(int(n), int(t), [[int(v) for v in c] for c in cs], float(q)) for n, t, cs, q in rows])


def composition_of(rows: DataFrame, templates: DataFrame, keys: list[str], seq: str = "seq", template: str = "consensus", p: float = 0.001) -> DataFrame:
    """(keys, log_prob): log10 multinomial probability of each group's sequences over its template. A column's counts make
    one list, a template's columns another; both are bounded by the template, not by the group."""
    counted = rows.filter(F.col(seq).isNotNull()).groupBy(*keys, F.col(seq).alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    counts = pile(counted, templates, keys, template=template)
    columns = counts.groupBy(*keys, "pos", "place").agg(F.sort_array(F.collect_list("n")).alias("ns"))
    length = F.length(template)
    listed = columns.groupBy(*keys).agg(F.collect_list("ns").alias("columns"), F.collect_set("pos").alias("touched"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    met = templates.select(*keys, template).join(totals, keys).join(listed, keys, "left")
    untouched = length - F.size(F.filter(F.coalesce("touched", F.array().cast("array<int>")), lambda x: x < length))
    prob = _columns_prob(untouched, "total", F.coalesce("columns", F.array().cast("array<array<bigint>>")), F.lit(p))
    return met.select(*keys, prob.alias("log_prob"))
