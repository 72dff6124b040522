"""Registered queries over the driver's tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlake.functions import sequences as S
from tandemlake.functions.kernels import aligner, variant_list
from tandemlake.operators import clustering, contigs, detect, encode, graph, labels, overlap_search, overlaps, peaks, pile, units, views
from tandemlake.operators.components import kept, spread
from tandemlake.plans import stand_ins as V
from tandemlake.schemas import OVERLAP_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Units ---------------------------------------------------------------------------------------------------------------

@query(f'with {V.UNITS} select read_id, unit_ord, start, "end", ulen from units_v')
def unit_table(spark, d):
    return V.units(spark, d)


@query(f"with {V.UNITS} select ulen, count(*) as n, ulen * count(*) as total from units_v group by ulen")
def ulen_hist_total(spark, d):
    return units.length_totals(V.units(spark, d))


@query(f"with {V.UNITS} select read_id, ulen, count(*) as n from units_v group by 1, 2")
def ulen_composition_per_read(spark, d):
    return units.composition(V.units(spark, d))


_STRATA = f"""with {V.UNITS}, strata as (
  select o_orderkey as read_id, cast(coalesce(sum(ulen), 0) as bigint) as covered, cast(coalesce(sum(ulen), 0) // 100 as bigint) as stratum
  from orders left join (select * from units_v where ulen between 10 and 45) u on o_orderkey = read_id group by 1)"""


@query(f"{_STRATA} select * from strata")
def covered_length_strata(spark, d):
    return units.covered_strata(V.units(spark, d), V.orders_as_reads(spark, d), 10, 45, 100)


@query(f"{_STRATA} select stratum, ulen, count(*) as n from units_v join strata using (read_id) where ulen between 10 and 45 and stratum >= 1 group by 1, 2")
def stratified_lengths(spark, d):
    rows = V.units(spark, d)
    return units.stratified_lengths(rows, units.covered_strata(rows, V.orders_as_reads(spark, d), 10, 45, 100), 10, 45, 1)


_KDE = f"""with {V.UNITS}, gated as (select * from units_v where ulen between 1 and 50 and read_id in
    (select read_id from units_v where ulen between 1 and 50 group by 1 having sum(ulen) >= 60)),
  h as (select ulen, count(*) as n from gated group by 1),
  dens as (select x, (select sum(n * exp(-0.5 * power((ulen - x) / 0.5, 2))) / (sum(n) * 0.5 * sqrt(2 * pi())) from h) as density from range(1, 51) t(x)),
  peak as (select x, density from (select *, lag(density) over (order by x) l, lead(density) over (order by x) r from dens) where density > l and density > r and density >= 0.01),
  spans as (select cast(ceil(x * (1 - 0.015)) as bigint) as lo, cast(floor(x * (1 + 0.015)) as bigint) as hi from peak),
  marked as (select *, case when lo <= max(hi) over (order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from spans),
  intervals as (select min(lo) as lo, max(hi) as hi from (select *, sum(new) over (order by lo, hi rows unbounded preceding) as island from marked) group by island)"""


@query(f"{_KDE} select x, round(density, 9) as density from dens")
def kde_density(spark, d):
    return peaks.density(peaks.gated(V.units(spark, d), 1, 50, 60), 1, 50).select(F.col("x").cast("long").alias("x"), F.round("density", 9).alias("density"))


@query(f"{_KDE} select x, round(density, 9) as density from peak")
def peak_lengths(spark, d):
    found = peaks.peaks(peaks.density(peaks.gated(V.units(spark, d), 1, 50, 60), 1, 50))
    return found.select(F.col("x").cast("long").alias("x"), F.round("density", 9).alias("density"))


@query(f"{_KDE} select lo, hi from intervals")
def peak_intervals(spark, d):
    return peaks.find_intervals(V.units(spark, d), 1, 50, 60)


@query(f"{_KDE} select read_id, cast(sum(ulen) as bigint) as covered from units_v join intervals on ulen between lo and hi group by 1 having sum(ulen) >= 60")
def peak_covered_reads(spark, d):
    rows = V.units(spark, d)
    return peaks.covered_reads(rows, peaks.find_intervals(rows, 1, 50, 60), 60)


@query(f"with {V.UNITS} select * from (select read_id, count(*) as n, round(stddev_samp(ulen) / avg(ulen), 3) as cv from units_v group by 1) where n > 1 and cv < 0.4")
def unit_cv(spark, d):
    return units.variation(V.units(spark, d), ["read_id"], 0.4)


@query(f'with {V.UNITS} select * from (select read_id, unit_ord, start, lead("end", 2) over (partition by read_id order by unit_ord) as window_end from units_v) where window_end is not null')
def k_unit_windows(spark, d):
    return units.windows(V.units(spark, d), 2)


@query(f"""with {V.UNITS}, p as (select read_id, row_number() over w - 1 as pos, count(*) over (partition by read_id) as n, start, lead("end", 1) over w as stop from units_v window w as (partition by read_id order by unit_ord))
  select read_id, 'prefix' as side, start, stop as "end" from p where n >= 3 and pos = 1 union all select read_id, 'suffix', start, stop from p where n >= 3 and pos = n - 3""")
def boundary_units(spark, d):
    return units.boundaries(V.units(spark, d), 2, 1)


@query(f"""with {V.UNITS}, s as (select read_id, start + 3 * (unit_ord % 5) as start, "end" from units_v),
  m as (select *, case when start <= max("end") over (partition by read_id order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from s)
  select read_id, min(start) as start, max("end") as "end" from (select *, sum(new) over (partition by read_id order by start, "end" rows unbounded preceding) as island from m) group by read_id, island""")
def merged_intervals(spark, d):
    return units.merged(V.units(spark, d).withColumn("start", F.col("start") + 3 * (F.col("unit_ord") % 5)).select("read_id", "start", "end"), ["read_id"])


@query(f"with {V.UNITS} select read_id, round(sum(ulen) / 512, 2) as cover_rate from units_v join orders on o_orderkey = read_id group by 1")
def read_cover_rates(spark, d):
    return units.cover_rate(V.units(spark, d), V.orders_as_reads(spark, d))


@query(f"""with {V.UNITS} select read_id, cast(count(*) over (partition by read_id) - row_number() over (partition by read_id order by unit_ord) as int) as unit_ord,
  512 - "end" as start, 512 - start as "end", ulen from units_v join orders on o_orderkey = read_id""")
def reversed_units(spark, d):
    return units.reversed_units(V.units(spark, d), V.orders_as_reads(spark, d))


@query(f'with {V.UNITS} select ulen, "next", count(*) as n from (select ulen, lead(ulen) over (partition by read_id order by unit_ord) as "next" from units_v) where "next" is not null group by 1, 2')
def length_transitions(spark, d):
    return views.length_transitions(V.units(spark, d))


@query(f"""with {V.UNITS} select read_id, unit_ord, start, "end", ulen, substr(o_orderpriority || o_orderstatus || o_orderkey, cast(start % 7 as int) + 1, 5) as unit_seq
  from units_v join orders on o_orderkey = read_id""")
def unit_sequences(spark, d):
    rows = V.units(spark, d)
    own = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat("o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("seq"))
    cut = rows.withColumns({"s0": F.col("start"), "e0": F.col("end"), "start": F.col("start") % 7, "end": F.col("start") % 7 + 5})
    return units.sequences(cut, own).select("read_id", "unit_ord", F.col("s0").alias("start"), F.col("e0").alias("end"), "ulen", "unit_seq")


@query(f"""with {V.UNITS}, a as (select read_id, cast("end" as int) as ab, cast("end" + ulen as int) as ae, cast(start as int) as bb, cast("end" + 1 as int) as be from units_v)
  select read_id, ab, ae, bb, be, ab - bb as distance, round((ae - ab) / (be - bb), 3) as slope from a""")
def self_alignment_measures(spark, d):
    end, i = F.col("end"), lambda c: c.cast("int")
    rows = V.units(spark, d).select("read_id", i(end).alias("ab"), i(end + F.col("ulen")).alias("ae"), i(F.col("start")).alias("bb"), i(end + 1).alias("be"))
    return detect.measured(rows)


@query(f"with {V.UNITS} select read_id, ulen, count(*) as n, ulen * count(*) as total from units_v group by 1, 2")
def composition_scatter(spark, d):
    return views.composition_scatter(V.units(spark, d))


@query(f"""with {V.UNITS} select read_id, unit_ord, start, "end", ulen % 5 as repr_id, 'unit ' || unit_ord || ' (id=' || ulen % 5 || ') [' || start || ':' || "end" || '] (' || ulen || ' bp)' as info from units_v""")
def labelled_read_view(spark, d):
    return views.labelled_units(V.units(spark, d).withColumn("repr_id", F.col("ulen") % 5))


@query(f"{_KDE} select o_orderkey as read_id, 512 as length from orders where o_orderkey in (select read_id from units_v join intervals on ulen between lo and hi group by 1 having sum(ulen) >= 60)")
def peak_filtered_reads(spark, d):
    return peaks.filter_reads(V.orders_as_reads(spark, d), V.units(spark, d), 60, low=1, high=50)


@query(f"""with {V.UNITS}, e as (select read_id, cast(sum(ulen) as bigint) as covered from units_v group by 1)
  select read_id, round(covered / length(o_orderpriority || o_orderstatus || o_orderkey), 2) as cover_rate from e join orders on o_orderkey = read_id""")
def encoding_cover_rates(spark, d):
    own = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat("o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("seq"))
    return encode.cover_rates(V.units(spark, d).select("read_id", F.col("ulen").alias("length")), own)


@query(f"""with {V.UNITS}, s as (select read_id, unit_ord, substr(o_orderpriority || o_orderstatus || o_orderkey, cast(start % 7 as int) + 1, 5) as x from units_v join orders on o_orderkey = read_id)
  select read_id, unit_ord, array_to_string(list_transform(range(1, length(x) + 1), lambda i: case when i > 1 and x[i] = x[i - 1] then '' else x[i] end), '') as unit_seq from s""")
def compressed_unit_sequences(spark, d):
    own = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat("o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("seq"))
    cut = V.units(spark, d).withColumns({"start": F.col("start") % 7, "end": F.col("start") % 7 + 5})
    return units.sequences(cut, own, compressed=True).select("read_id", "unit_ord", "unit_seq")


# Sequences -----------------------------------------------------------------------------------------------------------

@query(f"with {V.READS} select read_id, seq from reads_v")
def reads_seq(spark, d):
    return V.reads(spark, d)


@query(f"with {V.READS} select read_id, reverse(translate(seq, 'acgtACGT', 'tgcaTGCA')) as seq from reads_v")
def revcomp(spark, d):
    return V.reads(spark, d).select("read_id", S.revcomp("seq").alias("seq"))


@query(f"with {V.READS} select read_id, reverse(translate(seq, 'acgtACGT', 'tgcaTGCA')) as seq, 1 - read_id % 2 as strand from reads_v")
def reversed_reads(spark, d):
    return units.reversed_reads(V.reads(spark, d).withColumn("strand", F.col("read_id") % 2))


@query("""with p as (select a.p_partkey, list_distinct(list_transform(range(1, length(a.p_name) - 2), lambda i: a.p_name[i:i + 3])) as x, list_distinct(list_transform(range(1, length(b.p_name) - 2), lambda i: b.p_name[i:i + 3])) as y
  from part a join part b on b.p_partkey = a.p_partkey + 1) select p_partkey, cast(len(list_intersect(x, y)) as bigint) as shared from p""")
def shared_kmers(spark, d):
    part = V.table(spark, d, "part").select("p_partkey", "p_name")
    pairs = part.withColumnRenamed("p_name", "x").join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y")), "p_partkey")
    return views.shared_kmer_count(pairs, 4).select("p_partkey", F.col("shared").cast("long").alias("shared"))


@query(f"with {V.READS} select read_id, count(distinct substr(seq, cast(i as int), 13)) as n from (select read_id, seq, unnest(range(1, length(seq) - 11)) as i from reads_v) group by 1")
def distinct_kmers(spark, d):
    return V.reads(spark, d).filter("length(seq) >= 13").select("read_id", F.size(S.kmers("seq", 13)).cast("long").alias("n"))


@query(f"""with {V.READS}, k as (select distinct read_id, substr(seq, cast(i as int), 13) as w from (select read_id, seq, unnest(range(1, length(seq) - 11)) as i from reads_v)),
  s as (select read_id, count(*) as n from k group by 1),
  p as (select a.read_id as a_read_id, b.read_id as b_read_id, count(*) as c from k a join k b using (w) where a.read_id < b.read_id group by 1, 2)
  select a_read_id, b_read_id, round(c / n, 6) as containment from p join s on b_read_id = s.read_id where c / n >= 0.4""")
def kmer_containment_pairs(spark, d):
    return overlap_search.similar_pairs(V.reads(spark, d))


@query(f"with {V.READS} select read_id, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: case when i > 1 and seq[i] = seq[i - 1] then '' else seq[i] end), '') as seq from reads_v")
def homopolymer(spark, d):
    return V.reads(spark, d).select("read_id", S.homopolymer_compressed("seq").alias("seq"))


@query("select p_partkey, length(repeat(p_brand, 1 + p_size % 3)) > 1 and instr((repeat(p_brand, 1 + p_size % 3) || repeat(p_brand, 1 + p_size % 3))[2:-2], repeat(p_brand, 1 + p_size % 3)) > 0 as tandem from part")
def is_tandem(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.is_tandem(F.expr("repeat(p_brand, 1 + p_size % 3)")).alias("tandem"))


@query("""select a.p_partkey, levenshtein(a.p_name || a.p_brand, b.p_type || b.p_brand) as n_diff from part a join part b on b.p_partkey = a.p_partkey + 1""")
def global_distance(spark, d):
    part = V.table(spark, d, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_type", "p_brand").alias("y"))
    rows = part.select("p_partkey", F.concat("p_name", "p_brand").alias("x")).join(other, "p_partkey")
    return rows.select("p_partkey", aligner("global")("x", "y")["n_diff"].cast("long").alias("n_diff"))


# Overlaps ------------------------------------------------------------------------------------------------------------

@query(f"with {V.OVERLAPS} select * from overlaps_v where ((a_end - a_start) + (b_end - b_start)) // 2 >= 3000 and diff < 1.5")
def overlaps_filtered(spark, d):
    return overlaps.filtered(V.overlaps(spark, d), 1.5)


_COLUMNS = ", ".join(OVERLAP_COLUMNS)
_SWAPPED = """b_read_id as a_read_id, a_read_id as b_read_id, strand, case when strand = 1 then b_len - b_end else b_start end as a_start, case when strand = 1 then b_len - b_start else b_end end as a_end, b_len as a_len,
  case when strand = 1 then a_len - a_end else a_start end as b_start, case when strand = 1 then a_len - a_start else a_end end as b_end, a_len as b_len, diff"""


@query(f"with {V.OVERLAPS} select {_SWAPPED} from overlaps_v")
def overlaps_swapped(spark, d):
    return overlaps.swapped(V.overlaps(spark, d))


@query(f"with {V.OVERLAPS} select a_read_id, b_read_id, strand, a_len - a_end as a_start, a_len - a_start as a_end, a_len, b_len - b_end as b_start, b_len - b_start as b_end, b_len, diff from overlaps_v")
def overlaps_revcomp(spark, d):
    return overlaps.mirrored(V.overlaps(spark, d))


@query(f"with {V.OVERLAPS} select {_COLUMNS} from overlaps_v union all select {_SWAPPED} from overlaps_v")
def overlaps_normalized(spark, d):
    return overlaps.normalized(V.overlaps(spark, d))


@query(f"with {V.OVERLAPS}, own as (select * from overlaps_v where a_read_id = 7 or b_read_id = 7), n as (select {_COLUMNS} from own union all select {_SWAPPED} from own) select * from n where a_read_id = 7")
def overlaps_of_read(spark, d):
    return overlaps.of_read(V.overlaps(spark, d), 7)


@query(f"with {V.OVERLAPS} select {_COLUMNS} from (select *, row_number() over (partition by a_read_id, b_read_id, strand order by diff, a_start - a_end, a_start, a_end, a_len, b_start, b_end, b_len) as place from overlaps_v) where place = 1")
def overlaps_best_per_pair(spark, d):
    return overlaps.best_per_pair(V.overlaps(spark, d))


_DEGREE = f"with {V.OVERLAPS}, p as (select distinct least(a_read_id, b_read_id) x, greatest(a_read_id, b_read_id) y from overlaps_v), deg as (select read_id, count(*) as n from (select x as read_id from p union all select y from p) group by 1)"


@query(f"{_DEGREE} select * from deg")
def overlaps_degree(spark, d):
    return overlaps.degrees(V.overlaps(spark, d))


@query(f"{_DEGREE} select stratum, n, count(*) as reads from (select cast(p_size // 10 as bigint) as stratum, coalesce(n, 0) as n from part left join deg on read_id = p_partkey) group by 1, 2")
def overlaps_degree_by_stratum(spark, d):
    strata = V.table(spark, d, "part").select(F.col("p_partkey").alias("read_id"), F.floor(F.col("p_size") / 10).alias("stratum"))
    return overlaps.stratified_degrees(V.overlaps(spark, d), strata)


@query(f"""with {V.OVERLAPS}, b as (select a_read_id as read_id, b_read_id as other_id, strand from overlaps_v union select b_read_id, a_read_id, strand from overlaps_v)
  select * from b union select read_id, read_id, 0 from b""")
def read_neighbours(spark, d):
    return overlaps.neighbours(V.overlaps(spark, d))


@query(f"""with {V.OVERLAPS} select a_read_id as read_id, b_read_id as other_id, strand, a_start - b_start as start from overlaps_v
  union all select b_read_id, a_read_id, strand, case when strand = 0 then b_start - a_start else (b_len - b_end) - (a_len - a_end) end from overlaps_v""")
def pileup_starts(spark, d):
    return overlaps.relative_starts(V.overlaps(spark, d))


@query(f"""with recursive {V.OVERLAPS}, r as materialized (select *, row_number() over (order by a_read_id, b_read_id, strand, a_start, a_end, a_len, b_start, b_end, b_len, diff) as node from overlaps_v),
  s as materialized (select x.node as u, y.node as v from r x join r y using (a_read_id, b_read_id, strand)
    where abs(x.a_start - y.a_start) <= 1000 and abs(x.a_end - y.a_end) <= 1000 and abs(x.b_start - y.b_start) <= 1000 and abs(x.b_end - y.b_end) <= 1000),
  reach(node, root) as (select u, v from s union select s.v, reach.root from reach join s on reach.node = s.u),
  lab as (select node, min(root) as label from reach group by 1)
  select {_COLUMNS} from (select r.*, row_number() over (partition by a_read_id, b_read_id, strand, label order by diff, a_start, a_end, a_len, b_start, b_end, b_len) as place from r join lab using (node)) where place = 1""")
def overlaps_reduced(spark, d):
    return overlaps.reduced(V.overlaps(spark, d), 1000)


# Graph ---------------------------------------------------------------------------------------------------------------

@query(f"with {V.OVERLAPS}, {V.CLASSIFIED} select * from classified_v")
def overlap_classes(spark, d):
    return graph.classified(V.overlaps(spark, d))


@query(f"with {V.OVERLAPS}, {V.CLASSIFIED}, {V.INNER} select read_id from inner_v")
def contained_reads(spark, d):
    return graph.contained_reads(graph.classified(V.overlaps(spark, d)))


@query(f"with {V.OVERLAPS}, {V.CLASSIFIED}, {V.INNER}, {V.EDGES} select * from edges_v")
def string_graph_edges(spark, d):
    return V.edges(spark, d)


@query(f"with {V.OVERLAPS}, {V.CLASSIFIED}, {V.INNER}, {V.EDGES} select * exclude place from (select *, row_number() over (partition by src_id, src_end order by length, diff, dst_id, dst_end) as place from edges_v) where place = 1")
def best_out_edges(spark, d):
    return overlaps.best_edges(V.edges(spark, d))


@query(f"""with recursive {V.OVERLAPS}, {V.CLASSIFIED}, {V.INNER}, {V.EDGES},
  e as materialized (select *, src_id || ':' || src_end as v, dst_id || ':' || dst_end as w from edges_v),
  m as (select v, max(length) + 100 as longest from e group by v),
  d as materialized (select distinct v, w from e),
  ways as materialized (select distinct a.v, a.w, a.length as n, b.w as x, b.length as m from e a join e b on b.v = a.w join d on d.v = a.v and d.w = b.w),
  elim as (select v, w, n, list(distinct x) as xs from ways join m using (v) where n + m <= longest group by v, w, n),
  l as materialized (select v, list({{w: w, xs: xs}} order by n, w) as l from elim group by v),
  r(v, k, gone) as (select v, cast(1 as bigint), cast([] as varchar[]) from l union all
    select r.v, k + 1, case when list_contains(gone, l[k].w) then gone else list_distinct(list_concat(gone, l[k].xs)) end from r join l on l.v = r.v where k <= len(l)),
  gone as (select distinct v, unnest(gone) as w from r union select v, x from ways where m < 100)
select src_id, src_end, dst_id, dst_end, length, diff from e anti join gone using (v, w)""")
def transitive_reduction(spark, d):
    return graph.transitive_reduction(V.edges(spark, d))


_CHAINS = """with c as (select o_custkey, o_orderkey, o_orderdate, lead(o_orderkey) over w as nxt, first_value(o_orderkey) over w as head
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))"""


@query(f"""{_CHAINS} select min(head) as src_id, last(nxt order by o_orderdate, o_orderkey) as dst_id, cast(sum(o_orderkey % 97 + 1) as int) as length,
  round(sum((o_orderkey % 97 + 1) * (o_orderkey % 7) * 1.0) / sum(o_orderkey % 97 + 1), 2) as diff, cast(count(*) as int) as n_edges from c where nxt is not null group by o_custkey""")
def simple_paths(spark, d):
    return graph.simple_paths(V.chains(spark, d)).select("src_id", "dst_id", "length", "diff", "n_edges")


@query(f"""{_CHAINS}, s as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as pos from c where nxt is not null),
  b as (select o_custkey, pos // 4 as block, count(*) as n_edges, sum(o_orderkey % 97 + 1) as length, arg_min(o_orderkey, pos) as src_id, arg_max(nxt, pos) as dst_id from s group by 1, 2)
  select cast(block as int) as block, cast(n_edges as int) as n_edges, cast(length as bigint) as length, src_id, dst_id,
    cast(coalesce(sum(length) over (partition by o_custkey order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as begin from b""")
def path_blocks(spark, d):
    """Paths in rows of four edges, with prefix sums."""
    rows = graph.path_blocks(graph.path_steps(V.chains(spark, d)), 4)
    return rows.select("block", "n_edges", "length", F.col("first.src_id").alias("src_id"), F.col("last.dst_id").alias("dst_id"), "begin")


@query("""with c as (select o_custkey, o_orderkey, o_orderdate, row_number() over w as place, count(*) over (partition by o_custkey) as n from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
  select string_agg(case when place = 1 then 'order ' || o_orderkey || o_orderpriority_ else right('order ' || o_orderkey || o_orderpriority_, cast(before as int)) end, '' order by place) as seq
  from (select c.*, o.o_orderpriority as o_orderpriority_, lag(c.o_orderkey % 97 + 1) over (partition by c.o_custkey order by place) as before from c join orders o using (o_orderkey)) where n > 1 group by o_custkey""")
def path_sequences(spark, d):
    own = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("seq"))
    return graph.path_sequences(graph.simple_paths(V.chains(spark, d)), own).select("seq")


@query(f"""with {V.OVERLAPS}, {V.CLASSIFIED}, {V.INNER}, {V.EDGES}, n as (select src_id as read_id, src_end as "end" from edges_v union select dst_id, dst_end from edges_v)
  select read_id, "end", round(p_retailprice / 1000, 2) as cover_rate from n left join part on p_partkey = read_id""")
def graph_nodes(spark, d):
    cover = V.table(spark, d, "part").select(F.col("p_partkey").alias("read_id"), F.round(F.col("p_retailprice") / 1000, 2).alias("cover_rate"))
    return graph.node_cover(V.edges(spark, d), cover)


# Labels and consensus ------------------------------------------------------------------------------------------------

@query(f"""with {V.UNITS}, u as (select o_custkey as target_id, read_id, unit_ord - 1 as ord, ulen % 5 as repr from units_v join orders on o_orderkey = read_id),
  s as (select target_id, read_id, count(*) as n from u group by 1, 2),
  p as (select a.target_id, a.read_id as a_read_id, b.read_id as b_read_id, a.ord - b.ord as shift, sum(abs(a.repr - b.repr)) as x, sum(20) as y from u a join u b on a.target_id = b.target_id and a.read_id < b.read_id group by 1, 2, 3, 4)
  select p.target_id, a_read_id, b_read_id, shift, round(x / y, 9) as diff from p join s sa on sa.target_id = p.target_id and sa.read_id = a_read_id join s sb on sb.target_id = p.target_id and sb.read_id = b_read_id
  where sa.n >= 3 and sb.n >= 3 and shift between 3 - sb.n and sa.n - 3""")
def diagonal_label_diff(spark, d):
    own = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.col("o_custkey").alias("target_id"))
    rows = V.units(spark, d).join(own, "read_id").select("target_id", "read_id", (F.col("unit_ord") - 1).alias("unit_ord"), (F.col("ulen") % 5).alias("repr_id"))
    grid = own.select("target_id").distinct().select("target_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("target_id", "i", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    known = grid.withColumns({"aln_len": F.lit(20), "n_diff": F.abs(F.col("i") - F.col("j"))})
    return labels.diagonal_diffs(rows, known).withColumn("diff", F.round("diff", 9))


@query()
def part_unit_diffs(spark, d):
    """Each part's type against the least type of its brand, in percent."""
    part = V.table(spark, d, "part")
    reprs = part.groupBy(F.col("p_brand").alias("repr_id")).agg(F.min("p_type").alias("seq"))
    return views.unit_diffs(part.select("p_partkey", F.col("p_brand").alias("repr_id"), F.col("p_type").alias("unit_seq")), reprs, cyclic=False)


@query()
def read_unit_distances(spark, d):
    """All units of neighbouring reads against each other, in percent."""
    rows = unit_sequences(spark, d).select("read_id", "unit_ord", "unit_seq")
    order = V.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    pairs = order.withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("next IS NOT NULL")
    return views.unit_distances(rows, pairs.select(F.col("o_orderkey").alias("a_read_id"), F.col("next").alias("b_read_id")))


@query()
def brand_consensus(spark, d):
    """The consensus of the names of each brand's parts, and of all parts: groups of any size."""
    part = V.table(spark, d, "part").select(F.explode(F.array("p_brand", F.lit("all"))).alias("repr_id"), F.col("p_name").alias("seq"))
    return pile.consensus_of(part, ["repr_id"])


@query()
def part_name_variants(spark, d):
    """Differences of each part's name from the consensus of its brand, counted."""
    part = V.table(spark, d, "part").select(F.col("p_brand").alias("repr_id"), F.col("p_name").alias("unit_seq"))
    reprs = pile.consensus_of(part, ["repr_id"], "unit_seq", "seq")
    return encode.detect_variants(part, reprs, 0.2)


@query()
def composition_likelihoods(spark, d):
    """Of all types of each brand's parts, given their consensus."""
    part = V.table(spark, d, "part").select(F.col("p_brand").alias("repr_id"), F.col("p_type").alias("seq"))
    voted = kept(pile.consensus_of(part, ["repr_id"]))
    return voted.join(pile.composition_of(part, voted, ["repr_id"]), "repr_id").select("repr_id", F.col("consensus").alias("cons"), F.round("log_prob", 6).alias("log_prob"))


@query()
def repeat_alignments(spark, d):
    """Self-alignments of the documents' letters a, c, g and t."""
    return detect.measured(detect.detect(spread(V.reads(spark, d), "read_id"), k=8, min_hits=10, cigars=False)).drop("cigar")


@query()
def repeat_units(spark, d):
    """Units of the repeats that repeated lines and words leave in the documents' letters: short ones, so all limits are."""
    return detect.find_units(spread(V.reads(spark, d), "read_id"), max_cv=0.2, min_len=60, k=8, min_hits=10, min_distance=10, min_span=60, min_repeat=60)


def _assembled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads of the repeats that the benchmark's items spell, their units and their overlaps."""
    rows = kept(V.genome_reads(spark, d).select("read_id", "seq", "length"))
    found = kept(detect.find_units(rows, min_len=250, min_hits=15, min_span=150, min_repeat=250))
    return rows, found, kept(overlap_search.overlaps_of_reads(found, rows))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clustered units around each of these reads, and the reads as they are turned for it."""
    rows, found, near = _assembled(spark, d)
    mates = clustering.involved(near, rows)
    return kept(clustering.clustered(clustering.synchronized(near, found, rows), mates)), mates


@query()
def item_units(spark, d):
    """Units of the reads that spell benchmark items."""
    return detect.find_units(V.genome_reads(spark, d), min_len=250, min_hits=15, min_span=150, min_repeat=250)


@query()
def item_boundary_matches(spark, d):
    """Where boundary units of these reads lie in other reads."""
    rows = V.genome_reads(spark, d).select("read_id", "seq", "length")
    return overlap_search.boundary_matches(kept(item_units(spark, d)), rows)


@query()
def item_overlaps(spark, d):
    return _assembled(spark, d)[2]


@query()
def item_contigs(spark, d):
    rows, _, found = _assembled(spark, d)
    paths = graph.simple_paths(graph.transitive_reduction(graph.string_graph(overlaps.best_per_pair(found))))
    return contigs.consensus_contigs(paths, found, rows, 200)


@query()
def item_labels(spark, d):
    return _labelled(spark, d)[0]


@query()
def item_labelled_overlaps(spark, d):
    """The second pass of overlaps, on the labels of item_labels."""
    rows, mates = _labelled(spark, d)
    return labels.labelled_overlaps(rows, mates, clustering.repr_units(rows))


@query()
def item_encodings(spark, d):
    """Each of these reads as copies of its item's unit."""
    units_of_items = V.genomes(spark, d).select("item_id", F.array(F.struct(F.lit(0).alias("repr_id"), F.col("unit").alias("seq"), F.lit(V.UNIT - 4).alias("low"), F.lit(V.UNIT + 4).alias("high"))).alias("reprs"))
    return encode.encode_with(spread(V.genome_reads(spark, d).join(units_of_items, "item_id"), "read_id"))


def _item_repeats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encodings of these reads by item, the reads, and the items' units."""
    rows = kept(item_encodings(spark, d)).withColumn("repr_id", F.floor(F.col("read_id") / 100).cast("int"))
    return rows, V.genome_reads(spark, d), V.genomes(spark, d).select(F.col("item_id").cast("int").alias("repr_id"), F.col("unit").alias("seq"))


@query()
def item_variant_vectors(spark, d):
    """Encodings of item_encodings with the variants that each complete copy of an item's unit has."""
    return encode.variant_vectors(*_item_repeats(spark, d), 0.04)


@query()
def item_variant_linkage(spark, d):
    """Which variants of an item's copies go together."""
    rows, reads, reprs = _item_repeats(spark, d)
    copies = kept(encode.complete_units(rows, reads))
    return encode.variant_linkage(kept(encode.variant_lists(copies, reprs, encode.variant_columns(copies, reprs, 0.04))))


@query()
def brand_name_alignments(spark, d):
    """Dot-plot points of neighbouring parts' names."""
    part = V.table(spark, d, "part")
    left = part.select(F.col("p_partkey").alias("pair_id"), F.col("p_partkey").alias("read_id"), F.col("p_name").alias("seq"))
    right = part.select((F.col("p_partkey") - 1).alias("pair_id"), F.col("p_partkey").alias("read_id"), F.col("p_name").alias("seq"))
    return views.dot_plot(left, right, 4)


@query()
def name_variants(spark, d):
    """Each part's name against the next one's, difference by difference."""
    part = V.table(spark, d, "part").select("p_partkey", "p_name")
    rows = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")), "p_partkey")
    return spread(rows, "p_partkey").select("p_partkey", F.explode(variant_list("p_name", "next")).alias("v")).select("p_partkey", "v.*")
