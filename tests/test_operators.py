from __future__ import annotations

from random import Random

import pandas as pd
import pytest

import __spark_entry__
from tandemlake import __main__ as command
from tandemlake.functions import kernels
from tandemlake.functions import simulate as sim
from tandemlake.functions.align import align, align_cyclic, dovetail, revcomp
from tandemlake.functions.clustering import SplitMerge
from tandemlake.functions.kernels import register
from tandemlake.operators import clustering, components, contigs, detect, graph, labels, overlap_search, overlaps, simulate, views
from tandemlake.operators.components import min_labels
from tandemlake.plans import stand_ins
from tandemlake.schemas import EDGES, OVERLAPS
from tandemlake.sources import Options, aligned_paths, fasta_lines, read_fasta, read_range, read_table, repeat_reads, write_fasta, write_stage, write_table


def edges_of(spark, *rows):
    return spark.createDataFrame([(a, "E", b, "E", n, float(d)) for a, b, n, d in rows], EDGES)


def test_swap_and_mirror(spark):
    one = spark.createDataFrame([(1, 2, 1, 30, 100, 100, 0, 70, 90, 1.0)], OVERLAPS)
    assert tuple(overlaps.swapped(one).first()) == (2, 1, 1, 20, 90, 90, 0, 70, 100, 1.0)
    assert tuple(overlaps.mirrored(one).first()) == (1, 2, 1, 0, 70, 100, 20, 90, 90, 1.0)
    for f in (overlaps.swapped, overlaps.mirrored):
        assert f(f(one)).collect() == one.collect()


@pytest.mark.parametrize(("strand", "kind", "expected"), [(0, "suffix-prefix", {(2, "B", 1, "B", 30), (1, "E", 2, "E", 20)}), (1, "suffix-suffix", {(2, "E", 1, "B", 30), (1, "E", 2, "B", 20)})])
def test_edges(spark, strand, kind, expected):
    one = spark.createDataFrame([(1, 2, strand, 30, 100, 100, 0, 70, 90, 1.0)], OVERLAPS)
    assert graph.classified(one).first()["kind"] == kind
    assert {tuple(r)[:5] for r in graph.string_graph(one).collect()} == expected


def test_filter_by_mean_length(spark):
    rows = [(1, 2, 0, 0, 3000, 9000, 0, 2999, 9000, 1.0), (1, 3, 0, 0, 3000, 9000, 0, 3000, 9000, 1.0), (1, 4, 0, 0, 3000, 9000, 0, 3000, 9000, 2.0)]
    assert [r["b_read_id"] for r in overlaps.filtered(spark.createDataFrame(rows, OVERLAPS)).collect()] == [3]


def test_reduced_follows_chains(spark):
    rows = [(1, 2, 0, s, 500, 900, 0, 400, 900, d) for s, d in ((0, 1.0), (90, 2.0), (180, 3.0), (400, 4.0))]
    assert [(r["a_start"], r["diff"]) for r in overlaps.reduced(spark.createDataFrame(rows, OVERLAPS)).orderBy("a_start").collect()] == [(0, 1.0), (400, 4.0)]


def test_transitive_edge_goes(spark):
    found = graph.transitive_reduction(edges_of(spark, (1, 2, 10, 0), (2, 3, 10, 0), (1, 3, 15, 0)))
    assert {(r["src_id"], r["dst_id"]) for r in found.collect()} == {(1, 2), (2, 3)}


def sequential_reduction(edges, fuzz):
    out = {}
    for v, w, n in edges:
        out.setdefault(v, []).append((n, w))
    gone = set()
    for v, targets in out.items():
        mark = {w: "in" for _, w in targets}
        longest = max(n for n, _ in targets) + fuzz
        for n, w in sorted(targets):
            if mark[w] == "in":
                for m, x in sorted(out.get(w, ())):
                    if mark.get(x) == "in" and n + m <= longest:
                        mark[x] = "out"
        for _, w in sorted(targets):
            for m, x in out.get(w, ()):
                if m < fuzz and mark.get(x) == "in":
                    mark[x] = "out"
        gone |= {(v, w) for w, state in mark.items() if state == "out"}
    return {(v, w) for v, w, _ in edges} - gone


def test_transitive_reduction_equals_sequential_marking(spark):
    r = Random(1)
    edges = [(a, b, r.randint(1, 400)) for a in range(25) for b in range(25) if a != b and r.random() < 0.2]
    found = graph.transitive_reduction(edges_of(spark, *((a, b, n, 0) for a, b, n in edges)))
    assert {(x["src_id"], x["dst_id"]) for x in found.collect()} == sequential_reduction(edges, 100)


def test_two_step_ways_go_round_hubs(spark, monkeypatch):
    """All ways, also over edges from a node to itself; a hub's in-edges must not meet all its out-edges."""
    r = Random(5)
    edges = {(str(r.randrange(14)), str(r.randrange(14)), r.randint(1, 9)) for _ in range(90)}
    edges |= {(f"i{k}", "hub", 1) for k in range(300)} | {("hub", f"o{k}", 2) for k in range(300)} | {("i7", "o9", 3)}
    direct = {(v, w) for v, w, _ in edges}
    expected = {(v, w, n, x, m) for v, w, n in edges for u, x, m in edges if u == w and (v, x) in direct}
    passed = []
    monkeypatch.setattr(graph, "kept", lambda df: passed.append(df.count()) or df.checkpoint())
    found = graph.two_step_ways(spark.createDataFrame(sorted(edges), "v string, w string, n int"))
    assert {tuple(x) for x in found.select("v", "w", "n", "x", "m").collect()} == expected and ("i7", "hub", 1, "o9", 2) in expected
    assert passed[0] <= len(expected) + 5


def test_transitive_reduction_shuffles_edges_once(spark, monkeypatch):
    """What is grouped and stored is read again; no later step shuffles all edges for a join."""
    plans = []
    monkeypatch.setattr(graph, "stored", lambda df: plans.append(df) or components.stored(df))
    r = Random(2)
    edges = [(a, b, r.randint(1, 400)) for a in range(25) for b in range(25) if a != b and r.random() < 0.2]
    found = graph.transitive_reduction(edges_of(spark, *((a, b, n, 0) for a, b, n in edges)))
    assert {(x["src_id"], x["dst_id"]) for x in found.collect()} == sequential_reduction(edges, 100)
    assert len(plans) == 2 and plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # of edges that go by the ways only those that a filter lets through are stored, as pairs of numbers
    assert dict(plans[1].dtypes)["v"] == "bigint" and "Exchange" not in plans[1]._jdf.queryExecution().executedPlan().toString()


def test_contained_reads_are_made_before_overlaps_are_joined_with_them(spark):
    """Overlaps aren't shuffled for a join with a few reads, whatever the planner takes these for; edges are shuffled once."""
    rows = [(a, a + 1, 0, 30, 100, 100, 0, 70, 90, 1.0) for a in range(50)] + [(60, 3, 0, 0, 100, 100, 0, 100, 900, 1.0)]
    plan = graph.string_graph(spark.createDataFrame(rows, OVERLAPS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("far", [0, 1 << 62, -(1 << 63)])
def test_transitive_reduction_of_any_ids_and_of_parallel_edges(spark, far):
    """Ids that make no numbers of nodes, ties that names decide, edges twice in the table or of two lengths, and those from a node to itself."""
    r = Random(8)
    ids = [9, 10, 100, 11, -3, far, far + 1, far + 12]
    edges = [(a, b, n) for a in ids for b in ids for n in r.sample((50, 120, 120, 300), 2) if r.random() < 0.45]
    rows = [(a, x, b, x, n, d) for a, b, n in edges for x in "BE" for d in (1.0, 2.0)[: 1 + n % 3]] + [(9, "E", 10, "E", 50, None)] * 2
    out = {}
    for a, x, b, y, n, _ in rows:
        out.setdefault(f"{a}:{x}", set()).add((n, f"{b}:{y}"))
    gone = set()
    for v, steps in out.items():
        targets, longest, own = {w for _, w in steps}, max(n for n, _ in steps) + 100, set()
        ways = [(n, w, x, m) for n, w in steps for m, x in out.get(w, ()) if x in targets]
        for n, w in sorted(steps):
            if w not in own:
                own |= {x for k, u, x, m in ways if (k, u) == (n, w) and n + m <= longest}
        gone |= {(v, w) for w in own | {x for _, _, x, m in ways if m < 100}}
    expected = [e for e in rows if (f"{e[0]}:{e[1]}", f"{e[2]}:{e[3]}") not in gone]
    found = [tuple(x) for x in graph.transitive_reduction(spark.createDataFrame(rows, EDGES)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str) and 0 < len(expected) < len(rows)


def test_equal_pairs_of_a_batch_are_aligned_once(monkeypatch):
    calls = []
    monkeypatch.setattr(kernels, "align", lambda q, t, mode: calls.append((q, t)) or align(q, t, mode))
    found = kernels.aligner("global").func(pd.Series(["acgt", None, "acgt", "aa"]), pd.Series(["acct", "a", "acct", "aa"]))
    assert found["n_diff"].tolist() == [1, pd.NA, 1, 0] and found["cigar"].tolist() == ["==X=", None, "==X=", "=="]
    assert calls == [("acgt", "acct"), ("aa", "aa")]


def test_dot_plots_do_not_broadcast_words(spark):
    rows = spark.createDataFrame([(1, 1, "acgta")], "pair_id int, read_id int, seq string")
    found = views.dot_plot(rows, rows, 4)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in found.collect()} == {(1, 1, 0, 0), (1, 1, 1, 1)}


def test_simple_paths(spark):
    found = {(r["src_id"], r["dst_id"], r["length"], r["diff"], r["n_edges"]) for r in graph.simple_paths(edges_of(spark, (1, 2, 10, 1), (2, 3, 30, 2), (3, 4, 5, 1), (3, 5, 5, 1), (8, 9, 1, 1), (9, 8, 1, 1))).collect()}
    assert found == {(1, 3, 40, 1.75, 2), (3, 4, 5, 1.0, 1), (3, 5, 5, 1.0, 1), (8, 8, 2, 1.0, 2)} or found == {(1, 3, 40, 1.75, 2), (3, 4, 5, 1.0, 1), (3, 5, 5, 1.0, 1), (9, 9, 2, 1.0, 2)}


def test_components(spark):
    r = Random(2)
    pairs = [(f"{r.randrange(60):03}", f"{r.randrange(60):03}") for _ in range(40)] + [(f"x{k:02}", f"x{k + 1:02}") for k in range(30)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {tuple(x) for x in min_labels(spark.createDataFrame(pairs, "u string, v string")).collect()} == {(x, root(x)) for x in parent}


def test_fasta_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([(1, "a b", 0, "acgt" * 60, 240), (2, "c", 0, "ac", 2)], "read_id long, name string, strand tinyint, seq string, length int")
    assert fasta_lines(reads).orderBy("value").first()["value"].split("\n")[0] == ">a b"
    write_fasta(reads, f"{tmp_path}/x")
    assert {(r["name"], r["seq"], r["length"]) for r in read_fasta(spark, f"{tmp_path}/x").collect()} == {("a b", "acgt" * 60, 240), ("c", "ac", 2)}
    back = write_stage(reads, f"{tmp_path}/stage", "read_id", 2)
    assert read_range(back, 2, 9).count() == 1
    write_table(reads, f"{tmp_path}/tsv")
    assert read_table(spark, f"{tmp_path}/tsv").count() == 2


def test_command_goes_on_where_it_was(spark, tmp_path):
    write_fasta(simulate.tandem_reads(spark, 3, 300, 8), f"{tmp_path}/fasta")
    (tmp_path / "o.toml").write_text('db_prefix = "x"\n[peaks]\nlow = 250\nhigh = 350\nmin_covered = 1000\nmin_density = 0.001\ndeviation = 0.1\n[detection]\nk = 12\n')
    command.main([f"{tmp_path}/o.toml", f"{tmp_path}/fasta", f"{tmp_path}/out"])
    found = {x: spark.read.parquet(f"{tmp_path}/out/{x}").count() for x in ("reads", "alignments", "units", "selected")}
    assert found["reads"] == found["selected"] == 3 and found["units"] > 15
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    (tmp_path / "out/selected/_SUCCESS").unlink()
    command.main([f"{tmp_path}/o.toml", f"{tmp_path}/fasta", f"{tmp_path}/out"])
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert {p.parts[-2] for p, _ in set(before.items()) ^ set(after.items())} == {"selected"}


def test_options(tmp_path):
    (tmp_path / "o.toml").write_text('db_prefix = "x"\n[peaks]\nlow = 3\n[more]\na = 1\n')
    o = Options.load(tmp_path / "o.toml")
    assert (o.db_prefix, o.peaks, o.other) == ("x", {"low": 3}, {"more": {"a": 1}})
    (tmp_path / "p.toml").write_text("")
    with pytest.raises(ValueError):
        Options.load(tmp_path / "p.toml")


def test_paths_of_chosen_alignments(spark, tmp_path):
    chosen = spark.createDataFrame([(1, 0, 2, 5, 2, 5)], "read_id long, aln_ord int, ab int, ae int, bb int, be int")
    listing = spark.createDataFrame([(1, 2, 5, 2, 5, "aac-gt", "a[|*|]", "aacagt"), (1, 9, 9, 9, 9, "a", "?", "a")], "read_id long, ab int, ae int, bb int, be int, a_text string, symbols string, b_text string")
    assert [(r["aln_ord"], r["cigar"]) for r in aligned_paths(chosen, listing).collect()] == [(0, "=I=")]
    reads = spark.createDataFrame([(k, "acgt" * 25, 100) for k in range(50)], "read_id long, seq string, length int")
    assert write_stage(reads, f"{tmp_path}/blocks", block_bases=1100).count() == 50
    assert len(list((tmp_path / "blocks").glob("*.parquet"))) == 5


def test_repeat_reads(spark):
    reads = spark.createDataFrame([(1, "acgt"), (2, "ac")], "read_id long, seq string")
    repeats = spark.createDataFrame([(1, 0, 0, 4)], "read_id long, tr_ord int, start int, end int")
    alns = spark.createDataFrame([(1, 3, 4, 0, 1, "="), (1, 2, 4, 1, 3, "==")], "read_id long, ab int, ae int, bb int, be int, cigar string")
    rows = repeat_reads(reads, repeats, alns).collect()
    assert len(rows) == 1 and [a["ab"] for a in rows[0]["alignments"]] == [2, 3]
    assert repeat_reads(reads, repeats, alns, return_all=True).count() == 2


def test_from_alignments_to_units(spark):
    reads = simulate.tandem_reads(spark, 2, 300, 8)
    alns = detect.detect(reads)
    chosen = detect.chosen_alignments(detect.repeats_of(alns), alns)
    cut = detect.cut_units(chosen)
    assert cut.select("read_id").distinct().count() == 2
    assert {tuple(r) for r in cut.collect()} == {tuple(r) for r in detect.find_units(reads).collect()}


def test_contigs_lie_in_the_genome(spark):
    reads = simulate.reads_of_genomes(spark, 2, 200, 14, flank=1500, depth=6, length=2500).cache()
    genomes = [simulate.hetero_genome(f"111:{k}", 200, 14, 4.0, 1500) for k in range(2)]
    units = detect.find_units(reads, min_len=400).cache()
    found = overlap_search.overlaps_of_reads(units, reads).cache()
    origin = {r["read_id"]: r["genome"] for r in reads.collect()}
    assert found.count() > 0 and all(origin[r["a_read_id"]] == origin[r["b_read_id"]] for r in found.collect())
    paths = graph.simple_paths(graph.transitive_reduction(graph.string_graph(overlaps.best_per_pair(found))))
    inside = lambda s: any(s in g or revcomp(s) in g for g in genomes)
    raw = [r["seq"] for r in graph.path_sequences(paths, reads).collect()]
    assert raw and all(map(inside, raw))
    assert all(inside(r["seq"]) for r in contigs.consensus_contigs(paths, found, reads).collect())


@pytest.mark.parametrize("least", [0.2, 0.4, 0.75, 1.0])
def test_containment_loses_no_pair(spark, least):
    r = Random(3)
    common = "".join(r.choice("acgt") for _ in range(40))
    seqs = ["".join(r.choice((common, "acgtacgt", "".join(r.choice("acgt") for _ in range(15)))) for _ in range(r.randint(0, 6))) for _ in range(40)]
    seqs += [seqs[5], seqs[6][:-20], "", "acg"]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    words = [{s[i : i + 7] for i in range(len(s) - 6)} for s in seqs]
    expected = {(i, j, len(x & y), len(x)) for i, x in enumerate(words) for j, y in enumerate(words) if i != j and x and len(x & y) / len(x) >= least}
    found = overlap_search.containment(reads.withColumnRenamed("read_id", "query_id"), reads, 7, least).collect()
    assert {tuple(x) for x in found} == expected and len(found) == len(expected)


def test_labelled_overlaps_equal_brute_force(spark):
    """Reads of one repeat, cut at its units and labelled with the true ones, some turned; every pair and shift is tried."""
    r = Random(9)
    kinds = [sim.unique_seq(r, 60) for _ in range(4)]
    kinds[3] = sim.mutated(r, kinds[2], (95, 5, 0, 0))
    order = [r.randrange(4) for _ in range(30)]
    reads, units = [], []
    for i, (a, b) in enumerate([(0, 9), (3, 14), (5, 8), (10, 22), (16, 30), (2, 4)]):
        seq, strand = "".join(kinds[k] for k in order[a:b]), i % 2
        reads.append((1, i, strand, seq, len(seq)))
        units += [(1, i, strand, n, 60 * n, 60 * n + 60, k) for n, k in enumerate(order[a:b])]
    frames = (
        spark.createDataFrame(units, "target_id long, read_id long, strand int, unit_ord int, start int, end int, repr_id int"),
        spark.createDataFrame(reads, "target_id long, read_id long, strand int, seq string, length int"),
        spark.createDataFrame([(1, k, s) for k, s in enumerate(kinds)], "target_id long, repr_id int, seq string"),
    )
    found = labels.labelled_overlaps(*frames, max_units_diff=0.03, max_seq_diff=0.04).collect()
    expected = set()
    sequence_of, label = {i: s for _, i, _, s, _ in reads}, {i: [k for _, j, _, _, _, _, k in units if j == i] for i in range(6)}
    for i in range(6):
        for j in range(i + 1, 6):
            for shift in range(3 - len(label[j]), len(label[i]) - 2):
                pairs = [(label[i][n], label[j][n - shift]) for n in range(len(label[i])) if 0 <= n - shift < len(label[j])]
                alns = [align(kinds[x], kinds[y]) for x, y in pairs]
                if len(pairs) < 3 or min(len(label[i]), len(label[j])) < 3:
                    continue
                diff = sum(x.n_diff for x in alns) / sum(x.length for x in alns)
                if diff >= 0.03:
                    continue
                one = dovetail(sequence_of[i], sequence_of[j], 60 * max(shift, 0), 60 * max(-shift, 0))
                if one is None or one[5] / one[4] >= 0.04:
                    continue
                (s, e, t, f), (n, m) = one[:4], (len(sequence_of[i]), len(sequence_of[j]))
                if i % 2:
                    s, e, t, f = n - e, n - s, m - f, m - t
                expected.add((i, j, (i ^ j) % 2, s, e, n, t, f, m, round(100 * diff, 2)))
    assert {tuple(x) for x in found} == expected and len(expected) >= 4


def test_unit_distances_and_diffs_equal_the_aligner(spark):
    r = Random(4)
    seqs = {(i, n): sim.unique_seq(r, r.randint(3, 9)) for i in range(3) for n in range(i + 1)}
    units = spark.createDataFrame([(i, n, s) for (i, n), s in seqs.items()], "read_id long, unit_ord int, unit_seq string")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (1, 2)], "a_read_id long, b_read_id long")
    percent = lambda x: round(100 * x.n_diff / x.length, 2)
    for cyclic, one in ((False, align), (True, align_cyclic)):
        found = {tuple(x)[:4]: x["diff"] for x in views.unit_distances(units, pairs, cyclic).collect()}
        assert found == pytest.approx({(a, b, i, j): percent(one(seqs[a, i], seqs[b, j])) for a, b in ((0, 1), (1, 2)) for i in range(a + 1) for j in range(b + 1)}, abs=0.011)
        reprs = spark.createDataFrame([(0, "acgtac"), (1, "ttgca")], "repr_id int, seq string")
        rows = units.selectExpr("read_id", "unit_ord", "cast(unit_ord % 2 as int) as repr_id", "unit_seq")
        found = {(x["read_id"], x["unit_ord"]): x["diff"] for x in views.unit_diffs(rows, reprs, cyclic).collect()}
        assert found == pytest.approx({k: percent(one(s, ("acgtac", "ttgca")[k[1] % 2])) for k, s in seqs.items()}, abs=0.011)


def test_quality_values_reach_the_clusters(spark, monkeypatch):
    seen = []

    class Recorder(SplitMerge):
        def __init__(self, units, quals=None, alpha=1.0, seed=0):
            super().__init__(units, quals, alpha, seed)
            seen.append((units, quals))

    monkeypatch.setattr(clustering, "SplitMerge", Recorder)
    reads = spark.createDataFrame([(1, "acgtac", 6, [1, 2, 3, 4, 5, 6])], "read_id long, seq string, length int, quals array<int>")
    near = spark.createDataFrame([(1, 1, 1)], "read_id long, other_id long, strand int")
    monkeypatch.setattr(clustering, "neighbours", lambda _: near)
    mates = clustering.involved(None, reads)
    assert [(r["seq"], r["quals"]) for r in mates.collect()] == [("gtacgt", [6, 5, 4, 3, 2, 1])]
    synced = spark.createDataFrame([(1, 1, 1, 0, 0, 3, 0), (1, 1, 1, 1, 3, 6, 0)], "target_id long, read_id long, strand int, unit_ord int, start int, end int, repr_id int")
    captured = {}
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", lambda self, run, schema: captured.update(run=run), raising=True)
    clustering.clustered(synced, mates)
    frame = pd.DataFrame({"target_id": [1, 1], "read_id": [1, 1], "strand": [1, 1], "unit_ord": [0, 1], "start": [0, 3], "end": [3, 6], "unit": ["gta", "cgt"], "quals": [[6, 5, 4], [3, 2, 1]]})
    assert list(captured["run"](frame).columns)[-2:] == ["repr_id", "repr_seq"] and seen == [(["gta", "cgt"], [[6, 5, 4], [3, 2, 1]])]


def test_sql_registration(spark):
    register(spark)
    assert spark.sql("select align_global('acgt', 'aagt').n_diff as n").first()["n"] == 1
    assert spark.sql("select consensus(s) as c from values ('acgt'), ('acgt'), ('aagt') t(s)").first()["c"] == "acgt"


def test_reduced_links_only_what_is_near(spark, monkeypatch):
    """Against brute force, with repeated rows and nulls; what is near is numbered, so that no text of all columns is shuffled."""
    r = Random(4)
    rows = [(r.randrange(6), r.randrange(6, 9), r.randrange(2), r.choice((0, 90, 150, 700)), r.choice((900, 950, 1400)), 2000, r.choice((0, 60)), 1500, 2000, float(r.randrange(4))) for _ in range(60)]
    rows += [(50 + i, 60 + i, 0, 100, 900, 2000, 0, 1500, 2000, 1.0) for i in range(200)] + [rows[0], (1, 6, 0, None, 900, 2000, 0, 1500, 2000, 1.0)] + [(1, 6, 0, None, 900, 2000, 0, 1500, 2000, 1.0)]
    searched, search = [], overlaps.min_labels
    monkeypatch.setattr(overlaps, "min_labels", lambda steps: searched.append(steps.dtypes) or search(steps))
    found = sorted((tuple(x) for x in overlaps.reduced(spark.createDataFrame(rows, OVERLAPS)).collect()), key=str)
    nodes = list(dict.fromkeys(rows))
    near = lambda x, y: x[:3] == y[:3] and all(x[c] is not None and y[c] is not None and abs(x[c] - y[c]) <= 100 for c in (3, 4, 6, 7))
    label = {x: i for i, x in enumerate(nodes)}
    for _ in nodes:
        for x in nodes:
            label[x] = min([label[x], *(label[y] for y in nodes if near(x, y))])
    order = lambda x: (x[9], *(-1 if v is None else v for v in x))
    wanted = sorted((min((x for x in nodes if label[x] == i), key=order) for i in set(label.values())), key=str)
    assert found == wanted and len(wanted) < len(nodes) - 5 and searched == [[("u", "bigint"), ("v", "bigint")]]


def test_tasks_of_units_and_overlaps_grow_in_number(spark, monkeypatch):
    """A task sorts as many rows of a larger table as of a small one."""
    monkeypatch.setattr(components, "TASK_ROWS", 500)
    for rows in (stand_ins.units(spark, "/root/testdata/sf0.001"), stand_ins.overlaps(spark, "/root/testdata/sf0.001"), __spark_entry__.queries()["merged_intervals"](spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() >= 12


def test_parts_of_contigs_are_kept_for_the_vote(spark, monkeypatch):
    """Reads are refined once, though the vote passes over their parts more than once."""
    asked, keep = [], contigs.kept
    monkeypatch.setattr(contigs, "kept", lambda df: asked.append(df.columns) or keep(df))
    r = Random(8)
    genome = sim.unique_seq(r, 900)
    reads = spark.createDataFrame([(1, genome[:600], 600), (2, genome[300:], 600)], "read_id long, seq string, length int")
    found = spark.createDataFrame([(1, 2, 0, 300, 600, 600, 0, 300, 600, 0.0)], OVERLAPS)
    made = contigs.consensus_contigs(graph.simple_paths(graph.string_graph(found)), found, reads, 300)
    seqs = {x["seq"] for x in made.collect()}
    assert seqs and seqs <= {genome, revcomp(genome)} and ["path_id", "w", "part"] in asked
