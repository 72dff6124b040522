"""Consensus piles and blocks of label diagonals against brute force, at sizes that force dealing."""

from __future__ import annotations

from collections import Counter, defaultdict
from random import Random

import pytest

import __spark_entry__
from tandemlake.functions import simulate as sim
from tandemlake.functions.consensus import consensus, log_prob_composition, variants
from tandemlake.operators import labels, pile
from tandemlake.operators.encode import encode_read


def made_groups(seed: int) -> dict[tuple[str, int], list[str]]:
    r = Random(seed)
    out = {}
    for k in range(12):
        base = sim.unique_seq(r, r.randint(1, 30))
        out["ab"[k % 2], k] = [sim.mutated(r, base, (85, 5, 5, 5)) for _ in range(r.choice([1, 2, 3, 40]))] + [base] * r.randint(0, 2)
    out["a", 99] = ["", "", "ac"]
    out["b", 98] = ["AcGN", "acgn", "AcG"]
    return out


@pytest.mark.parametrize("share", [2000, 5])
def test_consensus_of_groups(spark, monkeypatch, share):
    monkeypatch.setattr(pile, "SHARE", share)
    groups = made_groups(1)
    rows = spark.createDataFrame([(a, b, s) for (a, b), seqs in groups.items() for s in [*seqs, None]], "x string, w int, s string").repartition(3)
    voted = pile.consensus_of(rows, ["x", "w"], "s")
    assert {(r["x"], r["w"]): r["consensus"] for r in voted.collect()} == {k: consensus(sorted(v), "median") for k, v in groups.items()}
    found = {(r["x"], r["w"]): r["log_prob"] for r in pile.composition_of(rows, voted.filter("consensus <> ''"), ["x", "w"], "s").collect()}
    wanted = {k: (consensus(sorted(v), "median"), v) for k, v in groups.items()}
    assert found == pytest.approx({k: log_prob_composition(c, v) for k, (c, v) in wanted.items() if c})
    assert pile.consensus_of(rows.limit(0), ["x", "w"], "s").collect() == []


def test_a_large_group_is_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(pile, "SHARE", 50)
    rows = spark.range(3000).selectExpr("0 as k", "concat('acgtacgt', repeat('a', id % 7), cast(id as string)) as seq", "1L as n")
    from tandemlake.operators.components import dealt_join

    parts = dealt_join(rows, rows.limit(1).selectExpr("k", "seq as seed"), ["k"], 50).selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1500


def test_queries_equal_functions(spark):
    folder = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{folder}/part.parquet").toPandas()
    queries = __spark_entry__.queries()
    names = dict(part.groupby("p_brand")["p_name"].apply(list)) | {"all": part["p_name"].tolist()}
    voted = {k: consensus(sorted(v), "median") for k, v in names.items()}
    assert {tuple(r) for r in queries["brand_consensus"](spark, folder).collect()} == set(voted.items())
    expected = set()
    for k, v in names.items():
        if k != "all":
            counts = Counter(x for s in v for x in variants(voted[k], s))
            expected |= {(k, *x, n) for x, n in counts.items() if n / len(v) >= 0.2}
    assert {tuple(r)[:6] for r in queries["part_name_variants"](spark, folder).collect()} == expected and expected
    types = dict(part.groupby("p_brand")["p_type"].apply(list))
    found = {r["repr_id"]: (r["cons"], r["log_prob"]) for r in queries["composition_likelihoods"](spark, folder).collect()}
    for k, v in types.items():
        c = consensus(sorted(v), "median")
        assert found[k] == (c, pytest.approx(log_prob_composition(c, v), abs=1e-5))


def brute_diagonals(units: list[tuple], known: dict, least: int) -> dict:
    reads: dict = defaultdict(dict)
    for t, i, o, label in units:
        reads[t, i][o] = label
    out = {}
    for (t, a), x in reads.items():
        for (u, b), y in reads.items():
            if t != u or a >= b or min(len(x), len(y)) < least:
                continue
            for shift in range(least - len(y), len(x) - least + 1):
                met = [known[t, x[o], y[o - shift]] for o in x if o - shift in y and (t, x[o], y[o - shift]) in known]
                if met:
                    out[t, a, b, shift] = sum(d for _, d in met) / sum(n for n, _ in met)
    return out


@pytest.mark.parametrize("size", [768, 20])
def test_diagonals_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(labels, "BLOCK_UNITS", size)
    r = Random(2)
    units = [(t, i, o, r.randrange(4)) for t, n in ((1, 25), (2, 3), (3, 1)) for i in range(n) for o in range(r.randint(1, 9))]
    known = {(t, i, j): (20, abs(i - j)) for t in (1, 2, 3) for i in range(4) for j in range(4) if (i, j) != (0, 3)}
    frames = spark.createDataFrame(units, "target_id long, read_id long, unit_ord int, repr_id int"), spark.createDataFrame([(*k, *v) for k, v in known.items()], "target_id long, i int, j int, aln_len int, n_diff int")
    wanted = brute_diagonals(units, known, 3)
    found = labels.diagonal_diffs(*frames).collect()
    assert {tuple(x)[:4]: x["diff"] for x in found} == pytest.approx(wanted) and len(found) == len(wanted) > 200
    few = labels.diagonal_diffs(*frames, less_than=0.04).collect()
    assert {tuple(x)[:4] for x in few} == {k for k, v in wanted.items() if v < 0.04}


def test_encoding_goes_on_over_masked_and_unknown_bases():
    r = Random(3)
    unit = sim.unique_seq(r, 40)
    seq = "N" * 30 + unit + unit[:20] + "N" + unit[21:] + "N" * 30
    rows = encode_read(seq, [(0, unit, 38, 42)], 0.3, 0.2)
    assert [(s, e) for s, e, *_ in rows if e - s > 35] == [(30, 70), (70, 110)]


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_path_blocks_hold_what_paths_do(spark, size):
    """A long path, a circle and branches: blocks put together are the paths in one row, and their sequences."""
    from tandemlake.operators import graph
    from tandemlake.schemas import EDGES

    r = Random(4)
    ids = list(range(40))
    rows = [(a, "E", a + 1, "E", r.randint(0, 4), float(r.randint(0, 3))) for a in ids] + [(100 + k, "B", 100 + (k + 1) % 5, "B", 2, 1.0) for k in range(5)] + [(20, "E", 77, "E", 3, 0.0)]
    edges, reads = spark.createDataFrame(rows, EDGES), spark.createDataFrame([(k, sim.unique_seq(r, 9)) for k in [*range(41), *range(100, 105), 77]], "read_id long, seq string")
    steps = graph.path_steps(edges).cache()
    blocks = graph.path_blocks(steps, size).collect()
    assert all(len(b["edges"]) == b["n_edges"] <= size for b in blocks)
    whole = graph.simple_paths(edges).collect()
    found: dict = {}
    for b in sorted(blocks, key=lambda b: b["block"]):
        own = found.setdefault(b["path_id"], [])
        assert b["begin"] == sum(e["length"] for e in own)
        own += b["edges"]
    assert sorted(map(str, found.values())) == sorted(str(p["path"]) for p in whole) and 100 in {p["src_id"] for p in whole}
    pieces: dict = {}
    for b in sorted(graph.path_sequence_blocks(steps, reads, size).collect(), key=lambda b: b["block"]):
        assert b["begin"] == len(pieces.get(b["path_id"], ""))
        pieces[b["path_id"]] = pieces.get(b["path_id"], "") + b["seq"]
    assert sorted(pieces.values()) == sorted(x["seq"] for x in graph.path_sequences(graph.simple_paths(edges), reads).collect())


def test_diagonals_of_many_targets_are_summed_at_once(spark, monkeypatch):
    """Targets of a few units don't each take a call of their own."""
    calls, one = [], labels._diagonals
    monkeypatch.setattr(labels, "_diagonals", lambda *x: calls.append(1) or one(*x))
    units = [(t, i, o, (t + i + o) % 3) for t in range(40) for i in range(3) for o in range(4)]
    known = [(t, i, j, 20, abs(i - j)) for t in range(40) for i in range(3) for j in range(3)]
    batches = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, schema: batches.append((run, df.toArrow())) or df)
    labels.diagonal_diffs(spark.createDataFrame(units, "target_id long, read_id long, unit_ord int, repr_id int"), spark.createDataFrame(known, "target_id long, i int, j int, aln_len int, n_diff int"))
    (run, rows), = batches
    found = [tuple(x.values()) for b in run(iter(rows.combine_chunks().to_batches())) for x in b.to_pylist()]
    wanted = brute_diagonals(units, {(t, i, j): (n, d) for t, i, j, n, d in known}, 3)
    assert {x[:4]: x[4] for x in found} == pytest.approx(wanted) and len(found) == len(wanted) and len(calls) == 1 < rows.num_rows
