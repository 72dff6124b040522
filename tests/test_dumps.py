"""Text dumps read to the same rows however the files are split."""

from __future__ import annotations

from random import Random

import pytest

from tandemlake.functions.align import align, cigar_of_text, gapped
from tandemlake.sources import dumps


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Files of 60 reads, and the rows that they hold."""
    path, r = tmp_path_factory.mktemp("dumps"), Random(1)
    reads, db, las = [], ["+ R 60", "+ M 1", "+ T0 99", "@ T0 4"], ["+ P 40", "% P 40"]
    trs, alns = {}, []
    for i in range(1, 61):
        name, seq = f"m{i % 3}/{i}/0_{i * 7}", "".join(r.choice("acgt") for _ in range(r.randint(1, 260)))
        reads.append((i, name, seq))
        trs[i] = [(k, 10 * k, 10 * k + r.randint(1, 9)) for k in range(r.choice([0, 0, 1, 3]))]
        db += [f"R {i}", f"H 2 m{i % 3}", f"L {i} 0 {i * 7}", "T0 " + " ".join(map(str, [len(trs[i]), *(x for _, s, e in trs[i] for x in (s, e))]))]
        for _ in range(r.choice([0, 1, 2])):
            bb = r.randrange(50)
            alns.append((i, bb + r.randint(1, 40), 200, bb, 150 + r.randrange(20)))
            las += [f"P {i} {i} n", "C " + " ".join(map(str, alns[-1][1:])), "D 3"]
    wrapped = lambda s: "\n".join(s[k : k + 70] for k in range(0, len(s), 70))
    (path / "reads.fasta").write_text("".join(f">{n}\n{wrapped(s)}\n" for _, n, s in reads))
    (path / "db.txt").write_text("\n".join(db) + "\n")
    (path / "las.txt").write_text("\n".join(las) + "\n")
    return path, reads, trs, alns


@pytest.fixture(params=[200, 1000, 1 << 20])
def split(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_dumps_at_any_split(spark, made, split):
    path, reads, trs, alns = made
    dump = dumps.read_db_dump(spark, f"{path}/db.txt")
    assert split > 10_000 or dump.rdd.getNumPartitions() > 2
    assert {(r["read_id"], r["name"], tuple(map(tuple, r["trs"]))) for r in dump.collect()} == {(i, n, tuple(trs[i])) for i, n, _ in reads}
    assert sorted(map(tuple, dumps.read_alignment_dump(spark, f"{path}/las.txt").collect())) == sorted(alns)
    for everything in (False, True):
        found = dumps.load_repeat_reads(spark, f"{path}/reads.fasta", f"{path}/db.txt", f"{path}/las.txt", (5, 50), everything).collect()
        wanted = {i: (n, s, [t for t in trs[i]], sorted((a - b, a, ae, b, be) for j, a, ae, b, be in alns if j == i)) for i, n, s in reads if 5 <= i <= 50 and (trs[i] or everything)}
        assert {r["read_id"]: (r["name"], r["seq"], [tuple(t) for t in r["trs"]], [tuple(a)[:5] for a in r["alignments"]]) for r in found} == wanted and len(found) == len(wanted)


def test_listed_paths(spark, tmp_path):
    r = Random(2)
    expected, text = [], []
    for n in range(12):
        x = "".join(r.choice("acgt") for _ in range(r.randint(20, 150)))
        y = "".join(r.choice("acgt") if r.random() < 0.1 else c for c in x if r.random() > 0.05)
        a, b = gapped(x, y, align(x, y).cigar)
        marks = "".join("|" if c == d else "*" for c, d in zip(a, b, strict=True))
        rows = [f"gg[{a}]", f"  [{marks}]", f"tt[{b}]"]
        key = (1000 + n, 20 + n, 1200 + n, n, 1100)
        text.append("\t".join(f"{k:,}" for k in (key[0], key[0], *key[1:], 7)))
        text += [row[k : k + 40] for k in range(0, len(rows[0]), 40) for row in rows]
        expected.append((*key, cigar_of_text(*rows)))
    (tmp_path / "list.txt").write_text("\n".join(text) + "\n")
    chosen = spark.createDataFrame([(*x[:5], "") for x in expected if x[0] % 2] + [(1, 2, 3, 4, 5, "")], "read_id long, ab int, ae int, bb int, be int, cigar string")
    found = sorted(map(tuple, dumps.load_paths(spark, chosen, f"{tmp_path}/list.txt").collect()))
    assert found == [x for x in expected if x[0] % 2] and all("=" in x[-1] for x in found)


def test_empty_dumps(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "head.txt").write_text("+ R 0\n+ P 0\n")
    for name in ("none", "head"):
        for read in (dumps.read_db_dump, dumps.read_alignment_dump, dumps.read_alignment_listing):
            assert read(spark, f"{tmp_path}/{name}.txt").collect() == []
