"""Stages are made again when, and only when, what they depend on has changed; from FASTA to contigs and encodings."""

from __future__ import annotations

import pytest

from tandemlake import __main__ as command
from tandemlake import jobs
from tandemlake.functions.align import align, revcomp
from tandemlake.jobs import Job, Stage, state_of_files
from tandemlake.plans import stand_ins as V
from tandemlake.sources import Options, write_fasta


def chain(spark, path, add=1, times=2):
    return [
        Stage("a", (), lambda: spark.read.text(path), files=(path,)),
        Stage("b", ("a",), lambda t, add: t.selectExpr(f"cast(value as int) + {add} as x"), {"add": add}),
        Stage("c", ("b",), lambda t, times: t.selectExpr(f"x * {times} as y"), {"times": times}),
        Stage("d", ("a", "c"), lambda a, c: c.crossJoin(a.selectExpr("count(*) as n"))),
    ]


def test_only_what_follows_a_change_is_made_again(spark, tmp_path):
    (tmp_path / "in").write_text("1\n2\n")
    out, path = f"{tmp_path}/out", f"{tmp_path}/in"
    job = lambda **o: Job(spark, out, chain(spark, path, **o))

    def made(one, until="d"):
        rows = sorted(map(tuple, one.table(until).collect()))
        return one.made, rows

    assert made(job(), "b") == (["a", "b"], [(2,), (3,)])
    assert made(job()) == (["c", "d"], [(4, 2), (6, 2)])
    assert made(job()) == ([], [(4, 2), (6, 2)])
    assert made(job(times=3)) == (["c", "d"], [(6, 2), (9, 2)])
    assert made(job(times=3, add=0)) == (["b", "c", "d"], [(3, 2), (6, 2)])
    (tmp_path / "in").write_text("1\n2\n3\n")
    assert made(job(times=3, add=0)) == (["a", "b", "c", "d"], [(3, 3), (6, 3), (9, 3)])
    assert state_of_files(spark, path) == state_of_files(spark, path)
    (tmp_path / "out/c/_SUCCESS").unlink()
    assert made(job(times=3, add=0))[0] == ["c"]
    spark.range(3).write.mode("overwrite").parquet(f"{out}/b")  # another table in its place
    assert made(job(times=3, add=0)) == (["b"], [(3, 3), (6, 3), (9, 3)])


def test_a_table_that_was_cut_short_is_made_again_even_for_older_options(spark, tmp_path, monkeypatch):
    (tmp_path / "in").write_text("1\n")
    job = lambda add: Job(spark, f"{tmp_path}/out", chain(spark, f"{tmp_path}/in", add))
    job(1).table("d")
    whole = jobs.write_stage

    def cut_short(df, path, **given):
        if path.endswith("/c"):
            df.limit(0).write.mode("overwrite").parquet(path)
            raise RuntimeError("lost")
        return whole(df, path, **given)

    monkeypatch.setattr(jobs, "write_stage", cut_short)
    with pytest.raises(RuntimeError):
        job(5).table("d")
    monkeypatch.setattr(jobs, "write_stage", whole)
    again = job(1)
    assert [tuple(r) for r in again.table("d").collect()] == [(4, 1)] and again.made == ["b", "c"]


def test_order_of_stages(spark):
    none = lambda *_: None
    assert Job(spark, "x", [Stage("a", ("b", "c"), none), Stage("b", ("c",), none), Stage("c", (), none)]).order("a") == ["c", "b", "a"]
    for wrong in ([Stage("a", ("b",), none), Stage("b", ("a",), none)], [Stage("a", ("z",), none)]):
        with pytest.raises(ValueError):
            Job(spark, "x", wrong).order("a")
    with pytest.raises(ValueError):
        Job(spark, "x", [Stage("a", (), none)] * 2)


SETTINGS = """db_prefix = "x"
[detection]
min_hits = 15
min_span = 150
[repeats]
min_span = 250
[units]
min_len = 250
[peaks]
low = 80
high = 100
min_covered = 250
min_density = 0.001
deviation = 0.1
[contigs]
window = 200
[encoding]
reprs = "{reprs}"
[variants]
least_fraction = 0.04
[run]
until = "contigs"
"""


def test_from_fasta_to_contigs_and_encodings(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").filter("length(text) > 160").orderBy("item_id").limit(2).write.parquet(f"{tmp_path}/benchmark.parquet")
    genomes = V.genomes(spark, str(tmp_path)).orderBy("item_id").collect()
    reads = V.genome_reads(spark, str(tmp_path)).selectExpr("read_id", "cast(read_id as string) as name", "cast(0 as tinyint) as strand", "seq", "length")
    write_fasta(reads, f"{tmp_path}/fasta")
    (tmp_path / "reprs.tsv").write_text("repr_id\tseq\tlow\thigh\n" + "".join(f"{k}\t{g['unit']}\t{V.UNIT - 4}\t{V.UNIT + 4}\n" for k, g in enumerate(genomes)))
    (tmp_path / "o.toml").write_text(SETTINGS.format(reprs=f"{tmp_path}/reprs.tsv"))
    options, out = Options.load(tmp_path / "o.toml"), f"{tmp_path}/out"
    assert command.run(spark, options, f"{tmp_path}/fasta", out, "overlaps").made == ["reads", "alignments", "repeats", "chosen", "units", "selected", "overlaps"]
    job = command.run(spark, options, f"{tmp_path}/fasta", out)
    assert job.made == ["synced", "labels", "labelled", "edges", "paths", "contigs"]
    found = [r["seq"] for r in job.table("contigs").collect()]
    assert any(found) and all(min(align(x, g["genome"], "glocal").diff for g in genomes for x in (s, revcomp(s))) < 0.08 for s in found if s)
    (tmp_path / "o.toml").write_text(SETTINGS.format(reprs=f"{tmp_path}/reprs.tsv").replace("window = 200", "window = 100"))
    command.main([f"{tmp_path}/o.toml", f"{tmp_path}/fasta", out])
    edited = Options.load(tmp_path / "o.toml")
    assert command.run(spark, edited, f"{tmp_path}/fasta", out).made == []
    encoded = command.run(spark, edited, f"{tmp_path}/fasta", out, "variants")
    assert encoded.made == ["encodings", "variants"]
    assert encoded.table("variants").filter("type = 'complete'").count() == encoded.table("variants").filter("var_vec is not null").count() > 10
    assert {r["cover_rate"] > 0.3 for r in encoded.table("cover_rates").collect()} == {True}
