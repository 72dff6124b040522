"""From a settings file and FASTA to selected reads, contigs or encodings.

    python -m tandemlake settings.toml reads.fasta out [--until contigs]

Each stage writes a Parquet table out/<stage>: reads, alignments, repeats, units, selected; overlaps, synced, labels,
labelled, edges, paths, contigs; encodings, cover_rates, variants. A table is made again only if the stage's options,
its input or what it needs has changed (see jobs). `--until` names the last stage, else [run] until does, else it is selected.

Sections of the settings hold options of: [detection] detect.detect, [repeats] detect.repeats_of, [units]
detect.chosen_alignments, [cutting] detect.cut_units, [peaks] peaks.filter_reads, [overlaps]
overlap_search.overlaps_of_reads, [synchronization] clustering.synchronized, [clustering] clustering.clustered, [labelled]
labels.labelled_overlaps, [graph] graph.transitive_reduction, [contigs] contigs.consensus_contigs, [encoding]
encode.encode_reads and [variants] encode.variant_vectors. Two are about the run: [run] second_pass = false makes the graph
from the first overlaps, and [encoding] reprs is a tab-separated file of representatives: repr_id, seq, low, high.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tandemlake.jobs import Job, Stage
from tandemlake.operators import clustering, contigs, detect, encode, graph, labels, overlap_search, overlaps, peaks
from tandemlake.sources import Options, read_fasta, read_table

REPRS = "repr_id int, seq string, low int, high int"


def stages(spark: SparkSession, options: Options, fasta: str) -> list[Stage]:
    of = options.other.get
    encoding = dict(of("encoding", {}))
    reprs = encoding.pop("reprs", None)

    def synced(near: DataFrame, cut: DataFrame, reads: DataFrame, **given: float) -> DataFrame:
        return clustering.synchronized(near, cut, reads, **given)

    def labelled(named: DataFrame, near: DataFrame, reads: DataFrame, **given: float) -> DataFrame:
        return labels.labelled_overlaps(named, clustering.involved(near, reads), clustering.repr_units(named), **given)

    found = "labelled" if of("run", {}).get("second_pass", True) else "overlaps"
    out = [
        Stage("reads", (), lambda: read_fasta(spark, fasta), files=(fasta,)),
        Stage("alignments", ("reads",), detect.detect, of("detection", {})),
        Stage("repeats", ("alignments",), detect.repeats_of, of("repeats", {})),
        Stage("chosen", ("repeats", "alignments"), detect.chosen_alignments, of("units", {})),
        Stage("units", ("chosen",), detect.cut_units, of("cutting", {})),
        Stage("selected", ("reads", "units"), peaks.filter_reads, options.peaks),
        Stage("overlaps", ("units", "selected"), lambda cut, reads, **given: overlap_search.overlaps_of_reads(cut.join(reads.select("read_id"), "read_id", "left_semi"), reads, **given), options.overlaps),
        Stage("synced", ("overlaps", "units", "selected"), synced, of("synchronization", {})),
        Stage("labels", ("synced", "overlaps", "selected"), lambda rows, near, reads, **given: clustering.clustered(rows, clustering.involved(near, reads), **given), options.clustering),
        Stage("labelled", ("labels", "overlaps", "selected"), labelled, of("labelled", {})),
        Stage("edges", (found,), lambda near, **given: graph.transitive_reduction(graph.string_graph(overlaps.best_per_pair(near)), **given), of("graph", {})),
        Stage("paths", ("edges",), graph.simple_paths),
        Stage("contigs", ("paths", found, "selected"), contigs.consensus_contigs, of("contigs", {})),
    ]
    if reprs:
        given = lambda: read_table(spark, reprs, REPRS)
        out += [
            Stage("encodings", ("selected",), lambda reads, **o: encode.encode_reads(reads, [tuple(r) for r in given().collect()], **o), encoding, (reprs,)),
            Stage("cover_rates", ("encodings", "selected"), encode.cover_rates),
            Stage("variants", ("encodings", "selected"), lambda rows, reads, **o: encode.variant_vectors(rows, reads, given().select("repr_id", "seq"), **o), of("variants", {}), (reprs,)),
        ]
    return out


def run(spark: SparkSession, options: Options, fasta: str, out: str, until: str | None = None) -> Job:
    """The job, with all tables up to the last stage in place."""
    job = Job(spark, out, stages(spark, options, fasta))
    job.table(until or options.other.get("run", {}).get("until", "selected"))
    return job


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tandemlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("settings", "fasta", "out"):
        parser.add_argument(name)
    parser.add_argument("--until", help="the last stage")
    given = parser.parse_args(argv)
    run(SparkSession.builder.getOrCreate(), Options.load(given.settings), given.fasta, given.out, given.until)


if __name__ == "__main__":
    main()
