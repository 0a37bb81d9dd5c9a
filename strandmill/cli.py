"""python -m strandmill batch|count|uniq INPUT OUTPUT K"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from strandmill.engine import KmerEngine, Kmers
from strandmill.sources import store
from strandmill.sources.fasta import concatenate, exists
from strandmill.sources.shared import drop, file_system, new_path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandmill", description="k-mers of FASTA files, on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("batch", "write the k-mers as sorted batches"), ("count", "count k-mers, or make abundance vectors"), ("uniq", "find the k-mers that occur once")):
        p = commands.add_parser(name, help=text)
        p.add_argument("input", help="on any file system that Hadoop knows")
        p.add_argument("output", help="a folder for batch, a file for counts and single k-mers; vectors go to the folder of that name without its extension")
        p.add_argument("k", type=int)
        p.add_argument("-r", "--reverse", action="store_true", help="also take reverse complements")
        p.add_argument("-s", "--scan-mode", choices=["KMERS", "RECORDS"], default="KMERS")
        p.add_argument("-b", "--batch-size", type=int, default=1_000_000, help="records of a batch, at most")
        p.add_argument("-n", "--natype", choices=["DNA", "RNA"], default="DNA")
        p.add_argument("-t", "--threads", type=int, default=0, help="cores of a local run; 0: as the cluster has it")
        p.add_argument("-T", "--tmp", help="folder for spilled data of a local run")
        p.add_argument("-m", "--batch-mode", choices=["REPLACE", "FLOW", "APPEND"], default="APPEND", help="with -B and an INPUT: how both are combined; REPLACE takes the folder alone")
        p.add_argument("-R", "--re-sort", action="store_true", help="no effect: nothing depends on the order of earlier batches")
        if name == "batch":
            p.add_argument("-C", "--compress", action="store_true")
            p.add_argument("--format", choices=["fasta", "store"], default="fasta")
        else:
            p.add_argument("-B", "--previous-batches", help="a folder that `batch` wrote, instead of reading INPUT")
        if name == "count":
            p.add_argument("-c", "--count-mode", choices=["SEQ_COUNT", "VEC_COUNT", "VEC_COUNT_MASKED"], default="SEQ_COUNT")
            p.add_argument("-M", "--memory-mode", choices=["NORMAL", "LOCAL"], help="no effect: what doesn't fit in memory is spilled")
    return top


def load(engine: KmerEngine, a: argparse.Namespace) -> Kmers:
    fresh = lambda: engine.from_fasta(a.input).kmers(a.k, a.reverse, a.natype, a.scan_mode.lower(), max(a.batch_size, a.k))
    old = getattr(a, "previous_batches", None)
    if not old:
        return fresh()
    if not store.exists(engine.spark, old):
        raise SystemExit(f"no previous batches in {old}")
    if store.exists(engine.spark, f"{old}/about"):
        kept = engine.from_store(old, a.k, a.natype, a.reverse)
    else:
        kept = Kmers(store.read_batches(engine.spark, old, a.k), a.k, a.natype, a.reverse)
    return kept if a.batch_mode == "REPLACE" or a.input == "-" else kept.feed(fresh(), a.batch_mode.lower())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.k < 2:
        raise SystemExit("k must be at least 2")
    if a.batch_size < 1:
        raise SystemExit("a batch must hold at least one record")
    for flag in ("re_sort", "memory_mode"):
        if getattr(a, flag, None):
            print(f"--{flag.replace('_', '-')} has no effect here", file=sys.stderr)
    if spark is None:
        b = SparkSession.builder.appName("strandmill")
        if a.threads:
            b = b.master(f"local[{max(1, min(a.threads, os.cpu_count() or 1))}]")
        spark = b.config(map={"spark.local.dir": a.tmp} if a.tmp else {}).getOrCreate()
    if a.input != "-" and not exists(spark, a.input):
        raise SystemExit(f"no such file: {a.input}")
    kmers = load(KmerEngine(spark), a)
    vectors = a.command == "count" and a.count_mode != "SEQ_COUNT"
    output = os.path.splitext(a.output)[0] if vectors else a.output
    fs, p = file_system(spark, output)
    if (a.command == "batch" or vectors) and fs.exists(p) and len(fs.listStatus(p)):
        raise SystemExit(f"not empty: {output}")
    if a.command == "batch":
        if a.format == "store":
            kmers.save(output, a.batch_size)
        else:
            kmers.write_batches(output, "gzip" if a.compress else "none", batch_size=a.batch_size)
    elif vectors:
        kmers.write_vectors(output, masked=a.count_mode == "VEC_COUNT_MASKED")
    else:
        parts = new_path(spark, "parts")
        (kmers.write_unique if a.command == "uniq" else kmers.write_counts)(parts)
        concatenate(spark, parts, output)
        drop(spark, parts)
    return 0
