"""Mixing sources to target shares of the total size, with a cap on how often a record is repeated.

Method: a low-discrepancy schedule. Slot i is given the point frac(i * golden ratio); the cumulative shares say whose slot it is. Slots are ranked
per source, and so are blocks of about BLOCK tokens of each source's records in shuffled order, every record once before any twice; slot r of a source
takes its block r. The mix is as long as the scarcest source allows; it ends before the first slot that has no full block.

Ranks and running totals are prefix sums over partitions, so a source with most of the records is no single task's work.
Defined cases: records without tokens, and those of no listed source, are in no mix; a listed source without records is left out and the
shares of the others are scaled up; sources compare trimmed and in lower case; a target with a null or non-positive share or cap gets nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.bpe import token_counts
from strandmill.sources.shared import materialise, width

BLOCK = 256  # tokens of a slot: small against a source, so that shares are exact to about BLOCK times the sources over the tokens of the mix
CHUNK = 65_536  # slots that are ranked together
GOLDEN = 0.6180339887498949


def running_total(df: DataFrame, group: str, order: list[str], value: str, name: str = "before") -> DataFrame:
    """df with the sum of `value` (BIGINT) over the rows before each one in its group (STRING), in the given order, which tells all rows of a group apart.
    Sorted range partitions are summed locally; their totals, at most one for each partition and one for each group, make the offsets."""
    by = [group, *order]
    ordered = df.repartitionByRange(width(df.sparkSession), *by).sortWithinPartitions(*by)
    names = [group, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, v = (b.column(b.schema.get_field_index(c)) for c in names)
            keys, v = np.array(g.to_pylist(), object), v.to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = np.cumsum(v) - v
            first = np.repeat(sums[start], np.diff(np.append(start, len(v))))
            local = sums - first
            if keys[0] == last:
                local[: start[1] if len(start) > 1 else len(v)] += total
            total, last = int(local[-1] + v[-1]), keys[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local), pa.array(np.full(len(v), part, np.int32))], names=[*b.schema.names, "__local", "__part"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in ordered.dtypes)
    runs = materialise(ordered.mapInArrow(run, f"{kinds}, __local bigint, __part int"), "totals")
    sums = runs.groupBy("__part", group).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", group, F.coalesce(F.sum("v").over(w), F.lit(0)).alias("__offset"))
    return runs.join(F.broadcast(offsets), ["__part", group]).withColumn(name, F.col("__offset") + F.col("__local")).drop("__part", "__local", "__offset")


@dataclass(frozen=True)
class Plan:
    """One entry per source: name, share of the mix, target as given, most repeats, tokens there are."""

    sources: list[tuple[str, float, float, int, int]]
    slots: int
    block: int


def normal(source: Column) -> Column:
    return F.lower(F.btrim(source, F.lit(" \t\r\n")))


def plan(sizes: DataFrame, targets: DataFrame, block: int) -> Plan:
    """targets: rows (source, target_share, max_repeats), a handful; sizes: rows (id, source, tokens)."""
    have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row per listed source
    found = [(r.source, r.target_share, r.max_repeats, have.get(r.source, 0)) for r in targets.collect()]
    usable = [x for x in found if (x[1] or 0) > 0 and (x[2] or 0) > 0 and x[3] > 0]
    total = sum(x[1] for x in usable)
    length = min((n * repeats * total / share for _, share, repeats, n in usable), default=0)
    return Plan([(s, share / total, share, repeats, n) for s, share, repeats, n in sorted(usable)], int(length // block), block)


def schedule(sizes: DataFrame, p: Plan) -> DataFrame:
    """(slot, source, rank): whose slot each is, and which of that source's it is, from 0."""
    spark = sizes.sparkSession
    point = F.pmod((F.col("slot") + 0.5) * GOLDEN, F.lit(1.0))
    whose, upto = F.lit(p.sources[-1][0]) if p.sources else F.lit(None).cast("string"), 1.0
    for name, share, *_ in reversed(p.sources):
        whose = F.when(point < upto, name).otherwise(whose)
        upto -= share
    slots = spark.range(p.slots).select(F.col("id").alias("slot"), F.expr(f"id div {CHUNK}").alias("chunk")).withColumn("source", whose)
    inside = slots.withColumn("n", F.row_number().over(Window.partitionBy("chunk", "source").orderBy("slot")))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = slots.groupBy("chunk", "source").agg(F.count(F.lit(1)).alias("c")).select("chunk", "source", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    return inside.join(chunks, ["chunk", "source"]).select("slot", "source", (F.col("offset") + F.col("n") - 1).alias("rank"))


def mix(docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, tokenizer: str | None = None, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, Plan]:
    """The rows (slot, source, key, copy, tokens) of the mix, and its plan. targets: (source, target_share, max_repeats); key tells the rows of docs apart.
    block: tokens of a slot, whatever the size of the mix; a mix of fewer tokens than that is empty."""
    if block < 1:
        raise ValueError("a block must hold at least one token")
    wanted = materialise(targets.select(normal(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"]), "targets")
    listed = [r.source for r in wanted.select("source").collect()]
    rows = docs.select(F.struct(F.col(key).alias("key"), normal(F.col(source)).alias("source")).alias("k"), F.col(text).alias("t")).where(F.col("k.source").isin(listed))
    sizes = materialise(token_counts(rows, "k", "t", tokenizer).where("tokens > 0").select("k.key", "k.source", "tokens"), "sizes")
    p = plan(sizes, wanted, block)
    # As many copies as the source's share of the mix can need.
    copies = F.lit(0)
    for name, share, _, repeats, n in p.sources:
        copies = F.when(F.col("source") == name, min(repeats, int(p.slots * p.block * share / n) + 1)).otherwise(copies)
    deal = sizes.select("key", "source", "tokens", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))).alias("copy"))
    deal = deal.withColumn("shuffled", F.xxhash64(F.lit(seed), "copy", "key"))
    dealt = running_total(deal, "source", ["copy", "shuffled", "key"], "tokens").withColumn("rank", F.expr(f"before div {p.block}"))
    full = {r.source: r.n // p.block for r in dealt.groupBy("source").agg(F.max(F.col("before") + F.col("tokens")).alias("n")).collect()}
    slots = schedule(sizes, p)
    short = F.lit(False)
    for name, n in full.items():
        short = short | ((F.col("source") == name) & (F.col("rank") >= n))
    end = slots.where(short).agg(F.min("slot").alias("slot")).first().slot
    kept = slots.where(F.col("slot") < (p.slots if end is None else end))
    return kept.join(dealt.hint("merge"), ["source", "rank"]).select("slot", "source", F.col("key").alias(key), "copy", "tokens"), p


def shares(mixed: DataFrame, p: Plan, targets: DataFrame, key: str) -> DataFrame:
    """(source, target_share, tokens, actual_share, n_records, n_distinct, most_repeats, max_repeats) of each listed source."""
    each = mixed.groupBy("source", key).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    got = each.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("most_repeats"))
    rows = targets.select(normal(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    out = rows.join(got, "source", "left").na.fill(0, ["tokens", "n_records", "n_distinct", "most_repeats"])
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per listed source
    actual = F.when(everything > 0, F.col("tokens") / everything).otherwise(0.0)
    return out.select("source", "target_share", "tokens", actual.alias("actual_share"), "n_records", "n_distinct", "most_repeats", "max_repeats")
