"""The most frequent values of a column with too many distinct values to be kept.

Method: three-phase threshold top-k. The nodes are the partitions of the input, or these merged without a shuffle into a given number; each sorts its rows (spilling
to disk) and writes its local counts and its own leaders. 1: the leaders' summed counts give a lower bound for the k-th count. 2: a value that reaches it
has at least a node's share of it somewhere, so only local counts of at least the share are fetched; their sums raise the bound and drop what
can't reach it even with less than the share on every other node. 3: the counts of the rest are fetched from all nodes and summed. The result is exact.

Defined cases: null values don't count; ties at the k-th place go to the smaller value; with fewer than k values all come out;
bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.runs import changed
from strandmill.sources.shared import materialise

SCHEMA = "value string, n bigint, node int, leader boolean"


def _local(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        best: list[tuple[int, str]] = []

        def out(values: pa.Array, n: np.ndarray, leader: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([values, pa.array(n.astype(np.int64)), pa.array(np.full(len(n), node, np.int32)), pa.array(np.full(len(n), leader))], names=["value", "n", "node", "leader"])

        def counted(values: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            nonlocal best
            top = np.argpartition(-n, k - 1)[:k] if len(n) > k else np.arange(len(n))
            best = sorted([*best, *((int(n[i]), values[int(i)].as_py()) for i in top)], reverse=True)[:k]
            return out(values, n, False)

        before, open_n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column(0)
            at = np.flatnonzero(changed([c], before))
            head = int(at[0]) if len(at) else b.num_rows
            open_n += head
            if len(at):
                if before is not None:
                    yield counted(pa.array(before), np.array([open_n]))
                n = np.diff(np.append(at, b.num_rows))
                if len(at) > 1:
                    yield counted(c.take(pa.array(at[:-1])), n[:-1])
                open_n = int(n[-1])
            before = (c[b.num_rows - 1].as_py(),)
        if before is not None:
            yield counted(pa.array(before), np.array([open_n]))
        if best:
            yield out(pa.array([v for _, v in best]), np.array([n for n, _ in best]), True)

    return run


def top_k(df: DataFrame, value: Column, k: int, nodes: int | None = None) -> DataFrame:
    """(value, n): the k most frequent values. nodes: how many parts hold local counts at most, by default as many as the input has partitions; it also bounds the tasks that scan the input."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = df.select(F.make_valid_utf8(value).alias("value")).where("value is not null")
    rows = (rows.coalesce(nodes) if nodes else rows).sortWithinPartitions("value")
    counts = materialise(rows.mapInArrow(_local(k), SCHEMA), "local-counts")
    local = counts.where("not leader").select("value", "n")

    def kth(sums: DataFrame) -> int:
        found = sums.orderBy(F.desc("n")).limit(k).collect()  # k numbers
        return found[-1].n if len(found) == k else 0

    leaders = counts.where("leader")
    bound = kth(leaders.groupBy("value").agg(F.sum("n").alias("n")).select("n"))
    held = max(1, leaders.select("node").distinct().count())  # those that hold anything
    share = -(-bound // held)
    partial = materialise(local.where(F.col("n") >= share).groupBy("value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("at")), "partial-counts")
    bound = max(bound, kth(partial.select("n")))
    likely = partial.where(F.col("n") + (held - F.col("at")) * max(share - 1, 0) >= bound).select("value")
    # Written, so that the planner knows its size: broadcast below the session's threshold, else a merge join.
    exact = local.join(materialise(likely, "candidates"), "value", "left_semi").groupBy("value").agg(F.sum("n").alias("n"))
    return exact.orderBy(F.desc("n"), "value").limit(k)
