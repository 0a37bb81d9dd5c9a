"""Per-key results where a handful of keys has most rows.

Method: exact offset chunking. Rows are brought into key order in range partitions, the rows of each partition are counted, the counts
summed up to offsets, and so all rows are numbered; equal-sized runs of numbers are the chunks. A chunk may hold many keys, or
a part of one: the work per task is the same whatever the keys. Each chunk gives a state for each key in it - rows, members and the first and
last member - and the states of a key are merged in order: a member on both sides of a border was counted twice.

A tie of (key, member) is divided as well: rows that are alike are spread over the border by their position.
Defined cases: rows with a null key are left out; null members count as rows, not as members; an empty table gives no keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.layout import number_rows

CHUNK_ROWS = 100_000


@dataclass(frozen=True)
class KeyChunks:
    rows: DataFrame  # key, member, row_no: written, in key order
    chunk_rows: int

    def total(self) -> int:
        """Rows with a key; read from the written files' metadata."""
        return self.rows.count()

    def states(self) -> DataFrame:
        """(key, chunk, n, members, first, last): one row per chunk and key."""
        cut = self.rows.select("key", "member", F.expr(f"row_no div {self.chunk_rows}").alias("chunk")).repartition("chunk")
        once = cut.groupBy("chunk", "key", "member").agg(F.count(F.lit(1)).alias("n"))
        return once.groupBy("chunk", "key").agg(
            F.sum("n").alias("n"), F.count("member").alias("members"), F.min("member").alias("first"), F.max("member").alias("last")
        )

    def merged(self) -> DataFrame:
        """(key, n, members) of every key. A key has as many states as chunks, so its rows never meet in one task."""
        before = F.lag("last").over(Window.partitionBy("key").orderBy("chunk"))
        both = F.coalesce((before == F.col("first")).cast("bigint"), F.lit(0))
        return self.states().withColumn("both", both).groupBy("key").agg(F.sum("n").alias("n"), (F.sum("members") - F.sum("both")).alias("members"))


def chunk_by_key(df: DataFrame, key: Column, member: Column, chunk_rows: int = CHUNK_ROWS) -> KeyChunks:
    if chunk_rows < 1:
        raise ValueError("a chunk must hold at least one row")
    rows = df.select(key.alias("key"), member.alias("member"), F.monotonically_increasing_id().alias("__row")).where("key is not null")
    return KeyChunks(number_rows(rows, ["key", "member"], "row_no", spread=F.col("__row")).select("key", "member", "row_no"), chunk_rows)
