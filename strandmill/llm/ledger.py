"""Whether a key has been seen before, with a history too large for memory.

Method: an exact bucketed key ledger. The keys so far are on disk in runs, each of them a table bucketed by key with one sorted file for each bucket. Of each batch the
first arrival of every key (its rank within the batch is 1) is left-joined to the runs by sort-merge - they are neither shuffled nor sorted, their buckets are read as they are -
and the keys that no run has become a run of their own. A row is new if it is the first arrival of a key that the ledger doesn't have; every other row has been seen.
No answer is wrong. When there are more than RUNS runs, those behind the first are merged into one, and all of them once they have grown as large as the first.

A ledger stays where it is: `KeyLedger(spark, path)` opens one that an earlier session wrote. It has one writer at a time; what a merge has replaced is deleted
when the ledger is opened next. A crash loses the run that was being written, and none of the others.

A hot key is one row after the map-side aggregation, and rows are told apart by (key, arrival), which no key dominates.
Defined cases: rows with a null key are never seen and never kept; arrivals that tie are seen by neither of each other; a null arrival comes last.
"""

from __future__ import annotations

import atexit
import functools
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.sources.shared import file_system, new_path, width

LAST = 2**63 - 1
RUNS = 8
SCHEMA = "key string, arrival bigint"
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # a bucket of one file is read in the order it was written in


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class KeyLedger:
    """Keys (STRING) in a folder that all executors share, each with the arrival that brought it (null: known from the start)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        """Opens the ledger at path, or makes one of so many buckets; without a path it is gone at exit."""
        self.spark, self.path = spark, path or new_path(spark, "ledger")
        self.tables: dict[str, str] = {}  # run -> table
        self.admitted: list[str] = []
        fs, p = file_system(spark, self.path)
        fs.mkdirs(p)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        states = sorted(n for n in names if n.startswith("state-"))
        state = json.loads(spark.read.text(f"{self.path}/{states[-1]}", wholetext=True).first()[0]) if states else {"buckets": buckets or width(spark), "runs": []}
        self.buckets, self.runs, self.version = state["buckets"], state["runs"], int(states[-1].split("-")[1].split(".")[0]) if states else 0
        if buckets not in (None, self.buckets):
            raise ValueError(f"the ledger has {self.buckets} buckets, not {buckets}")
        for n in names:
            if (n.startswith("run-") and n not in self.runs) or n in states[:-1] or n.startswith("new-"):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
        if not states:
            self._save()
        atexit.register(self.close)

    def _save(self) -> None:
        """The list of runs, under its name only when it is whole; the newest one holds."""
        self.version += 1
        fs, draft = file_system(self.spark, f"{self.path}/new-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": self.runs}).encode()))
        out.close()
        fs.rename(draft, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state-{self.version:08d}.json"))

    def _table(self, run: str) -> DataFrame:
        if run not in self.tables:
            name = f"strandmill_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (key STRING, arrival BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def keys(self) -> DataFrame:
        """(key, arrival) of all keys."""
        return functools.reduce(DataFrame.unionByName, map(self._table, self.runs), self.spark.createDataFrame([], SCHEMA))

    def _write(self, rows: DataFrame) -> str:
        """A run of rows that are partitioned as the buckets are: each task writes one file."""
        run, name = f"run-{uuid.uuid4().hex}", f"strandmill_{uuid.uuid4().hex}"
        laid = rows.select("key", "arrival").sortWithinPartitions("key").write.format("parquet").option("path", f"{self.path}/{run}").option("compression", "zstd")
        laid.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.tables[run] = name
        return run

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """Of rows (key, arrival), one for each key, those whose key no run has, partitioned as the buckets are."""
        out = firsts.repartition(self.buckets, "key")
        for run in self.runs:
            out = out.join(self._table(run).select("key").hint("merge"), "key", "left_anti")
        return out

    def _add(self, rows: DataFrame, arrival: Column) -> str:
        firsts = rows.where("key is not null").groupBy("key").agg(F.min(arrival).alias("arrival"))
        with ordered_scans(self.spark):
            run = self._write(self.unseen(firsts))
        self.runs = [*self.runs, run]
        self._save()
        if len(self.runs) > RUNS:
            self.merge()
        return run

    def remember(self, keys: DataFrame) -> None:
        """Add the keys (column `key`) of a history."""
        self._add(keys.select("key"), F.lit(None).cast("bigint"))

    def admit(self, batch: DataFrame) -> None:
        """Judge a batch (key, arrival BIGINT), whose arrivals are later than those of all batches before, and add its new keys."""
        self.admitted.append(self._add(batch.select("key", "arrival"), F.coalesce("arrival", F.lit(LAST))))

    def size(self, run: str) -> int:
        fs, p = file_system(self.spark, f"{self.path}/{run}")
        return fs.getContentSummary(p).getLength()

    def merge(self) -> None:
        """Fewer runs, with the same keys."""
        later = self.runs[1:]
        merged = later if sum(map(self.size, later)) < self.size(self.runs[0]) else self.runs
        # Read as plain files: of a union of bucketed tables the planner may take the partitioning for granted and yet not keep it.
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{run}" for run in merged))
        run = self._write(rows.repartition(self.buckets, "key"))
        self.runs = [*(r for r in self.runs if r not in merged), run]
        self._save()

    def seen(self, rows: DataFrame) -> DataFrame:
        """Of rows (key, arrival, ...) that were admitted since the ledger was opened those whose key had been seen."""
        paths = [f"{self.path}/{run}" for run in self.admitted]
        new = (self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)).withColumnsRenamed({"key": "new_key", "arrival": "new_arrival"})
        same = (F.col("key") == F.col("new_key")) & (F.coalesce("arrival", F.lit(LAST)) == F.col("new_arrival"))
        return rows.where("key is not null").join(new, same, "left_anti")

    def close(self) -> None:
        """Forget the tables; the ledger's files stay."""
        try:
            for name in self.tables.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.tables = {}
        except Exception:  # the session may be gone at exit
            pass


def by_step(rows: DataFrame, steps: int) -> tuple[DataFrame, list[int]]:
    """rows (key, arrival), written once in a folder for each of about `steps` ranges of arrivals, and the numbers of these in order."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "feed")
    share = [i / steps for i in range(1, steps)]
    cuts = sorted(set(rows.agg(F.percentile_approx("arrival", share).alias("cuts")).first().cuts or [])) if share else []  # steps - 1 numbers
    step = F.lit(0)
    for cut in cuts:
        step = step + F.coalesce((F.col("arrival") > cut).cast("int"), F.lit(1))
    rows.withColumn("step", step).write.partitionBy("step").option("compression", "zstd").parquet(path)
    return spark.read.schema(f"{SCHEMA}, step int").parquet(path), list(range(len(cuts) + 1))


def seen_before(history: DataFrame, key: Column, feed: DataFrame, feed_key: Column, arrival: str, steps: int = 4, ledger: KeyLedger | None = None) -> DataFrame:
    """Rows (key, arrival) of feed whose key is in history, in the given ledger or in a row of feed that arrived earlier.
    The feed is judged in `steps` batches of consecutive arrivals. The ledger keeps the keys of both."""
    ledger = ledger or KeyLedger(feed.sparkSession)
    ledger.remember(history.select(key.alias("key")))
    rows, batches = by_step(feed.select(feed_key.alias("key"), F.col(arrival).cast("bigint").alias("arrival")), steps)
    for i in batches:
        ledger.admit(rows.where(F.col("step") == i))
    return ledger.seen(rows.select("key", "arrival"))
