"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import operator
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests, a single machine) one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandmill-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name, removed at exit."""
    if not _made:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/strandmill-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)
    _made.pop(path, None)


def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the session may be gone at exit
            pass


def small(df: DataFrame) -> bool:
    """Whether all rows of a written table, as they are in memory, are below the size up to which the session broadcasts."""
    room = [F.octet_length(f.name) + 16 if f.dataType.typeName() in ("string", "binary") else F.lit(16) for f in df.schema]
    size = df.agg(F.sum(functools.reduce(operator.add, (F.coalesce(x, F.lit(16)) for x in room)).cast("bigint")).alias("size")).first().size or 0
    return size <= _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))


def _bytes(text: str) -> int:
    found = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", text.strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]]


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
