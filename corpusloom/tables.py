"""Written tables in the folder that all executors share, their removal, and tables in ranges."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a new local one, for a local master only (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        base = "file://" + place
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}/{name}"


_TABLES: dict[int, str] = {}  # folders of written tables that haven't been discarded, by the order of writing


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read from there: a later loss of executors costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    _TABLES[max(_TABLES, default=0) + 1] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` has written, once nothing reads them any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    for k in [k for k, p in _TABLES.items() if p == path]:
        del _TABLES[k]


@contextmanager
def scratch(spark: SparkSession, *keep: str):
    """Tables that ``saved`` writes inside go at the end, but for those with the names ``keep``: for jobs whose result is written, not lazy."""
    before = max(_TABLES, default=0)
    try:
        yield
    finally:
        for path in [p for k, p in _TABLES.items() if k > before and p.rsplit("/", 1)[1] not in keep]:
            _delete(spark, path)


def ranged(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """A written table of ``rows`` in ranges of keys and order: adds ``_range``, ascending over the whole, and ``_at``, ascending within a range.

    Ranges are of about equal size, whatever the keys: Spark draws their borders from a sample.
    """
    spark = rows.sparkSession
    by = [*keys, *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return saved(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
