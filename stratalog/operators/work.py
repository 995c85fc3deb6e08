"""The shared work folder: tables that jobs write and read again, and ranks and running sums over whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the session names none, a temporary folder on a single machine (``local`` masters); a cluster must name one
    that all executors see.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stratalog-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; with ``keep`` it outlives ``scratch``.

    This cuts the lineage, so that a lost executor costs the reading of a file, and it fixes the values of
    everything that a second evaluation could give otherwise (row numbers, range bounds). A join with a written table
    has a shuffle of its own on both sides: as long as nothing above depends on its partitioning, adaptive execution
    splits the rows of a hot key over several tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    made = _made.get()
    if made is not None and not keep:
        made.append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more; twice does no harm."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Forget at the end all tables that operators wrote within; write results that are to stay before that.

        with scratch():
            near_dup.near_duplicate_classes(docs).write.parquet(path)
    """
    token = _made.set([])
    try:
        yield
    finally:
        tables = _made.get() or []
        _made.reset(token)
        forget(*tables)


def running(df: DataFrame, keys: Sequence[Column | str], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` in the order of ``keys``, with ``rank`` (from 0) and ``c_before`` (the sum of c over all rows before) for c in ``sums``.

    One range shuffle, which deals out a key of many rows by the keys after it. Its result is written, as range bounds
    are drawn anew whenever a plan runs. Ranks and sums are those within a partition plus those of the partitions
    before it: a table with a row per partition. ``df`` should be cheap to read twice, as bounds come from a sample of it.
    """
    place = F.monotonically_increasing_id()
    laid = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", place), "sorted")
    laid = laid.withColumn("part", F.shiftright("place", 33)).withColumn("within", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = laid.groupBy("part").agg(F.count("*").alias("rows"), *[F.sum(c).alias(f"{c} here") for c in sums])
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    per = per.select("part", offset("rows").alias("rank from"), *[offset(f"{c} here").alias(f"{c} from") for c in sums])
    inside = Window.partitionBy("part").orderBy("within").rowsBetween(Window.unboundedPreceding, -1)
    made = [(F.col("rank from") + F.col("within")).alias("rank")]
    made += [(F.col(f"{c} from") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums]
    return laid.join(F.broadcast(per), "part").select(*df.columns, *made)
