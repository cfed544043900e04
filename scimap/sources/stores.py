"""Intermediate results that iterative operators cut their lineage with, and folders for files that are read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Names the folder of this driver's run.
RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share; where none is set and all runs on this machine (as
    in tests) a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scimap-")
        sc.setCheckpointDir(folder)
    return folder


def input_bytes(df: DataFrame) -> int | None:
    """The bytes of the files that df reads, as the optimizer knows them; None if it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 60 else None


def spread(df: DataFrame, *keys: str, a_task: int = 4 << 20) -> DataFrame:
    """df dealt by keys to a task for each a_task bytes of the files that it reads, where these are more than shuffle
    partitions: what a task then sorts or hashes by the keys does not grow with the input."""
    size = input_bytes(df)
    n = -(-(size or 0) // a_task)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder.

    Its size is that of its files. DataFrame.checkpoint() would keep the optimizer's estimate instead, in which each join
    multiplies the sizes of its sides: in rounds of joins these numbers double their digits from round to round.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes what checkpointed() has kept of tables that nothing reads any more, as in rounds that are over."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses: in the folder of this run."""
    return f"{shared_dir(spark)}/scimap-{RUN}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all that this run has kept in the shared folder. Results that read it must have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scimap-{RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
