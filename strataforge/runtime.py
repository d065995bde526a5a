"""Session-level helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def cores(spark: SparkSession) -> int:
    """Task slots of the session (its default parallelism)."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Give a Python-heavy stage enough tasks.

    A scan of many splits is left alone, so no shuffle is paid at scale; only an input
    of fewer splits than ``cores`` is dealt out round robin.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= 2 * cores(spark):
        return df
    return df.repartition(per_core * cores(spark))


def set_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: ``spark.checkpoint.dir`` of the session, a local one only where unset on a local master."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if not folder and not context.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} has to name a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="strataforge-ckpt-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the written copy survives the loss of executors.

    The planner's estimate of a join is the product of its sides, and a checkpoint carries estimates on. In a loop they grow to numbers of
    millions of digits, which take the driver longer than the jobs. So the copy is read without them; what is small is found at run time.
    """
    set_checkpoint_dir(df.sparkSession)
    held = df.checkpoint(eager=True)
    plain = df.sparkSession._jsparkSession.internalCreateDataFrame(held._jdf.queryExecution().toRdd(), held._jdf.schema(), False)
    return DataFrame(plain, df.sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
