"""What several operators of this subpackage need: checkpoints, column names, table paths, batches, joins of hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = 64 << 20
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir. Without one, a folder of our own serves as long as
    driver and executors are one process; on a cluster they would not share it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master or "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorekeep-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint, which lost executors do not take along. The
    shuffle files that made it go when it is written: nothing reads them again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python in Arrow batches of about ``BATCH_BYTES`` (a longer row goes alone): Spark's
    default of 64 MB becomes several hundred as Python objects. A bound that the session sets itself stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, f"{BATCH_DEFAULT}b").rstrip("b") == str(BATCH_DEFAULT):
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys adaptive execution can split. It only splits what is shuffled for the join itself; a
    side that comes from an aggregate by these keys would be used as it lies. A second, derived key makes Spark deal out
    both sides anew."""
    derived = F.pmod(F.xxhash64(*keys), F.lit(1 << 20))
    name = fresh(left, "__dealt")
    return left.withColumn(name, derived).join(right.withColumn(name, derived), [*keys, name], how).drop(name)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have; callers' extra columns never clash with ours."""
    have = {c.lower() for c in df.columns}
    return base if base.lower() not in have else f"{base}_{uuid.uuid4().hex[:8]}"
