"""Store semantics on plain tables: keyed merges, cascades, hash gates, and snapshots.

A store is a folder with one Parquet table for each name in each snapshot. Writers make a new snapshot and then add a
pointer with the next number; readers take the highest, so that they see the old snapshot or the new one.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import content_hash


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where driver and executors are one
    process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (sc.master or "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorekeep-ckpt-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed: later plans begin there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a table, for long loops: a checkpoint hands on the estimated sizes of its joins,
    which multiply from step to step until planning takes minutes; a table has its true size."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key. A maximum of structs aggregates before its shuffle; a hot key costs one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(seq), *(F.col(c) for c in rest if c != seq))).alias("__best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of those of ``old`` with the same key; keys of ``new`` are unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_placeholders(real: DataFrame, placeholders: DataFrame, key: str = "id") -> DataFrame:
    """Placeholders enter only where nothing real is, whatever came first."""
    both = real.withColumn("__real", F.lit(1)).unionByName(placeholders.withColumn("__real", F.lit(0)))
    return latest(both, [key], "__real").drop("__real")


def upsert_edges(edges: DataFrame, seq: str) -> DataFrame:
    """One edge for (from, to, kind), the last; weight 0 counts as 1, empty metadata as {}."""
    out = latest(edges, ["from_node", "to_node", "kind"], seq)
    return out.withColumn("weight", F.when(F.coalesce("weight", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("weight"))).withColumn(
        "metadata", F.when(F.coalesce("metadata", F.lit("")) == "", F.lit("{}")).otherwise(F.col("metadata"))
    )


def without(rows: DataFrame, gone: DataFrame, **match: str) -> DataFrame:
    """Rows whose column (keyword) is not among the values of ``gone``'s column."""
    for column, other in match.items():
        rows = rows.join(gone.select(F.col(other).alias(column)), column, "left_anti").select(*rows.columns)
    return rows


def cascade_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are left."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_semi")
    return out.join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_semi").select(*edges.columns)


def changed(new: DataFrame, old: DataFrame, key: str, text: str, force: bool = False) -> DataFrame:
    """Rows of ``new`` whose content's hash is not the stored one (``old`` has the key and content_hash)."""
    hashed = new.withColumn("content_hash", content_hash(F.col(text)))
    if force:
        return hashed
    known = old.select(key, F.col("content_hash").alias("__old"))
    return hashed.join(known, key, "left").where(F.col("__old").isNull() | (F.col("__old") != F.col("content_hash"))).drop("__old")


def fill_summaries(chunks: DataFrame, cache: DataFrame, summarize) -> tuple[DataFrame, DataFrame]:
    """(chunks with summary, cache). Only texts that the cache lacks go to ``summarize``, each once."""
    hashed = chunks.drop("summary").withColumn("content_hash", content_hash(F.col("embedding_text")))
    missing = hashed.select("content_hash", "embedding_text").dropDuplicates(["content_hash"]).join(cache, "content_hash", "left_anti")
    made = missing.select("content_hash", summarize(F.col("embedding_text")).alias("summary"))
    full = cache.select("content_hash", "summary").unionByName(made)
    return hashed.join(full, "content_hash", "left").withColumn("summary", F.coalesce("summary", F.lit(""))).drop("content_hash"), full


class Store:
    """Named tables in snapshots under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(conf), path

    def version(self) -> int:
        """The number of the last snapshot, 0 without one."""
        fs, folder = self._path("pointers")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Path by table name, as the last pointer has it, or an earlier one."""
        version = self.version() if version is None else version
        if not version:
            return {}
        fs, path = self._path(f"pointers/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame | None:
        path = self.tables().get(name)
        return self.spark.read.parquet(path) if path else None

    def write(self, **frames: DataFrame | None) -> None:
        """All frames become current at once; other tables stay, and one given as None goes. Each write adds a pointer with
        the next number, complete before it has its name; none is deleted, so that readers always find one. Of two
        writers that began at the same snapshot the later one fails."""
        before = self.version()
        tables = self.tables(before)
        snapshot = uuid.uuid4().hex
        for name, df in frames.items():
            if df is None:
                tables.pop(name, None)
                continue
            df.write.parquet(f"{self.root}/{snapshot}/{name}")
            tables[name] = f"{self.root}/{snapshot}/{name}"
        fs, made = self._path(f"{snapshot}.json")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        _, pointer = self._path(f"pointers/{before + 1:012d}.json")
        fs.mkdirs(pointer.getParent())
        if self.version() != before or not fs.rename(made, pointer):
            fs.delete(made, False)
            raise RuntimeError("another writer has made a snapshot meanwhile")

    def clear_vectors(self) -> None:
        """Drop chunks, their vectors and word index, and the model's record; documents and code files stay, without
        content hashes, so that the next index makes their chunks anew."""
        docs = self.read("documents")
        gone = {name: None for name in ("chunks", "postings", "lengths", "meta", "parsed_docs") if name in self.tables()}
        keep = {} if docs is None else {"documents": docs.withColumn("content_hash", F.lit(""))}
        self.write(**gone, **keep)
