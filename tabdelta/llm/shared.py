"""What the operators share: column names that can't clash, and tables in the shared folder.

Intermediate results that are read more than once are written as Parquet below
``spark.checkpoint.dir``, which every executor sees, so a lost executor costs a
reread and never a result. The folder is set here only when a session has none
(local runs and tests).
"""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: what the session names, else what setCheckpointDir() named. Only a local master, whose
    executors and driver are one machine, may do without; elsewhere a missing folder is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return DEFAULT_SHARED


#: Rows per batch to and from Python where the session has Spark's default: whole texts are long, and a batch of
#: them is held several times over. The final, lazy step of an operator runs under it as well, so it stays set.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Workspace:
    """Tables of one operator call; they go when the application ends, or earlier by drop()."""

    def __init__(self, spark: SparkSession, tag: str):
        if spark.conf.get(_BATCH, None) in (None, "10000"):
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: lineage ends in files that all executors share."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Let Spark free the shuffle files of finished steps, which it does when the driver collects garbage.

        Later steps start from written tables, so nothing needs those files again.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.root if name is None else f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the files are only scratch
            pass


def fresh(taken, *names: str) -> list[str]:
    """Column names that differ from those taken, letter case aside."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that the result is about to define."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a join's build side that one task holds in a hash table.
BUILD_ROWS = 500_000


def probe(stream: DataFrame, build: DataFrame, on: list[str], how: str = "inner", build_rows: int = BUILD_ROWS) -> DataFrame:
    """stream joined with a written table of small rows by hash, so that wide stream rows aren't sorted.

    A hash table can't spill, so this holds only while the counted rows of ``build`` come to at most ``build_rows``
    for each shuffle partition; beyond that Spark's own choice, a sort that spills, is left alone.
    """
    fits = build.count() <= build_rows * shuffle_partitions(stream.sparkSession)
    return stream.join(build.hint("shuffle_hash") if fits else build, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
