"""Session defaults and lineage cutting shared by the iterative operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
# Test-size inputs are few bytes with much arithmetic: keep them spread over the local cores.
LOCAL = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32KB",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "concourse") -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session in."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**DEFAULTS, **LOCAL}.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def partitions(df: DataFrame) -> int:
    """How many slices a hot group is dealt into: as many as the session's shuffles have."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temp one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="concourse-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage, so that a lost executor costs no replay."""
    ensure_checkpoint_dir(df.sparkSession)
    made = df.checkpoint(eager=True)
    if whole_groups(df):
        # Shuffle files and checkpoints that nothing can read any more go when the driver collects their owners.
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return made


#: Set in the sessions of ``grouped``.
WHOLE = "spark.concourse.wholeGroups"
#: Rows of a slice of whole groups, fewest and most, and the most rows of a group that one task shall meet.
SMALL_SLICE, SLICE_ROWS = 4_096, 65_536


def grouped(spark: SparkSession, rows: int) -> SparkSession:
    """A session of its own for tables of many small groups that are dealt by group, ``rows`` in the largest of them.

    Once rows are dealt by their group, a join, a scan or an aggregate by the group and more columns needs no shuffle.  Spark
    knows that of a checkpoint only if its plan was not adaptive, and uses it in joins only if not all their columns have
    to be dealt by.  Hash tables of a slice fit, so joins need no sort.  Results go back by ``delivered``.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    slices = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SMALL_SLICE)), -(-rows // SLICE_ROWS), 1)
    own.conf.set("spark.sql.shuffle.partitions", str(slices))
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set(WHOLE, "true")
    return own


def whole_groups(df: DataFrame) -> bool:
    """Groups of ``df`` are small and lie in one slice each."""
    return df.sparkSession.conf.get(WHOLE, "false") == "true"


def held(df: DataFrame) -> DataFrame:
    """The side of a join by group that is looked up: as a hash table of its slice where groups lie whole."""
    return df.hint("shuffle_hash") if whole_groups(df) else df


def delivered(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` of a session of its own, written to the shared folder and read by ``spark``."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/result-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a materialised table goes to every executor whole.
FEW_ROWS = 20_000


def sized(df: DataFrame) -> DataFrame:
    """``cut`` with a join hint by the rows that are there.

    Spark judges a checkpoint by the files its plan once read: rows exploded from a few compressed bytes pass for small and
    would be broadcast, whole, through the driver.
    """
    made = cut(df)
    return F.broadcast(made) if made.limit(FEW_ROWS + 1).count() <= FEW_ROWS else made.hint("merge")
