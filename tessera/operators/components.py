"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges up to which the centres of stars are broadcast to their edges.
BROADCAST_EDGES = 250_000
#: Edges of a centre from which it is joined apart from the others.
HOT_CENTRE = 100_000

#: Seconds after which a checkpoint has the driver's garbage collected once more.
RELEASE_S = 3.0
_released = [0.0]


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without one gets a folder of its own, once; a cluster must name one that all its machines see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder, so that a lost executor costs no more than this step's reading. What only led to earlier ones is released."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    out = df.checkpoint()
    del df
    release(spark)
    return out


def release(spark: SparkSession, now: bool = False) -> None:
    """Lets Spark delete the shuffles (and, if its cleaner is set to, checkpoints) that nothing refers to: it does so only as the driver's garbage is collected. Short steps one after another share a collection, unless it is to be now.

    Spark's listeners hold the last query that ended, with its plan and shuffles:
    so empty ones, which take no job, end between collections.
    """
    if not now and time.monotonic() - _released[0] < RELEASE_S:
        return
    jvm = spark.sparkContext._jvm
    gc.collect()
    jvm.System.gc()
    for _ in range(3):  # one is often too early for the last shuffle
        time.sleep(0.2)
        spark._jsparkSession.sql("SELECT 1").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        jvm.System.gc()
    _released[0] = time.monotonic()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _with_least(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """rows (u, v) with the `m` of their u. least: (u, m, n), n being the edges of u; few: whether it may be broadcast.

    Beyond that, centres of many edges (at most one for each HOT_CENTRE edges)
    are broadcast and only the others are dealt by u, so no task gets all the
    edges of a large star.
    """
    if few:
        return rows.join(F.broadcast(least.select("u", "m")), "u")
    hot = least.filter(F.col("n") >= HOT_CENTRE).select("u", "m")
    marked = rows.join(F.broadcast(hot), "u", "left")
    cold = marked.filter("m is null").drop("m").join(least.filter(F.col("n") < HOT_CENTRE).select("u", "m"), "u")
    return marked.filter("m is not null").select("u", "v", "m").unionAll(cold.select("u", "v", "m"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex with an edge to another; component is the least vertex reachable.

    Each round hangs a vertex's larger neighbours on its least one (large
    star), then its smaller neighbours and itself (small star), until every
    component is one star; that takes about log^2 of the vertices at most.
    Self loops and nulls are dropped. The lineage is cut every round.
    """
    a, b = F.col(u), F.col(v)
    e = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = checkpointed(e)
    state = _state(e)
    for _ in range(max_rounds):
        few = state[0] <= BROADCAST_EDGES
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.filter("v > u"), least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, few).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
