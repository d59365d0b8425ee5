"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are written for.  Size-dependent settings
# (shuffle partitions, memory) stay with whoever owns the cluster.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Intermediate tables of this driver that are still there.
_WRITTEN: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver gets a temporary
    folder without that setting: anywhere else a machine-local folder would be out
    of reach for others and lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession, keep: Sequence[str] = ()) -> None:
    """Delete the intermediate tables written so far, once no result still reads them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in [p for p in _WRITTEN if p not in keep]:
        folder = hadoop.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _WRITTEN.remove(path)


# Stored bytes up to which a table is dealt out anew to use every core.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Use every core on a small table that is stored in fewer pieces than there are.

    A table of more than ``SPREAD_BYTES``, or in as many pieces as cores, is left as
    it is: shuffling it would cost more than idle cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or stored_bytes(df) > SPREAD_BYTES:
        return df
    return df.repartition(cores, *key)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files a scan reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a later step must see exactly the rows and partition numbers of
    an earlier one, even when executors are lost in between.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
