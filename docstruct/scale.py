"""Helpers every operator shares: durable cuts of the lineage and small-table access.

Nothing here depends on the size of the data: a cut goes to the folder the
cluster names in ``spark.checkpoint.dir`` and a configuration table is read by
the driver only after its row count was checked against a fixed bound.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows a configuration table (profiles, word lists) may have at most.
MAX_CONFIG_ROWS = 10_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the session's own, or a temporary one if it names none.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset (local
    tests) a folder of this process is created.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="docstruct-checkpoint-")
    sc.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def own_shuffles(spark: SparkSession):
    """Queries run inside drop their shuffle files when they end; for those whose frames are not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the written rows.

    Columnar and compressed, and it outlives any executor. The shuffles of the
    write are dropped when it is done, since nobody reads them again. The tables
    are removed by ``free`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/docstruct-{uuid.uuid4().hex}"
    with own_shuffles(spark):
        df.write.parquet(path)
    if not _written:
        atexit.register(free)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def free() -> None:
    """Remove the tables ``cut`` wrote; results made of them must be done with."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone already, the others still count
            continue


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many partitions as there are cores, if it has less than half as many.

    For steps that are long per row: a small table in one file would otherwise be
    one task. For readings of files and what is made of them without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """``df`` without repeated rows, on at least as many partitions as there are cores.

    The one shuffle is by ``key``, which all columns of equal rows share, and is
    not coalesced, so steps that are long per row stay on all cores.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key).distinct()


def config_rows(df: DataFrame, most: int = MAX_CONFIG_ROWS) -> list:
    """All rows of a table that does not grow; raises if it has more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a configuration table may have {most} rows at most")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
