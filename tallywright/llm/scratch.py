"""Tables that cut a lineage, in the folder which all machines of the cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (local tests), a new temporary folder that is then
    kept in the session's configuration."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tallywright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tallywright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lost executors don't make it be computed anew."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    # shuffle files of the write go with it, not when the driver happens to collect its garbage
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for part in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if "/tallywright/" in part:
                path = spark._jvm.org.apache.hadoop.fs.Path(part)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``df``, after the session's limit of bytes in an Arrow batch has been lowered to ``most``: tasks that work on
    texts then hold a few batches of this size, whatever the texts' lengths are."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", conf.get(name).lower()).groups()
    if not 0 < int(number) << 10 * "bkmgtp".index(unit[:1] or "b") <= most:
        conf.set(name, f"{most}b")
    return df
