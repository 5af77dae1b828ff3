"""Written tables below the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine (tests), a temporary one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="folio-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: what follows doesn't depend on how it was made."""
    spark = df.sparkSession
    path = f"{shared(spark)}/folio-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_gone, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for files of this session, gone when the session's Python ends."""
    path = f"{shared(spark)}/{name}"
    atexit.register(_gone, spark, path)
    return path


#: Rows of narrow columns that one task sorts or sums; a table of more is dealt to more tasks.
ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its number of ``rows`` asks for, so that a task's memory doesn't grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_A_TASK)), *keys)


_KEPT: dict[tuple, str] = {}


def kept_table(spark: SparkSession, name: str, write, *sources: str) -> str:
    """The folder of a table that ``write(path)`` makes once a session, under ``name``; later calls find it.

    It is made anew when the files of ``sources`` are others than they were: by name, size or time.
    """
    key = (spark.sparkContext.applicationId, name, *(file for source in sources for file in _files(spark, source)))
    if key not in _KEPT:
        path = f"{shared(spark)}/folio-kept-{uuid.uuid4().hex}"
        write(path)
        atexit.register(_gone, spark, path)
        _KEPT[key] = path
    return _KEPT[key]


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, True), []
    while found.hasNext():
        at = found.next()
        out.append((at.getPath().toString(), at.getLen(), at.getModificationTime()))
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _gone(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A table after an upsert by document: rows of keys in ``new`` are all replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
