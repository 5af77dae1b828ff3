"""Streams of events: the latest per key, windows, sessions, and tables kept by batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import remove, replaced, shared


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of files (``path`` is one or a folder); ts becomes a timestamp with zone, as watermarks need one."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a single file, a plain path may not
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_per_key(events: DataFrame, keys: list[str]) -> DataFrame:
    """The newest event of each key so far; equal times go to the larger id. For update or complete mode."""
    order = F.struct("ts", "event_id")
    return events.groupBy(*keys).agg(F.max(order).alias("last"), F.max_by("value", order).alias("value")).select(*keys, "last.ts", "last.event_id", "value")


def windowed(events: DataFrame, length: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts and sums by tumbling window; in append and update mode, events of windows that ended ``delay`` before the newest are left out."""
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", length), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def history(events: DataFrame, key: str = "user_id", most: int = 50) -> DataFrame:
    """Each key's back stack as its events come: (key, depth, current). A stack holds the newest ``most`` places, as the feature has it. A ``view`` pushes its event, an ``error`` pops one."""

    def fold(group: tuple, batches, state: GroupState):
        stack = list(state.get[0]) if state.exists else []
        for pdf in batches:
            for kind, event in pdf.sort_values(["ts", "event_id"])[["event_type", "event_id"]].itertuples(index=False):
                if kind == "view":
                    stack = (stack + [int(event)])[-most:]
                elif kind == "error" and stack:
                    stack.pop()
        state.update((stack,))
        yield pd.DataFrame({key: [group[0]], "depth": [len(stack)], "current": [stack[-1] if stack else None]}).astype({"current": "Int64"})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} long, depth int, current long", "stack array<long>", "update", GroupStateTimeout.NoTimeout)


def batches(path: str, complete: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that keeps each batch's rows once below ``path``, however often the batch comes.

    A batch's rows are staged, their digest is written to *log*, then they are moved to a folder of their own under *data*,
    and a mark in *done* comes last. A batch that comes again with the digest it had is passed over if its mark is there,
    else its folder is put there anew; with another digest it takes the place of the one before, and the marks of the
    batches behind it are dropped, as they followed from other rows. With ``complete``, a batch stands for all that
    was before, and older folders go.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark, staged = batch.sparkSession, f"{path}/staged/{n}"
        batch.write.mode("overwrite").parquet(staged)  # the stream's plan runs once
        told = _digest(spark.read.parquet(staged))
        logged, done = _numbers(spark, f"{path}/log"), _numbers(spark, f"{path}/done")
        before = spark.read.parquet(f"{path}/log/{n}").first() if n in logged else None
        if before is None or tuple(before) != told:
            for later in [x for x in done if x >= n]:
                remove(spark, f"{path}/done/{later}")
            done = [x for x in done if x < n]
            spark.createDataFrame([told], "n_rows long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{n}")
        if n not in done:
            remove(spark, f"{path}/data/{n}")
            _move(spark, staged, f"{path}/data/{n}")
            spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/done/{n}")
        else:
            remove(spark, staged)
        if complete:
            for older in [x for x in done if x < n]:
                remove(spark, f"{path}/done/{older}")
                remove(spark, f"{path}/data/{older}")

    return apply


def kept(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of all batches that ``batches`` finished, with ``batch``, its number."""
    numbers = sorted(_numbers(spark, f"{path}/done"))
    out = None
    for n in numbers:
        one = spark.read.parquet(f"{path}/data/{n}").withColumn("batch", F.lit(n).cast("long"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    return out


def differing(spark: SparkSession, path: str) -> list[int]:
    """Finished batches whose rows are no longer what the log says: those to be built anew."""
    out = []
    for n in sorted(_numbers(spark, f"{path}/done")):
        if _digest(spark.read.parquet(f"{path}/data/{n}")) != tuple(spark.read.parquet(f"{path}/log/{n}").first()):
            out.append(n)
    return out


def _digest(rows: DataFrame) -> tuple[int, str]:
    """How many rows, and the sum of their hashes, which no order changes."""
    return tuple(rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first())


def _move(spark: SparkSession, source: str, target: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at(target).getParent())
    if not files.rename(at(source), at(target)):
        raise OSError(f"{source} could not be moved to {target}")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished folders below ``path``; a listing of names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    return [int(x.getPath().getName()) for x in files.listStatus(root) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", key: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote; its checkpoint is in the shared folder.

    In update mode, with ``key``, a key's row is its newest one; without, every update is a row.
    """
    import uuid

    spark = stream.sparkSession
    root = f"{shared(spark)}/folio-stream-{name}-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(batches(root, mode == "complete")).trigger(availableNow=True).start().awaitTermination()
    rows = kept(spark, root, stream.schema)
    if key is None:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


def upserts(path: str, key: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that keeps a table by document below ``path``: each batch replaces the rows of its keys.

    The table is dealt to BUCKETS folders by key, and a batch writes only the folders of its own keys, under
    its number; ``current`` reads each folder's newest. A batch that comes again after a failure writes the
    same again. Versions of a folder older than the ``keep`` newest go.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        batch = batch.withColumn("table_bucket", bucket).persist()
        hit = [r["table_bucket"] for r in batch.select("table_bucket").distinct().collect()]
        before = {b: max(older) for b, vs in _versions(spark, path).items() if b in hit and (older := [v for v in vs if v < n])}
        new = batch
        if before:
            old = spark.read.schema(batch.drop("table_bucket").schema).option("basePath", path).parquet(*[f"{path}/table_bucket={b}/table_version={v}" for b, v in sorted(before.items())])
            new = replaced(old.drop("table_version").select(batch.columns), batch, key)
        new.withColumn("table_version", F.lit(n)).repartition("table_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_bucket", "table_version").parquet(path)
        batch.unpersist()
        for b, versions in _versions(spark, path).items():
            for v in sorted(versions)[:-keep]:
                remove(spark, f"{path}/table_bucket={b}/table_version={v}")

    return apply


def run_upserts(stream: DataFrame, key: str) -> DataFrame:
    """Runs a stream over all that is there now into a table by ``key``; its checkpoint is in the shared folder."""
    import uuid

    spark = stream.sparkSession
    root = f"{shared(spark)}/folio-upserts-{uuid.uuid4().hex}"
    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(upserts(f"{root}/table", key)).trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{root}/table")


#: Folders of a table kept by batches.
BUCKETS = 16


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket's folder; a listing of names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if files.exists(root):
        for folder in files.listStatus(root):
            name = folder.getPath().getName()
            if name.startswith("table_bucket="):
                out[int(name.split("=")[1])] = [int(x.getPath().getName().split("=")[1]) for x in files.listStatus(folder.getPath()) if x.getPath().getName().startswith("table_version=")]
    return out


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upserts`` keeps, as its last batch left it."""
    newest = [f"{path}/table_bucket={b}/table_version={max(vs)}" for b, vs in sorted(_versions(spark, path).items()) if vs]
    return spark.read.option("basePath", path).parquet(*newest).drop("table_bucket", "table_version")
