"""Watching a folder of pages: streams whose batches replace the findings of the files they bring.

What stands is a keyed table of versions: a batch is one version, readers never see half of one, a batch that comes
again is not written again, and a read costs what is alive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markcheck.operators.incremental import fingerprint
from markcheck.scratch import materialize
from markcheck.sources import listing, versions

Check = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, root: str, suffixes: Sequence[str], per_batch: int = 1000) -> DataFrame:
    """``path, text, modified`` of files as they come, by suffix."""
    glob = f"*{suffixes[0]}" if len(suffixes) == 1 else "*{" + ",".join(suffixes) + "}"
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of Parquet files as they come; ``path`` is a folder or one file."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a glob: the source takes a lone file only by one


def upsert(batch: DataFrame, batch_id: int, check: Check, snapshots: str, stream: str = "watch") -> None:
    """Puts the findings of a batch in the place of what its paths had; doing it again for a stream changes nothing."""
    marked = batch.withColumn("fingerprint", fingerprint(F.col("path"), F.col("text")))
    found = check(marked.select("path", "text"))
    rows = marked.select("path", "fingerprint").join(found, "path", "left").withColumn("batch_id", F.lit(batch_id).cast("long"))
    versions.replace(batch.sparkSession, snapshots, "path", lambda _: (rows, rows.limit(0)), stream, batch_id)


def current(spark: SparkSession, snapshots: str) -> DataFrame | None:
    """The findings that stand, a row without one for a clean file; None before the first batch."""
    return versions.read(spark, snapshots)


def watch(stream: DataFrame, check: Check, snapshots: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the watch; ``once`` takes what is there and stops. Takes new files; ``watch_edits`` also sees edited ones."""
    writer = stream.writeStream.foreachBatch(lambda batch, i: upsert(batch, i, check, snapshots, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def recheck(spark: SparkSession, root: str, suffixes: Sequence[str], batch_id: int, check: Check, snapshots: str, ignores: Sequence[str] = (), looked: DataFrame | None = None, stream: str = "watch") -> None:
    """Checks what is new or not as last seen under ``root``, and forgets what went.

    ``looked`` is the listing of some folders, whole (rows without a path name folders that may be empty); without it
    everything is listed. Only changed files are read. Doing a batch of a stream again changes nothing.
    """
    now = materialize(listing.listed(spark, root, suffixes, ignores) if looked is None else looked, "listing")
    files = now.where("path is not null")

    def change(last: DataFrame | None) -> tuple[DataFrame, DataFrame] | None:
        seen = ["folder", "path", "modified", "bytes"]
        before = files.limit(0) if last is None else last.select(*seen).distinct()
        if looked is not None:
            before = before.join(now.select("folder").distinct(), "folder", "left_semi")
        before = materialize(before, "seen-files")
        changed = materialize(files.join(before, ["path", "modified", "bytes"], "left_anti"), "changed-files")
        gone = before.select("path").join(files, "path", "left_anti")
        if changed.isEmpty() and gone.isEmpty():
            return None
        found = check(listing.with_text(changed.select("path")))
        return changed.select(*seen).join(found, "path", "left").withColumn("batch_id", F.lit(batch_id).cast("long")), gone

    versions.replace(spark, snapshots, "path", change, stream, batch_id)


def watch_edits(spark: SparkSession, root: str, suffixes: Sequence[str], check: Check, snapshots: str, checkpoint: str, every: str | None = "1 second", ignores: Sequence[str] = ()) -> StreamingQuery:
    """Starts a watch that also sees edited and vanished files; without ``every`` it looks once and stops.

    A tick lists the folders that are not ignored, and compares the files of those that changed with what stands.
    """
    stream = listing.listed_stream(spark, root, suffixes, ignores)
    writer = stream.writeStream.foreachBatch(lambda batch, i: recheck(spark, root, suffixes, i, check, snapshots, ignores, batch, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def standing(spark: SparkSession, snapshots: str) -> DataFrame | None:
    """What ``watch_edits`` has found so far, None before its first version."""
    return versions.read(spark, snapshots)
