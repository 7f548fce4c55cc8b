"""Streams of log lines, tokens and arriving files.

No row is ever too late: what evicts state is the clock of the stream itself, the time a row was taken in, and that only moves
forward. State that was evicted too soon costs a second part of the same key, which the readers (``latest_...``) put together, so
that a stream ends where its batch twin ends whatever the order of files and batches. Results go to an ``EpochStore``, whose
parts stay few; buffers that are state by nature are read from the state store.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from foliograph.functions.timecodes import out_time_us, ratio_percent
from foliograph.operators.timeline import token_rows
from foliograph.session import scratch_path
from foliograph.streaming.store import EpochStore

Merge = Callable[[DataFrame], DataFrame]
CLOCK = "1 second"  # how far timers lag behind the clock

SCHEMAS = {
    "progress": "job_id string, seen timestamp, percent double, reports long",
    "tokens": "request_id string, pairs array<struct<seq: bigint, token: string>>, done boolean, tokens long",
    "files": "path string",
}


def start(stream: DataFrame, folder: str, mode: str, merge: Merge | None = None, once: bool = True, fold: bool = False) -> StreamingQuery:
    """Run ``stream`` into the store at ``folder``; with ``once`` it ends when all present input is read."""
    store = EpochStore(stream.sparkSession, folder, merge, fold)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(store.write)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def drain(stream: DataFrame, mode: str, label: str, merge: Merge | None = None, fold: bool = False) -> str:
    """Run to the end of the present input and return the folder of the store."""
    folder = scratch_path(stream.sparkSession, label)
    start(stream, folder, mode, merge, fold=fold).awaitTermination()
    return folder


def drained(stream: DataFrame, label: str) -> DataFrame:
    """The rows of an append stream up to the end of the present input."""
    return EpochStore(stream.sparkSession, drain(stream, "append", label)).read(stream.schema)


def clocked(stream: DataFrame, delay: str) -> DataFrame:
    """Add ``_seen``, the time a row was taken in, as the watermark."""
    return stream.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", delay)


def state_rows(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The rows of list state ``name`` after the last batch, with their key; None before the first one."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = fs.Path(f"{folder}/progress/commits")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place) or not any(f.getPath().getName().isdigit() for f in files.listStatus(place)):
        return None
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/progress").select("key.*", "list_element.*")


# --- progress ---------------------------------------------------------------------------


def progress_stream(lines: DataFrame, durations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Highest percent per job and window of ``delay`` (update mode); a window that has passed is evicted.

    The percent grows with the reported time, so the largest time per job is kept as state
    and the durations are joined after that: a busy job costs one row per map task.
    """
    micros = lines.withColumn("us", out_time_us(F.col("line"))).filter(F.col("us").isNotNull())
    window = F.window("_seen", delay)
    reached = clocked(micros, delay).groupBy("job_id", window.alias("window")).agg(F.max("us").alias("us"), F.count(F.lit(1)).alias("reports"))
    known = durations.filter(F.col("duration") > 0)
    percent = ratio_percent(F.col("us") / 1000000.0, F.col("duration"))
    return reached.join(known, "job_id").select("job_id", F.col("window.start").alias("seen"), percent.alias("percent"), "reports")


def merge_progress(updates: DataFrame) -> DataFrame:
    """Progress and reports only move up, so the largest update of a job and window is its latest one."""
    return updates.groupBy("job_id", "seen").agg(F.max("percent").alias("percent"), F.max("reports").alias("reports"))


def latest_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Where each job stands: highest percent and number of reports."""
    newest = EpochStore(spark, folder, merge_progress).read(StructType.fromDDL(SCHEMAS["progress"]))
    return newest.groupBy("job_id").agg(F.max("percent").alias("percent"), F.sum("reports").alias("reports"))


# --- tokens -----------------------------------------------------------------------------


def _set_timer(handle: StatefulProcessorHandle, wait: int | None) -> None:
    """The key's only timer, ``wait`` milliseconds from now; none without. The watermark it waits for follows the clock."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if wait is not None:
        handle.registerTimer(int(time.time() * 1000) + wait)


class _OpenReplies(StatefulProcessor):
    """Tokens of each request until it is done; then they are told as one part and forgotten.

    A request that does not close within ``seconds`` is told as a part that is not done. Tokens that come after the end of their
    request open it again and end up in such a part.
    """

    def __init__(self, seconds: float):
        self.wait = max(1, int(seconds * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getListState("pairs", "seq long, token string")

    def _part(self, key, pairs: list, done: bool) -> pd.DataFrame:
        self.pairs.clear()
        told = [{"seq": s, "token": t} for s, t in pairs if t is not None]
        return pd.DataFrame({"request_id": [key[0]], "pairs": [told], "done": [done], "tokens": [len(told)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, known = False, self.pairs.exists()
        for batch in rows:
            seqs = [None if pd.isna(s) else int(s) for s in batch["seq"]]
            texts = [None if pd.isna(t) else str(t) for t in batch["token"]]
            self.pairs.appendList(list(zip(seqs, texts)))
            done |= bool(batch["is_done"].any())
        if done:
            yield self._part(key, list(self.pairs.get()), True)
            if known:
                _set_timer(self.handle, None)
        elif not known:
            _set_timer(self.handle, self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pairs.exists():
            yield self._part(key, list(self.pairs.get()), False)

    def close(self) -> None:
        pass


def token_stream(lines: DataFrame, wait: float = 3600.0) -> DataFrame:
    """Replies of NDJSON lines (request_id, seq, line), each as one part when its ``done`` arrives.

    State is the tokens of requests that are open; after ``wait`` seconds an open request is told as it is.
    """
    tokens = clocked(token_rows(lines).select("request_id", "seq", "token", "is_done"), CLOCK)
    kind = StructType([f for f in tokens.schema.fields if f.name == "request_id"])
    for field in StructType.fromDDL(SCHEMAS["tokens"]).fields[1:]:
        kind = kind.add(field)
    return tokens.groupBy("request_id").transformWithStateInPandas(_OpenReplies(wait), kind, "Update", "EventTime")


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(request_id, seq, token) of requests that are still open, out of the state."""
    rows = state_rows(spark, folder, "pairs")
    return spark.createDataFrame([], "request_id string, seq long, token string") if rows is None else rows


def late_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The parts that no ``done`` has closed: requests that never ended, and what came after an end."""
    return EpochStore(spark, folder).read(StructType.fromDDL(SCHEMAS["tokens"])).filter(~F.col("done"))


def latest_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Reply per request so far: closed parts, late ones and what is open, joined in order."""
    told = EpochStore(spark, folder).read(StructType.fromDDL(SCHEMAS["tokens"]))
    pending = open_tokens(spark, folder).select(
        "request_id",
        F.when(F.col("token").isNotNull(), F.array(F.struct("seq", "token"))).otherwise(F.array().cast(told.schema["pairs"].dataType)).alias("pairs"),
        F.lit(False).alias("done"),
        F.col("token").isNotNull().cast("bigint").alias("tokens"),
    )
    parts = told.unionByName(pending).groupBy("request_id").agg(
        F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.max("done").alias("done"), F.sum("tokens").alias("tokens")
    )
    return parts.select("request_id", F.array_join("pairs.token", "").alias("text"), "done", "tokens")


# --- last lines -------------------------------------------------------------------------


class _LastRows(StatefulProcessor):
    """The last ``n`` rows of each key by their order, as a list that never grows beyond that."""

    def __init__(self, n: int, keys: list[str], places: int, ttl: float | None):
        self.n, self.keys, self.places = n, keys, [f"tail_o{i}" for i in range(places)]
        self.wait = None if ttl is None else max(1, int(ttl * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = ", ".join([*[f"{p} long" for p in self.places], "tail_row string"])
        self.handle, self.tail = handle, handle.getListState("tail", kind)

    def _order(self, row: tuple):
        return [(v is not None, v or 0) for v in row[:-1]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.tail.get())
        for batch in rows:
            columns = [[None if pd.isna(v) else int(v) for v in batch[p]] for p in self.places]
            kept = sorted([*kept, *zip(*columns, batch["tail_row"])], key=self._order)[-self.n :]
        self.tail.put(kept)
        if self.wait is not None:
            _set_timer(self.handle, self.wait)
        told = pd.DataFrame({k: [v] for k, v in zip(self.keys, key)})
        yield told.assign(kept=len(kept))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tail.clear()
        yield pd.DataFrame({k: [v] for k, v in zip(self.keys, key)}).assign(kept=0)

    def close(self) -> None:
        pass


def _as_long(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("bigint")


def _thin(n: int, keys: list[str], places: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ordered = batch.sort_values(places, kind="stable", na_position="first")
            yield ordered.groupby(keys, dropna=False, sort=False).tail(n)

    return run


def tail_stream(lines: DataFrame, n: int, keys: list[str], order: list[str], label: str = "tail", ttl: float | None = None) -> str:
    """Keep the last ``n`` rows per key as state, for the present input; returns the folder of the stream.

    ``order`` columns are numbers or times. Each batch is thinned to n rows per key and task before it is shuffled, reads and writes the state of
    its own keys alone, and tells how many rows each of them has. A key that stays silent for
    ``ttl`` seconds is forgotten.
    """
    places = [f"tail_o{i}" for i in range(len(order))]
    rows = lines.select(*keys, *[_as_long(lines, c).alias(p) for c, p in zip(order, places)], F.to_json(F.struct(*lines.columns)).alias("tail_row"))
    thin = rows.mapInPandas(_thin(n, keys, places), rows.schema)
    kind = StructType([rows.schema[k] for k in keys]).add("kept", "long")
    timed, mode = (thin, "None") if ttl is None else (clocked(thin, CLOCK), "EventTime")
    kept = timed.groupBy(*keys).transformWithStateInPandas(_LastRows(n, keys, len(places), ttl), kind, "Update", mode)
    return drain(kept, "update", label)


def latest_tail(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The buffered rows of all keys, read from the state; ``schema`` is that of the lines."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = state_rows(spark, folder, "tail")
    if rows is None:
        return spark.createDataFrame([], kind)
    return rows.select(F.from_json("tail_row", kind).alias("r")).select("r.*")


# --- arriving files ---------------------------------------------------------------------


def _first_of_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(~batch.column("path").to_pandas().duplicated().to_numpy()))


def manifest_stream(files: DataFrame, delay: str | None = None) -> DataFrame:
    """Arriving files, for a store that folds by path: ``merge_files`` with ``fold``.

    The store drops the copies, within an epoch as it is written and across epochs as parts are merged or read, so nothing is kept as
    state and no path is forgotten. For readers of the stream itself, ``delay`` tells each path once within that time. That costs a row
    of state per path; the copies are thinned in their own tasks first, so those of one path are not all sent to the same task.
    """
    if delay is None:
        return files
    return clocked(files.mapInArrow(_first_of_path, files.schema), delay).dropDuplicatesWithinWatermark(["path"]).drop("_seen")


def merge_files(files: DataFrame) -> DataFrame:
    """One row per path."""
    rest = [c for c in files.columns if c != "path"]
    if not rest:
        return files.distinct()
    return files.groupBy("path").agg(F.min(F.struct(*rest)).alias("r")).select("path", "r.*")


def latest_files(spark: SparkSession, folder: str, schema: StructType | str = SCHEMAS["files"]) -> DataFrame:
    return EpochStore(spark, folder, merge_files).read(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
