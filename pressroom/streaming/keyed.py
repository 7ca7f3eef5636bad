"""J24 as keyed state: the first fetch of a key wins, remembered by the stream itself.

``stream_ingest`` asks the sink for the keys it holds; here a stateful operator keeps the first fetch of
every key in the state store (the session's provider: RocksDB where the keys outgrow the executors'
memory), checkpointed to the shared folder. A batch reads no sink. Rows of a key that is
known are dropped, unless they belong to its first fetch; among the rows of a new key the smallest
``order`` of the batch wins. ``expire_ms`` bounds the state by event time (``order`` must be a
timestamp then): a key is forgotten once the stream is so much past its last row, and rows that come
later than that are dropped.

State lies by bucket of keys (their hash): a bucket's rows are judged in columns, with one call of Python a
bucket and batch instead of one a key, whatever the number of keys. The keys themselves are compared, not
their hashes. The rows of one key go to one task, but that task holds no more of them than those of the
smallest ``order`` so far, one article, and the rows that came since they were last sifted. A batch writes
the state of the buckets that it brings new keys to. The file sink's
log makes the output exactly-once, and a restarted query goes on from its checkpoint.

Counts per batch are observed metrics of the running plan (``observe``), taken from the query's
progress by a listener: no row is read again to be counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressroom.streaming.ingest import AUDIT_SCHEMA

#: Buckets of keys of a stream: checkpoints hold state by their numbers, so this stays as it is.
BUCKETS = 1024
#: Rows of new keys that a bucket holds unsifted, at least.
SIFT_ROWS = 20_000
#: What a bucket remembers of its keys: the order of the first fetch, and the event time (ms) after which it is forgotten.
KNOWN = pa.schema([("key", pa.string()), ("first", pa.int64()), ("until", pa.int64())])


def _stored(known: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(known, KNOWN, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, KNOWN) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _smallest(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The rows of each key's smallest order."""
    rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
    return rows[rows["_order"] == rows.groupby("_key", sort=False)["_order"].transform("min")]


def first_fetch_of(columns: Sequence[str], expire_ms: int | None):
    """The function of a bucket: remembers the first ``_order`` of its keys, passes on the rows of those
    fetches."""
    columns = list(columns)

    def judge(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame({"key": pd.Series(dtype=object), "first": pd.Series(dtype="int64"), "until": pd.Series(dtype="int64")})
        if state.exists:
            known = pa.ipc.open_stream(pa.py_buffer(bytes(state.get[0]))).read_all().to_pandas()
        keys, first, until = pd.Index(known["key"], dtype=object), known["first"].to_numpy(), known["until"].to_numpy().copy()
        watermark = state.getCurrentWatermarkMs() if expire_ms is not None else 0
        seen, fresh, kept, waiting, latest = np.zeros(len(keys), bool), [], 0, 0, {}
        for part in () if state.hasTimedOut else rows:
            part.columns = [*columns, "_order", "_key", "_bucket", "_event"][: part.shape[1]]  # names with a leading underscore arrive as places
            at = keys.get_indexer(part["_key"])
            seen[at[at >= 0]] = True
            if expire_ms is not None:
                for key, last in part.groupby("_key", sort=False)["_event"].max().items():
                    latest[key] = max(latest.get(key, 0), 0 if pd.isna(last) else int(last.timestamp() * 1000))
            is_known = at >= 0
            if is_known.any():
                old = part[is_known]
                yield old.loc[old["_order"].to_numpy() == first[at[is_known]], columns]
            if not is_known.all():
                fresh.append(part[~is_known])
                waiting += len(fresh[-1])
                if waiting > max(SIFT_ROWS, kept):  # so often that the rows held stay bounded, and no oftener
                    fresh, waiting = [_smallest(fresh)], 0
                    kept = len(fresh[0])
        new = _smallest(fresh) if fresh else None
        if new is not None:
            yield new[columns]
        # the keys known from now on
        added = new[["_key", "_order"]].drop_duplicates("_key") if new is not None else None
        if expire_ms is not None:
            # anew whenever the key is seen; the watermark is expire_ms behind
            until[seen] = [max(latest[key], watermark) + 1 for key in keys[seen]]
        stays = seen | (until >= watermark) if expire_ms is not None else np.ones(len(keys), bool)
        known = pd.DataFrame({"key": keys[stays], "first": first[stays], "until": until[stays]})
        if added is not None:
            ends = [max(latest[k], watermark) + 1 for k in added["_key"]] if expire_ms is not None else 0
            known = pd.concat([known, pd.DataFrame({"key": added["_key"].to_numpy(), "first": added["_order"].to_numpy(), "until": ends})], ignore_index=True)
        if not len(known):
            state.remove()
            return
        if added is not None or expire_ms is not None:
            state.update((_stored(known),))
        if expire_ms is not None:
            state.setTimeoutTimestamp(int(known["until"].min()))

    return judge


class BatchCounts(StreamingQueryListener):
    """The observed counts of every batch, as its progress reports them."""

    def __init__(self, metrics: Sequence[str]):
        self.metrics, self.rows = list(metrics), {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics
        if all(m in seen for m in self.metrics):
            self.rows[event.progress.batchId] = tuple(int(seen[m]["n"]) for m in self.metrics)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def order_value(order: str, schema: T.StructType):
    """The order as a long, nulls last."""
    kind = schema[order].dataType
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        value = F.unix_micros(F.col(order).cast("timestamp"))
    elif isinstance(kind, T.DateType):
        value = F.unix_date(F.col(order)).cast("long")
    else:
        value = F.col(order).cast("long")
    return F.coalesce(value, F.lit(2**63 - 1))


def keyed_first_fetch(stream: DataFrame, key: Sequence[str], order: str, expire_ms: int | None = None) -> DataFrame:
    """The stateful operator on a stream: rows of the first fetch of each key (null is a key)."""
    rows = stream.withColumn("_order", order_value(order, stream.schema))
    # a key that tells null from every value
    keyed = rows.withColumn("_key", F.to_json(F.struct(*[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(key)])))
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int"))
    timeout = GroupStateTimeout.NoTimeout
    if expire_ms is not None:
        timeout = GroupStateTimeout.EventTimeTimeout
        keyed = keyed.withColumn("_event", F.col(order).cast("timestamp")).withWatermark("_event", f"{expire_ms} milliseconds")
    # a long beside a null would reach pandas as a double, which rounds beyond 2^53
    longs = {f.name: F.col(f"`{f.name}`") for f in stream.schema.fields if isinstance(f.dataType, T.LongType)}
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in longs else f for f in stream.schema.fields])
    keyed = keyed.withColumns({c: value.cast("string") for c, value in longs.items()})
    first = keyed.groupBy("_bucket").applyInPandasWithState(first_fetch_of(stream.columns, expire_ms), schema, "known binary", "append", timeout)
    return first.withColumns({c: value.cast("long") for c, value in longs.items()})


def stream_keyed(spark: SparkSession, src: str, sink: str, checkpoint: str, schema: T.StructType | str, key: Sequence[str], order: str,
                 audit: str | None = None, expire_ms: int | None = None, fmt: str = "parquet", partition_by: Sequence[str] = (),
                 max_files_per_trigger: int | None = None, glob_filter: str | None = None):
    """Run the keyed ingest over what has landed (``availableNow``); returns the finished query.
    ``audit``: folder for one row per batch (:func:`pressroom.streaming.ingest.batch_audit`)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    n = F.count(F.lit(1)).alias("n")
    fresh = keyed_first_fetch(reader.load(src).observe("input", n), key, order, expire_ms).observe("written", n)
    writer = fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    counts = BatchCounts(["input", "written"])
    spark.streams.addListener(counts)
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(counts)
    if audit:
        # one row per batch of this run, in the folder of its number: a batch that ran again counts once
        for batch, (n_input, n_written) in sorted(counts.rows.items()):
            row = spark.createDataFrame([(batch, n_input, n_written)], AUDIT_SCHEMA).drop("batch_id")
            row.write.mode("overwrite").parquet(f"{audit}/batch_id={batch}")
    return query
