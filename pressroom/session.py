"""Session settings shared by tests, bench and the driver entry point."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: wall-clock timestamps are interpreted in UTC,
# ANSI stays on (so we use try_cast / try_divide explicitly), AQE re-plans joins and
# coalesces / splits shuffle partitions at runtime.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


MB = 1 << 20


def scale_settings(input_bytes: int, cores: int, partition_bytes: int = 256 * MB) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of input on ``cores`` cores.

    Scan splits of ``partition_bytes`` (capped so every core gets work on small inputs);
    initial shuffle partitions = input / 128 MB, at least 2x the cores -- AQE then coalesces
    small ones to the advisory size and splits skewed ones. For 100 TB on 1000 executors x 8
    cores: 256 MB splits (~400 k scan tasks), 819 200 initial shuffle partitions coalesced to
    ~128 MB each, so no task's shuffle block outgrows executor memory.
    """
    split = max(4 * MB, min(partition_bytes, input_bytes // max(1, cores) or partition_bytes))
    shuffle = max(2 * cores, input_bytes // (128 * MB))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * MB),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * MB),
    }


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "pressroom",
                  extra: dict | None = None, input_bytes: int | None = None) -> SparkSession:
    """Session with ``BASE_CONF``; with ``input_bytes`` the partition sizes come from
    :func:`scale_settings` instead of the fixed ``shuffle_partitions``."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if input_bytes is not None:
        cores = int(master[6:-1]) if master.startswith("local[") and master[6:-1].isdigit() else os.cpu_count() or 8
        conf.update(scale_settings(input_bytes, cores))
    conf.setdefault("spark.driver.memory", os.environ.get("PRESSROOM_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is the folder the cluster names in ``spark.checkpoint.dir``; we only
    pick our own (a fresh folder under the system temp dir) when the session names none, as
    in tests. The core setting itself is never modified at runtime: only the context's
    checkpoint directory is set.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="pressroom-ckpt-")
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder; :func:`drop_scratch` deletes it, at
    the latest when the interpreter ends."""
    path = os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append((spark, path))
    return path


_SCRATCH: list[tuple[SparkSession, str]] = []


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this session has under its scratch paths. Results that read from there must
    have been written or collected before."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for entry in [e for e in _SCRATCH if e[0] is spark]:
        path = hadoop.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _SCRATCH.remove(entry)


def _drop_all() -> None:
    for spark in {id(s): s for s, _ in _SCRATCH}.values():
        try:
            drop_scratch(spark)
        except Exception:  # noqa: BLE001 -- the session may have ended before the interpreter
            pass


atexit.register(_drop_all)


def cut_lineage(df):
    """``checkpoint()`` into the shared checkpoint folder, then re-alias every column.

    A checkpoint keeps the attribute ids of the plan it came from; joining it back to a
    frame of the same lineage (per-group stats joined to their rows) then needs attribute
    de-duplication that Spark cannot do for checkpointed relations when adaptive execution
    is off. Fresh aliases make such joins plain."""
    from pyspark.sql import functions as F

    checkpoint_root(df.sparkSession)
    done = df.checkpoint(eager=True)
    return done.select(*[F.col(f"`{c}`").alias(c) for c in done.columns])
