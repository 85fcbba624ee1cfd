"""Session defaults and the shared folder for data that must outlive a task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the results or the scale of the analyses depend on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Window state on local disk rather than in the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Whether the state store keeps the number of its rows, and whether a batch saves a log of its changes to the
# state or else the store's new files; and what Spark does where they are unset.
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
LOGGED = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
UNSET = {COUNTED: "true", LOGGED: "false"}


def build_session(app: str = "tracemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above.

    On a cluster the master, memory and shuffle parallelism come from spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the same settings."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def switched_off(spark: SparkSession, *switches: str) -> Iterator[None]:
    """Switches of the state store off for what is started or loaded meanwhile, then as before."""
    before = {switch: spark.conf.get(switch, UNSET[switch]) for switch in switches}
    try:
        for switch in switches:
            spark.conf.set(switch, "false")
        yield
    finally:
        for switch, value in before.items():
            spark.conf.set(switch, value)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``, or below
    the warehouse where that is unset; all executors see either. It goes when the session's
    JVM ends. On a cluster a warehouse in a local folder isn't one that all see, and is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
