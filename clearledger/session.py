"""Session settings."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster the session comes from the submitter and the library reads
    its settings; nothing below is needed there.
    """
    partitions = cpus if isinstance(cpus, int) else 8
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clearledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# One lock per session: those who share a session take turns, others don't wait for them.
_locks: WeakKeyDictionary[SparkSession, threading.RLock] = WeakKeyDictionary()
_locks_lock = threading.Lock()


@contextmanager
def session_conf(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Set runtime settings and put the previous ones back afterwards.

    Threads that share a session take turns, so none sees another's settings.
    """
    with _locks_lock:
        lock = _locks.setdefault(spark, threading.RLock())
    with lock:
        before = {key: spark.conf.get(key, None) for key in settings}
        try:
            for key, value in settings.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, value)


def _refuse_local(spark: SparkSession) -> None:
    """Raise an error where the warehouse is a local folder and executors run elsewhere."""
    master = spark.conf.get("spark.master", "local")
    alone = master.startswith("local") and not master.startswith("local-cluster")
    place = spark.conf.get("spark.sql.warehouse.dir")
    if not alone and (place.startswith(("file:", "/")) or ":" not in place):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors share, for tables between the steps of a job.

    Below spark.checkpoint.dir. A session without that setting, such as one in
    a test, uses its warehouse; on a cluster that must not be a folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        _refuse_local(spark)
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_between"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
