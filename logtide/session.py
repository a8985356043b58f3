"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "logtide", memory: str | None = None) -> SparkSession:
    """Session with adaptive execution and the RocksDB state store.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command names the former, and for the latter start high (several times the
    executor cores) and let adaptive execution coalesce.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # a long-lived session meets more plans than the default cache of 100 holds
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # call-site capture costs several calls into the JVM per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master).config("spark.driver.host", "localhost")
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Folders that :func:`work_dir` hands out inside are deleted at the end.

    For long-lived jobs, whose batches would otherwise leave side tables for ever.
    """
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for path in _open.paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _open.paths = outer


def side_by_side(tasks: list[Callable]) -> list:
    """Results of independent small jobs run at once, each of which takes longer to start than to run.

    Folders that they take belong to the caller's :func:`scratch`.
    """
    paths, spark = getattr(_open, "paths", None), SparkSession.active()

    def within(task: Callable):
        def call():
            _open.paths = paths
            return task()
        return inheritable_thread_target(spark)(call)

    with ThreadPoolExecutor(len(tasks)) as pool:
        return [done.result() for done in [pool.submit(within(t)) for t in tasks]]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. A machine-local folder is
    made only where that is unset and the master is local, as in tests.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return path


def per_chain(rows: DataFrame) -> DataFrame:
    """A side with one row per chain, ready to be joined on chain_id alone.

    Chains are few, so a shuffle by chain_id would put the large side into a
    handful of tasks. Written first, the side has a size and is broadcast
    under the planner's threshold; the large side stays where it is.
    """
    return sized(rows, "per-chain")


def sized(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder and read back.

    For a join side that an aggregate or join made small: the planner sees no
    size for such a side and would shuffle the large side before finding out.
    A written table has one, so Spark broadcasts it when it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a sort-merge
    join with adaptive skew handling. It also survives lost executors.
    """
    spark = rows.sparkSession
    folder = work_dir(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def nothing(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, which the planner knows: joins with it cost nothing. An empty list would be read by Python workers."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).where(F.lit(False))


@contextmanager
def shuffles(partitions: int, *sessions: SparkSession):
    """Shuffles inside are planned with ``partitions`` at least, unless the sessions ask for more.

    Adaptive execution merges partitions but never makes more, so a number set once bounds nothing where inputs grow.
    """
    name = "spark.sql.shuffle.partitions"
    before = [(session.conf, session.conf.get(name)) for session in sessions]
    try:
        for conf, number in before:
            if int(number) < partitions:
                conf.set(name, str(partitions))
        yield
    finally:
        for conf, number in before:
            conf.set(name, number)


def byte_size(setting: str) -> int:
    """Bytes of a Spark setting such as ``16m``, ``128MB`` or ``134217728b``."""
    text = setting.strip().lower()
    number = text.rstrip("bkmgtpi")
    return int(number) << 10 * "bkmgtp".index((text[len(number):] or "b")[0])


#: Of a shuffle for one task inside :func:`frugal`; as raw logs 100,000 rows or so, ten times as much when decoded in memory.
SHUFFLE_BYTES = 16 << 20


@contextmanager
def frugal(*sessions: SparkSession):
    """Queries inside delete the files of their shuffles when they end, and merge partitions of these to 16 MB at most.

    Otherwise the files stay until the driver happens to collect its garbage, so those of all steps lie on the
    disks at once, and tasks of the 64 MB that Spark merges to sort several hundred MB of wide rows in memory.
    """
    sweep, merge = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = [(session.conf, session.conf.get(sweep, "false"), session.conf.get(merge)) for session in sessions]
    try:
        for conf, _, size in before:
            conf.set(sweep, "true")
            if byte_size(size) > SHUFFLE_BYTES:
                conf.set(merge, str(SHUFFLE_BYTES))
        yield
    finally:
        for conf, swept, size in before:
            conf.set(sweep, swept)
            conf.set(merge, size)
