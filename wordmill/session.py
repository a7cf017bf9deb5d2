"""Session helpers: a tuned SparkSession for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Bytes of a lookup table (vocabulary, segmentation map) that we are willing to hold in every
# worker; its size is measured first. Beyond it lookups are shuffled joins.
BROADCAST_MAX_BYTES = 128 << 20


def get_session(app: str = "wordmill", master: str | None = None,
                shuffle_partitions: int | None = None,
                driver_memory: str | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    On a cluster the master, memory, shuffle partitions and checkpoint folder come from
    spark-submit; only what is passed here as an argument is set.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only on a local master a scratch folder is made where it is unset; on
    a cluster a machine-local folder would be unreadable to the other machines, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        d = tempfile.mkdtemp(prefix="wordmill-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return base.rstrip("/") + "/tables/" + name


_WRITTEN: dict[int, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back. Plans on top of it keep
    column pruning and filter pushdown, and a lost executor costs nothing. ``release`` deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut-" + uuid.uuid4().hex)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = path
    weakref.finalize(out, _WRITTEN.pop, id(out), None)
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a frame from ``cut_lineage`` that no plan needs any more."""
    path = _WRITTEN.pop(id(df), None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small driver-side table (bounded by the caller). It goes to the JVM as Arrow, so neither
    its plan nor a Python worker is paid per row. ``schema`` is a DDL string."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    cols = list(zip(*rows)) if rows else [()] * len(arrow)
    data = pa.table([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return spark.createDataFrame(data).select(*[F.col(f.name).cast(f.dataType) for f in kind])


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, wherever the driver
    got it from: a zip that Spark's own file server hands to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="wordmill-py-"), "wordmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def small_enough(table: DataFrame, limit: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether a table's strings and numbers, with the overhead of a dict entry per row, measure
    at most ``limit`` bytes."""
    from pyspark.sql import functions as F
    size = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0))
                for f in table.schema.fields), F.lit(200))
    total = table.agg(F.sum(size.cast("long"))).head()[0]
    return (total or 0) <= limit
