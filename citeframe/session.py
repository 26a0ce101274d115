"""Session helpers: a local session for tests and bench, lineage cuts, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A relation is only replicated to every executor when its measured payload is below this.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("citeframe")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # sort-merge joins become hash joins where every partition of one side is measured small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a
    temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        own = tempfile.mkdtemp(prefix="citeframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return current


def run_dir(spark: SparkSession) -> str:
    """Where this application keeps what it writes between its jobs."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _on_store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _on_store(spark, path)
    return files.exists(place)


def write_once(spark: SparkSession, path: str, line: str) -> bool:
    """Creates a file of one line; False if it is there already. It is written under another name and renamed, so
    that it is never seen half written."""
    files, place = _on_store(spark, path)
    _, draft = _on_store(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray((line + "\n").encode()))
    out.close()
    if not files.exists(place) and files.rename(draft, place):
        return True
    files.delete(draft, False)
    return False


def release(spark: SparkSession) -> None:
    """Deletes what this application stored between its jobs, once its results are read or written."""
    files, place = _on_store(spark, run_dir(spark))
    files.delete(place, True)


# payloads measured while relations were written; an entry goes when its DataFrame does
_measured: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def _payload(df: DataFrame) -> list[Column]:
    """Row count, and bytes of text and nested values over all rows."""
    text = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "string":
            text = text + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif kind == "array" and field.dataType.elementType.typeName() == "string":
            lengths = F.transform(F.col(field.name), lambda x: F.coalesce(F.octet_length(x), F.lit(0)) + 16)
            text = text + F.coalesce(F.aggregate(lengths, F.lit(0), lambda a, b: a + b), F.lit(0))
        elif kind == "array" and field.dataType.elementType.typeName() not in ("array", "struct", "map", "binary"):
            text = text + F.coalesce(F.size(F.col(field.name)), F.lit(0)) * 8
        elif kind in ("array", "struct", "map"):
            text = text + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("b")]


def _bytes(row: dict, columns: int) -> int:
    return row["n"] * 16 * columns + row["b"]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once by a reliable checkpoint and restart its lineage from there.

    The payload is observed in the same job, so a later size check costs nothing.
    """
    shared_dir(df.sparkSession)
    seen = Observation()
    done = df.observe(seen, *_payload(df)).checkpoint(eager=True)
    metrics = seen.get
    if "n" in metrics:  # else the size is measured when it is first asked for
        _measured[done] = _bytes(metrics, len(df.columns))
    return done


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: for relations that are
    large or read by column."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Files a task keeps open when it writes buckets, before it would sort its rows
OPEN_FILES = 64


def write_buckets(df: DataFrame, path: str, buckets: int, by: str) -> DataFrame:
    """Write ``df`` as Parquet in ``buckets`` by the hash of ``by`` and read it back: joins and groups on ``by`` then need no
    shuffle. Rows go to their files as they come; they are dealt by ``by`` beforehand, or read from such buckets, so that a
    task has few."""
    spark, draft = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    ways = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES), "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {name: spark.conf.get(name) for name in ways}
    try:
        for name, value in ways.items():
            spark.conf.set(name, value)
        df.write.format("parquet").bucketBy(buckets, by).options(path=path, compression="zstd").saveAsTable(draft)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    found = spark.table(draft)
    spark.sql(f"DROP TABLE {draft}")  # its files stay
    return found


def payload_bytes(df: DataFrame) -> int:
    """Rows times 16 bytes per column plus text and nested values; read off if ``df`` was cut."""
    known = _measured.get(df)
    if known is None:
        known = _bytes(df.agg(*_payload(df)).first().asDict(), len(df.columns))
        _measured[df] = known
    return known


def part_of(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Marks ``part`` as no larger than ``whole``, whose payload is known."""
    _measured[part] = payload_bytes(whole)
    return part


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return payload_bytes(df) <= limit


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
