"""Session settings and tables staged in the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orrery")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where it is unset a session on one machine
    gets a folder of its own; a cluster, whose machines would not share it, gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='orrery-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of a part into which ``dealt`` cuts a table.
PART_ROWS = 50_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with those of equal ``keys`` in one part, and as many parts as keep each near ``PART_ROWS``.

    What groups, ranks or joins by these keys and others needs no further shuffle, and
    no task's memory grows with the table.  ``rows`` are counted, so they are to be a plain or staged table.
    """
    spark = rows.sparkSession
    # Else a join by these keys and others shuffles both sides anew, and a union, whose parts Spark 4.1 miscounts
    # once it is read with fewer, fails.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    return rows.repartition(n, *keys)


#: Bytes of a batch of whole texts on its way to Python or back.
BATCH_BYTES = 8 << 20


def text_batches(rows: DataFrame) -> DataFrame:
    """``rows``, after the session's Arrow batches are held to ``BATCH_BYTES``, however many rows that is."""
    conf = rows.sparkSession.conf
    for way in ("maxBytesPerBatch", "maxBytesPerOutputBatch"):
        name = f"spark.sql.execution.arrow.{way}"
        if not 0 < int(conf.get(name).rstrip("b")) <= BATCH_BYTES:
            conf.set(name, f"{BATCH_BYTES}b")
    return rows


_STAGED: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> int:
    """Deletes all staged tables of a session and returns their number.

    For long sessions, between one piece of work and the next: results that were
    not written or collected yet may still read staged tables and cannot be read afterwards.
    """
    own = [pair for pair in _STAGED if pair[0] is spark]
    for pair in own:
        _delete(*pair)
        _STAGED.remove(pair)
    return len(own)


@atexit.register
def _clean() -> None:
    """Removes the staged tables of sessions that still run when Python ends."""
    for spark, folder in _STAGED:
        if spark.sparkContext._jsc is not None:
            _delete(spark, folder)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: what follows rereads files instead of computing ``df``
    again, also after executors are lost.  Computes ``df`` once, whereas a
    reliable ``checkpoint()`` computes it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, label: str, by: str) -> str:
    """The folder, with its scheme, where ``df`` is written once as Parquet with a folder of its own for each value of the column ``by``."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/orrery-{label}-{uuid.uuid4().hex}")
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _STAGED.append((spark, path))
    df.repartition(by).write.partitionBy(by).parquet(path)
    return path


def read_staged(folder: str, by: str, value, columns: list[str]) -> pa.Table | None:
    """In a task: the rows of ``staged_by`` for one value, None where there are none."""
    uri = urlsplit(folder)
    files, root = (fs.LocalFileSystem(), uri.path) if uri.scheme in ("", "file") else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
    root = f"{root}/{by}={value}"
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return None
    return pq.read_table(root, filesystem=files, partitioning=None, columns=columns, use_threads=False)


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/orrery-" in folder:
            _delete(spark, folder)
