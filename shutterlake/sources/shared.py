"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may fall back to a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting to drop the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _writing = Lock(), [0, ""]


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """The setting holds while any thread writes; the last one puts back what was there before."""
    with _lock:
        if not _writing[0]:
            _writing[1] = spark.conf.get(_CLEANUP, None) or "false"
            spark.conf.set(_CLEANUP, "true")
        _writing[0] += 1
    try:
        yield
    finally:
        with _lock:
            _writing[0] -= 1
            if not _writing[0]:
                spark.conf.set(_CLEANUP, _writing[1])


def write(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """df at path, and read from there. The shuffle files of the write go when it has ended, as nothing else reads them."""
    spark = df.sparkSession
    writer = df.write.option("compression", "zstd")
    with _dropping_shuffles(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table: lineage ends here, and a lost executor loses nothing."""
    return write(df, shared_path(df.sparkSession, name), by)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that must not exist, in one step; whether this was done. The folder must not be empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here, there = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = here.getFileSystem(conf)
    here, there = fs.makeQualified(here), fs.makeQualified(there)
    try:
        if here.toUri().getScheme() == "file":  # the file system's own rename: it does not go onto a folder that has something in it
            files = [jvm.java.nio.file.Paths.get(p.toUri()) for p in (here, there)]
            how = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            how[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            jvm.java.nio.file.Files.move(*files, how)
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), conf).rename(here, there, none)
    except Py4JJavaError:
        if exists(spark, target):
            return False
        raise
    return True


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    with closing(target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)) as out:
        out.write(bytearray(text.encode()))


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is no such file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    with closing(fs.open(target)) as lines:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(lines, "UTF-8")
