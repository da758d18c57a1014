"""Tables for one run in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary one is set if all tasks run on this machine (as
    in tests); on a cluster that is an error, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalex-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage.

    The files outlive a lost executor, so nothing above is computed again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(source: DataFrame, label: str, build: Callable[[str], None]) -> str:
    """The path of what ``build`` derives from ``source``, built once for the same files.

    Names, sizes and times of the files tell whether they are the same.  What is built
    appears under its path as a whole.
    """
    spark = source.sparkSession
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    seen = hashlib.sha256()
    for name in sorted(source.inputFiles()):
        file = jvm.org.apache.hadoop.fs.Path(name)
        status = file.getFileSystem(conf).getFileStatus(file)
        seen.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    path = f"{scratch_root(spark)}/{label}-{seen.hexdigest()}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    if not files.exists(target):
        made = scratch_path(spark, label)
        build(made)
        if not files.rename(jvm.org.apache.hadoop.fs.Path(made), target) and not files.exists(target):
            raise OSError(f"can't store {path}")
    return path


class Scratch:
    """Tables of one run under one folder of the shared place, dropped together at its end.

    ``with Scratch(spark, "label") as s: ... s.written(df, "name")``.  What is returned must
    be written elsewhere, with the function ``written``.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path, self.tables = spark, scratch_path(spark, label), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        drop_folder(self.spark, self.path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
