"""Lineage cuts that survive the loss of executors, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Bytes up to which a measured side may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 10 << 20
#: Bytes that a broadcast row takes besides its values.
ROW_OVERHEAD = 48


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in `spark.checkpoint.dir`; one of our own only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.__dict__.get("_filmloom_root")
    if root:
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc._filmloom_root = root = tempfile.mkdtemp(prefix="filmloom-")
    _file_system(sc, root).deleteOnExit(_path(sc, root))
    return root


def application_folder(spark: SparkSession) -> str:
    """Where this application's cuts are, below `scratch_root`.

    It is deleted when the context stops, or, where nobody stops it, when the JVM ends.
    """
    sc = spark.sparkContext
    folder = f"{scratch_root(spark)}/filmloom/{sc.applicationId}"
    watched = sc.__dict__.setdefault("_filmloom_folders", set())
    if not watched:
        stop = sc.stop

        def sweep_and_stop() -> None:
            if sc._jsc is not None:
                for name in watched:
                    _delete(sc, name)
            del sc.stop
            stop()

        sc.stop = sweep_and_stop
    if folder not in watched:
        watched.add(folder)
        _file_system(sc, folder).mkdirs(_path(sc, folder))  # only what exists is deleted on exit
        _file_system(sc, folder).deleteOnExit(_path(sc, folder))
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` written as a table into the shared folder and read again: later plans start there, whatever executor is lost."""
    path = f"{application_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(*tables: DataFrame) -> None:
    """Deletes the files of `cut` results that nothing reads any more."""
    for df in tables:
        for name in _folders(df):
            _delete(df.sparkSession.sparkContext, name)


def _folders(df: DataFrame) -> set[str]:
    own = f"/filmloom/{df.sparkSession.sparkContext.applicationId}/"
    return {name.rsplit("/", 1)[0] for name in df.inputFiles() if own in name}


def _path(sc: SparkContext, name: str):
    return sc._jvm.org.apache.hadoop.fs.Path(name)


def _file_system(sc: SparkContext, name: str):
    return _path(sc, name).getFileSystem(sc._jsc.hadoopConfiguration())


def _delete(sc: SparkContext, name: str) -> None:
    _file_system(sc, name).delete(_path(sc, name), True)


def _value_bytes(name: str, kind) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        size = F.octet_length(F.to_json(F.struct(column)))
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0)) + 8


def broadcast_bytes(small: DataFrame) -> int:
    """The bytes of a `cut` side's values, measured; of a side whose files exceed BROADCAST_BYTES already, those of its files."""
    sc = small.sparkSession.sparkContext
    stored = sum(_file_system(sc, name).getContentSummary(_path(sc, name)).getLength() for name in _folders(small))
    if stored > BROADCAST_BYTES:
        return stored
    row = sum((_value_bytes(f.name, f.dataType) for f in small.schema), F.lit(ROW_OVERHEAD))
    return small.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def join_counted(large: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Joins a `cut` side that is measured first: broadcast within BROADCAST_BYTES, shuffled beyond."""
    fits = broadcast_bytes(small) <= BROADCAST_BYTES
    return large.join(F.broadcast(small) if fits else small, on, how)
