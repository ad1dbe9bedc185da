"""Writing results, and tables that cut the lineage of a long plan."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litevidence.functions.text import join_list

_OWN: dict[str, str] = {}            # temporary folder of each application on one machine
_STAGED: dict[str, list[str]] = {}   # tables written by each application


def write_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def flatten_arrays(rows: DataFrame, delimiter: str = ", ") -> DataFrame:
    """Array columns as delimited text, since delimited files hold no arrays."""
    flat = {name: join_list(name, delimiter) for name, kind in rows.dtypes if kind.startswith("array")}
    return rows.withColumns(flat) if flat else rows


def write_text(rows: DataFrame, path: str, sep: str = "\t", delimiter: str = ", ") -> None:
    """Delimited text, each part file with a header line; quotes are doubled, so any text survives."""
    _text_writer(flatten_arrays(rows, delimiter), sep).csv(path)


def write_single_text(rows: DataFrame, path: str, sep: str = "\t", delimiter: str = ", ") -> None:
    """The same as one file. One task writes it, so it is meant for small reports; see `write_merged_text`."""
    _text_writer(flatten_arrays(rows, delimiter).repartition(1), sep).csv(path)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_merged_text(rows: DataFrame, path: str, sep: str = "\t", delimiter: str = ", ") -> None:
    """Delimited text as a single file with one header line, written by all tasks.

    Parts without a header are written in parallel beside `path` and joined behind the header in part order, so sorted
    rows stay sorted. A file system that can join files by itself does so; elsewhere their bytes are appended
    one after the other through a small buffer. An existing file is replaced once the new one is whole; parts
    go in any case. A table without rows gives the header alone.
    """
    spark = rows.sparkSession
    flat = flatten_arrays(rows, delimiter)
    work = f"{path}.parts-{uuid.uuid4().hex}"
    system, folder = file_system(spark, work)
    java = spark._jvm.org.apache.hadoop
    try:
        _text_writer(flat, sep).option("header", False).csv(f"{work}/parts")
        parts = sorted(
            (s.getPath() for s in system.listStatus(java.fs.Path(f"{work}/parts")) if s.getPath().getName().startswith("part-")),
            key=lambda p: p.getName(),
        )
        whole = java.fs.Path(f"{work}/whole")
        header = bytearray((sep.join(_cell(c, sep) for c in flat.columns) + "\n").encode())
        out = system.create(whole, True)
        out.write(header)
        out.close()
        if not _joined(spark, system, whole, parts):
            out = system.create(whole, True)
            out.write(header)
            for part in parts:
                source = system.open(part)
                java.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
            out.close()
        target = java.fs.Path(path)
        system.delete(target, False)
        if not system.rename(whole, target):
            raise OSError(f"could not write {path}")
    finally:
        system.delete(folder, True)


def _joined(spark: SparkSession, system, whole, parts: list) -> bool:
    """Whether the file system has joined the parts behind `whole` by itself."""
    full = [p for p in parts if system.getFileStatus(p).getLen() > 0]
    if not full:
        return True
    gateway = spark.sparkContext._gateway
    listed = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Path, len(full))
    for i, part in enumerate(full):
        listed[i] = part
    try:
        system.concat(whole, listed)
    except UnsupportedOperationException:
        return False
    except Py4JJavaError as error:
        if "UnsupportedOperation" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def _cell(text: str, sep: str) -> str:
    """A header cell, quoted where it has to be."""
    return '"' + text.replace('"', '""') + '"' if any(x in text for x in (sep, '"', "\n", "\r")) else text


def _text_writer(rows: DataFrame, sep: str):
    return (
        rows.write.mode("overwrite").option("sep", sep).option("header", True).option("escape", '"')
    )


def stage_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir` of the session.

    Only a session on one machine may do without it; it gets a temporary folder, the same for all calls.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="litevidence-")
        _OWN[context.applicationId] = folder
    return folder.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by `drop_staged`."""
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(rows: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write rows to the shared folder and read them back: computed once, and kept if executors are lost.

    The table stays until `drop_staged`, since results may still read it.
    """
    path = staged_path(rows.sparkSession, name)
    write_parquet(rows, path, partition_by)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Removes the tables that `staged` has written in this application. Call it once results are written."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        system, place = file_system(spark, path)
        system.delete(place, True)


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.limit(n)


def column_report(rows: DataFrame) -> DataFrame:
    """Values present per column, as a quick check of a result."""
    return rows.agg(*[F.count(F.col(c)).alias(c) for c in rows.columns])
