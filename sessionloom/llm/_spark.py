"""What the operators share: the cluster's shared folder, written tables, code shipping."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own if all runs on this machine."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        at = _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='sessionloom-')}")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The size that the optimizer expects of a table, without reading it; 0 if it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if _own.get(f"shipped {app}"):
        return
    _own[f"shipped {app}"] = "yes"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # the driver itself runs from an archive
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    at = os.path.join(tempfile.mkdtemp(prefix="sessionloom-"), "sessionloom_code.zip")
    with open(at, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in a column each; one row at least."""
    begin, n = 0, batch.num_rows
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total = 0
    for i in range(n):
        total += int(size[i])
        if total >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, total = i + 1, 0
    if begin < n:
        yield batch.slice(begin)


def schema_plus(df: DataFrame, *more: tuple[str, str]) -> T.StructType:
    """A copy of a table's schema with further columns."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in more:
        out = out.add(name, kind)
    return out
