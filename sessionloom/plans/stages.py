"""Tables of a run, written once and read by every later step."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.cluster import shared_folder

def run_name(label: str, at: datetime.datetime | None = None) -> str:
    """A label with the time (UTC) and a few random letters: names of runs sort by time and never clash."""
    at = at or datetime.datetime.now(datetime.timezone.utc)
    return f"{label}-{at:%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:8]}"


class Tables:
    """Written tables by name: `tables(name, make)` makes and writes a table unless a finished write left it.

    With the folder of an earlier run, that run is resumed: what it finished is read.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/{run_name('run')}").rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.has(name):
            make().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))


def unwritten(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """In the place of Tables: nothing is written, and Spark sees one plan."""
    return make()
