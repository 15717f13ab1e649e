"""What the operators need of a cluster: a folder that all machines share, and this package on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own if all runs on this machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='sessionloom-')}")
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = f"shipped {spark.sparkContext.applicationId}"
    top = os.path.dirname(os.path.abspath(__file__))
    if app in _own or not os.path.isdir(top):  # or the driver itself runs from an archive
        return
    _own[app] = "yes"
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
