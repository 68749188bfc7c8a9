"""A session with the settings this engine expects."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, **extra: str) -> SparkSession:
    """The running session or a new one. ``extra``: settings with _ for dots."""
    b = SparkSession.builder.appName("spotweave")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in extra.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_SHIPPED = "_spotweave_shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a context: they
    may run where neither the driver's folder nor its search path is known."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spotweave-code-"), "spotweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.join("spotweave", os.path.relpath(file, home)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)
