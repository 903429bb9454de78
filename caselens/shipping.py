"""Send this package to the executors, as ``--py-files`` would."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="run-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
