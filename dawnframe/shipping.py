"""Making the package known to Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_MARK = "_dawnframe_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, _MARK, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-dawnframe-"), "dawnframe.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    setattr(context, _MARK, True)
