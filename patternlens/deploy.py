"""Makes this package importable in Python workers."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers of this application, once; Spark serves the file from the driver."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    _DONE.add(app)
    top = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    tmp = tempfile.mkdtemp(prefix="patternlens-ship-")  # on the driver alone, which serves it
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    path = os.path.join(tmp, "patternlens.zip")
    with open(path, "wb") as f:
        f.write(raw.getvalue())
    spark.sparkContext.addPyFile(path)
