"""Gets this package to the executors, whose Python workers import it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def package() -> bytes:
    """The package as a zip file that Python can import from."""
    top, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent).as_posix())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of this application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-package-"), "tidemark.zip")
    Path(path).write_bytes(package())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
