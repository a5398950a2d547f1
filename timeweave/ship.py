"""Getting this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once: Spark's file server brings it to each
    executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="timeweave-")) / "timeweave_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in [*sorted((root / "timeweave").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            z.write(source, source.relative_to(root))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
