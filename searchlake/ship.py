"""The package itself, sent to the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of this package to the application once, so that its workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="searchlake-zip-")) / "searchlake.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
