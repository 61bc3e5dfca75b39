"""Python stages run on executors that may not have this package: it is sent to them once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="siftwell-")) / "siftwell_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(Path(top.name) / f.relative_to(top)))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)
