"""Session helpers: the settings the engine expects, and its code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime settings that the record semantics rely on.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS and makes the package importable in Python workers. Cheap to call again."""
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, so that workers need no common file system path."""
    sc = spark.sparkContext
    if getattr(sc, "_talkmill_shipped", None):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="talkmill-code-")) / "talkmill.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"talkmill/{p.relative_to(root)}")
    sc.addPyFile(str(at))  # the driver serves the file to executors
    sc._talkmill_shipped = True
