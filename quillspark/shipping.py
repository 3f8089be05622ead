"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application, unless their search path has them."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    sc._quillspark_shipped = True
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(target))


#: Bytes of one Arrow batch sent to a Python worker: by Spark's bound of 10,000 rows alone, its memory follows the length of the texts.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of what a Python worker is given at once; releases that don't know the setting keep their bound on rows."""
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    except Exception as e:
        if "CANNOT_MODIFY" not in str(e) and "UNKNOWN" not in str(e).upper():
            raise
