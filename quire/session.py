"""What every job needs from its session."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch, unless the session says: whole texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of this application once, through Spark's own file server, and keep Arrow
    batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.writestr(f"{home.name}/{p.relative_to(home)}", p.read_text(encoding="utf-8"))
    path = os.path.join(tempfile.mkdtemp(prefix="quire-code-"), f"{home.name}_code.zip")
    Path(path).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
