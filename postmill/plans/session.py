"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
#: Rows and bytes of the Arrow batches that operators take: texts may be long, and a batch stands several times in memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode, where that is unset, a temporary one. Else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="postmill-"))
    return f"{root.rstrip('/')}/postmill/{label}-{uuid.uuid4().hex[:12]}"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for each application, so that workers can import it.

    Also bounds the session's Arrow batches, where they are larger.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="postmill-py-"), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as bundle:
            for path in sorted(root.rglob("*.py")):
                bundle.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark
