"""Getting this package's code to Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch, of which a task holds several at once; Spark's own default is eight times that.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to all executors, once for each application, and bound Arrow batches where the user hasn't.

    Spark's own file server carries it, so nothing depends on a folder or a path that
    executors share with the driver.
    """
    app = spark.sparkContext.applicationId
    if spark.sparkContext.getConf().get(BATCH) is None and app not in _SHIPPED:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        here = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="paperloom-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f"{here.name}/{f.relative_to(here)}")
        spark.sparkContext.addPyFile(path)
    return spark
