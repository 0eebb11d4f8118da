"""The session the engine is written for: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows that Python workers are given at a time: texts are long, and a batch is held on both sides. Spark's own default is 10,000.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000", "10000")


def shipped(spark: SparkSession) -> SparkSession:
    """Sends the package's code to the executors, once per application, through Spark's own file server; bounds batches unless they have been set."""
    name, rows, default = BATCH
    if spark.conf.get(name) == default:
        spark.conf.set(name, rows)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark


def session(name: str = "millrace", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on pinned. Sizes (partitions, memory) stay the cluster's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        BATCH[0]: BATCH[1],
        **conf,
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings).getOrCreate()
