"""What a session needs before it runs this package: its code on the executors, and Arrow batches of bounded size."""

from __future__ import annotations

import functools
import io
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch: texts and blocks are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder of spark.checkpoint.dir; only where that is unset, to one of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or str(Path(tempfile.gettempdir()) / "strandloom-checkpoints"))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once an application, through Spark's own file server."""
    sc = spark.sparkContext
    ensure_checkpoints(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    place = Path(tempfile.mkdtemp(prefix="strandloom-")) / "strandloom.zip"
    place.write_bytes(held.getvalue())
    sc.addPyFile(str(place))
    _shipped.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package on the executors before it runs."""

    @functools.wraps(query, assigned=("__doc__",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
