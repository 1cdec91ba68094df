"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. If that is unset, one of our own where all work is done by this machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="corpusmill-"))
            atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
        folder = f"file://{_OWN_DIR[0]}"
    return folder.rstrip("/")


def staged(frame: DataFrame, kind: str = "stage", by: tuple[str, ...] = ()) -> DataFrame:
    """Write frame to the shared folder, in folders by some columns, and read it back: cuts lineage, survives lost executors, has known size."""
    path = f"{shared_dir(frame.sparkSession)}/corpusmill-{kind}-{uuid.uuid4().hex}"
    frame.write.partitionBy(*by).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path).select(*frame.columns)
