"""Session builder and the few session facts operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    BATCH_ROWS: "1000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "foliant", **conf: str) -> SparkSession:
    """A session with the defaults above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of fewer rows where the session has Spark's default of 10,000: of whole texts, those are tens of MB for each task and copy."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = current or f"file://{tempfile.mkdtemp(prefix='foliant-checkpoint-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses nothing of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
