"""Session helpers: settings for jobs and tests, the shared work folder, small rule tables."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings a job should run with. Partition counts and sizes stay the cluster's own.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Of a repeated JSON key the last one counts, as in most JSON readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Pages are large rows: keep Arrow batches small in rows, the byte limit still applies.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("shelfwatch")
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session.

    Jobs started with the package in --py-files do not need it; a second copy does no harm.
    """
    if spark.conf.get("shelfwatch.shipped", None):
        return
    folder = tempfile.mkdtemp(prefix="shelfwatch-package-")  # read by the driver alone, which serves it
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(f"{folder}/shelfwatch", "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("shelfwatch.shipped", "true")


def work_folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A new folder for a written table, below `base` or the shared folder in spark.checkpoint.dir.

    A cluster must name one of them. Only a local session, whose tasks all run in this process, may
    name neither; it then works below the machine's temporary folder.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a shared folder for written tables: set spark.checkpoint.dir or pass one")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/shelfwatch/{name}-{uuid.uuid4().hex}"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def rule_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A fixed rule list as a local relation, safe to broadcast: its size is the code's."""
    names = [part.strip().split(" ", 1) for part in ddl.split(",")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(name for name, _ in names)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules({columns})").select(
        *[F.col(name).cast(kind) for name, kind in names]
    )
