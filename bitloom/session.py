"""Sessions, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def get_session(app: str = "bitloom", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A session for local work; on a cluster the submitter's settings win."""
    return (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_bitloom_shipped", None) is None:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()  # on the driver alone; executors fetch the archive from it
        atexit.register(shutil.rmtree, folder, True)
        archive = Path(folder) / "bitloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(archive))
        sc._bitloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is set only where the cluster names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: lost executors cost the tasks they ran and nothing that
    was written. The caller's columns must have distinct names.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bitloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote. Whatever was computed from them must be written by now."""
    for t in tables:
        jvm, spark = t.sparkSession.sparkContext._jvm, t.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: its JVM gives back heap, and Spark drops broadcasts and shuffles of dead plans."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
