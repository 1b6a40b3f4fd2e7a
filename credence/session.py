"""A session with the settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("credence").config("spark.sql.shuffle.partitions", str(partitions))
    return builder.config(map=SETTINGS | more).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where it is
    unset, a local session gets a temporary folder; a cluster is refused, since executors would not
    see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there. Later jobs then read those
    files and do not depend on the executors that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it from there. Later jobs read the columns
    they use, and know the table's size; ``discard`` removes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def tables(spark: SparkSession, sf_dir: str, *names: str):
    """The named tables of a folder of Parquet files; one frame for one name."""
    got = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return got[0] if len(got) == 1 else got
