"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PROCESS = uuid.uuid4().hex[:12]
_ROOTS: set[str] = set()
_OWN: dict[str, str] = {}

#: Settings that hold for any cluster size; sizes of partitions and shuffles stay with the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs; on a cluster the session is given."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULTS, "spark.ui.enabled": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context: their Python workers need it for the Arrow functions."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tallyloom-")) / "tallyloom.zip"
    atexit.register(shutil.rmtree, at.parent, True)
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._tallyloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data directory; naming the columns keeps the scan narrow from the start."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:  # unset, as in tests: one folder for this process
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        at = _OWN["dir"]
    return at


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; all of this process's paths are deleted when it ends with its context alive."""
    root = f"{shared_dir(spark)}/tallyloom-{_PROCESS}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


def _forget(spark: SparkSession, root: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, root)
    except Exception:  # noqa: BLE001  the context is gone, and with it the way to the folder
        pass


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage like checkpoint() but computes the plan a single time, and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by cut() that no plan needs any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Vocabulary file of a public tokenizer; the folder is a parameter of the environment."""
    return os.path.join(os.environ.get("TALLYLOOM_TOKENIZERS", "/opt/tokenizers"), name)
