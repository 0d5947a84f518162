"""Session settings and presets."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Least and most tokens of a chunk, by preset; an unknown name means the first.
PRESETS = {"standard": (800, 2000), "large": (1200, 3500), "xlarge": (2000, 5000)}


def session(name: str = "folio", **conf: str) -> SparkSession:
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def preset(name: str) -> tuple[int, int]:
    return PRESETS.get(name, PRESETS["standard"])


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder stands for it only where all runs in one JVM."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    folder, context = shared(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder has been written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
