"""Tables written between steps, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of sessions on one machine, by application.
_own: dict[str, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent, a session on one machine has a temporary folder; on a
    cluster that is an error, since a folder of one machine is not seen by the others.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tremor-')}"
    return _own[context.applicationId]


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the stage folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` written in sorted buckets of ``key`` and read back, as ``materialized``.

    Groups and windows of the key, and joins on it with another table of as many buckets,
    need no exchange however often the table is read. ``buckets`` are the session's shuffle
    partitions if not given.
    """
    spark = df.sparkSession
    n, name = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{stage_folder(spark)}/step-{name}").saveAsTable(f"step_{name}")
    return spark.table(f"step_{name}")


def released(*frames: DataFrame | None) -> None:
    """Remove the tables behind frames of ``materialized`` and ``dealt`` that are needed no more; other frames are left alone."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        root = stage_folder(spark)
        bare = root.split(":", 1)[-1].rstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place, _, name = folder.rpartition("/")
            if name.startswith("step-") and place.split(":", 1)[-1].lstrip("/") == bare.lstrip("/"):
                spark.sql(f"DROP TABLE IF EXISTS `{name.replace('-', '_', 1)}`")
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
