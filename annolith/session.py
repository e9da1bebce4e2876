"""Session settings for local runs; clusters bring their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a counted table up to which it is broadcast.
BROADCAST_BYTES = 48 << 20


def local_session(cores: int | str = 8, memory: str = "8g", **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("annolith")
        .config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    import tempfile

    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="annolith-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Tables written by staged() in this process, in order.
STAGED: list[str] = []


def drop_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes staged tables that nothing reads any more: those named, or all."""
    for path in list(STAGED if paths is None else paths):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        STAGED.remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: what is sampled or drawn for it is drawn once, and lost executors lose nothing."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
