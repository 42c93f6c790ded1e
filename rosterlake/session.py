"""Session helpers: checkpoint folder and settings the operators rely on."""

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, which all executors share.

    It is named in ``spark.checkpoint.dir``.  Where that is unset the session's
    warehouse takes them, unless it is a folder of one machine while executors
    run on others.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    return configured or fallback_dir(spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)


def fallback_dir(warehouse: str, master: str) -> str:
    """Folder below the warehouse; raises where executors could not see it."""
    one_machine = ":" not in warehouse or warehouse.startswith("file:")
    if one_machine and not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share; the warehouse {warehouse} is on one machine")
    return warehouse.rstrip("/") + "/_intermediate"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def expire(spark: SparkSession, path: str):
    """Has an intermediate folder deleted when the session's JVM ends; nothing can read it after that."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialise(df: DataFrame, label="stage", partition_by=None) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back.

    Cuts lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    expire(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores="8", name="rosterlake", **conf) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", cores)))
               .config("spark.sql.adaptive.enabled", "true")
               # texts are CPU-bound: small splits keep all cores busy
               .config("spark.sql.files.maxPartitionBytes", conf.pop("split_bytes", "4m"))
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.driver.memory", conf.pop("driver_memory", "8g")))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
