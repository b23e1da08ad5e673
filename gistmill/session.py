"""Session settings and the few helpers that depend on them."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, memory: str = "16g", app: str = "gistmill") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter configures it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; in local mode without one, a folder in the warehouse."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A name in the shared checkpoint folder that nothing has used."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a Parquet table in the shared checkpoint folder.

    Unlike cached blocks it outlives executors, later reads see only the columns
    they need, and its size is known to the optimizer.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core on an input of few files; an input of many is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *keys)


def compute_once(df: DataFrame, **columns) -> DataFrame:
    """Add expensive columns that later filters and projections read as plain values.

    A filter on a projected column is pushed below the projection, which computes
    the column twice. A generator of one row is a boundary the optimizer keeps.
    """
    fields = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(fields)))
