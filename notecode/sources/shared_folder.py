"""A folder every executor can reach, for tables that are written and read again."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def session_folder(spark: SparkSession) -> str:
    """The folder of this application below `spark.checkpoint.dir`.

    Without that setting it lies below the checkpoint folder of the context, else the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/notecode-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The table written to a new path and read from there, so that it is computed only once.

    `options` go to the Parquet writer, such as a `compression` that takes less room for long texts.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` has returned and that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table._stored_at)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that this application has stored."""
    _delete(spark, session_folder(spark))
