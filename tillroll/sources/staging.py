"""Tables written once into the shared folder and read back.

Several operators read an intermediate result more than once (for instance to
find score cut-offs and then to apply them). Writing it as Parquet cuts the
lineage, survives the loss of executors, and lets each later pass read only the
columns it needs. The tables of an application lie in one folder, which goes when its
driver ends.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    return spark.conf.get("spark.sql.warehouse.dir")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts the folder `fresh` in the place of `path`, whose old content goes last."""
    files, place = _file_system(spark, path)
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    there = files.exists(place)
    if there and not files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(old)):
        raise OSError(f"cannot move {path}")
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), place):
        if there:
            files.rename(spark._jvm.org.apache.hadoop.fs.Path(old), place)
        raise OSError(f"cannot put {fresh} in the place of {path}")
    if there:
        remove(spark, old)


def application_folder(spark: SparkSession) -> str:
    """Folder for the tables of this application; its file system removes it at the end."""
    path = f"{shared_folder(spark)}/tillroll/{spark.sparkContext.applicationId}"
    files, place = _file_system(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
