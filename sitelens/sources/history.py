"""The history of runs as a table of files: one folder for each root and run, ten runs kept of each root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def origin(root: Column) -> Column:
    """Scheme, host and port of an address in lower case; anything else as it is."""
    found = F.lower(F.regexp_extract(root, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))
    return F.when(found == "", root).otherwise(found)


def root_key(root: Column) -> Column:
    """The folder of a root: 32 digits of the hash of its origin."""
    return F.substring(F.sha2(origin(root), 256), 1, 32)


def read_history(spark: SparkSession, path: str, schema: StructType, most: int = 10) -> DataFrame:
    """Rows of ``schema`` (root, run_no, ...) of the newest ``most`` runs of each root, whether or not older ones are gone yet.

    The hash only names a folder; roots are told apart by what the rows say. Without any history there are no rows.
    """
    fields = StructType([f for f in schema.fields if f.name != "run_no"]).add("root_key", "string").add("run_no", "long")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(fields).parquet(path)
    newest = F.dense_rank().over(Window.partitionBy("root").orderBy(F.desc("run_no")))
    heads = rows.select("root", "run_no").distinct().withColumn("_r", newest).filter(F.col("_r") <= most).drop("_r")
    return rows.join(heads, ["root", "run_no"], "left_semi").select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_history(run: DataFrame, path: str, most: int = 10) -> None:
    """Adds the rows of runs (root, run_no, ...) to the history at ``path`` and takes away what is older than the newest ``most``.

    Each run of a root is a folder, and only the folders that ``run`` has rows for are replaced: writing the same run again,
    after a stop or not, gives the same table, and other roots and runs aren't touched. Folders past ``most`` go after the
    write, one by one as they are listed, so none is held in memory; a stop before that leaves what readers don't see.
    """
    spark = run.sparkSession
    keyed = run.withColumns({"root_key": root_key(F.col("root")), "run_no": F.col("run_no").cast("long")})
    keyed.repartition("root_key", "run_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root_key", "run_no").parquet(path)
    rows = spark.read.schema(StructType([f for f in keyed.schema.fields if f.name not in ("root_key", "run_no")]).add("root_key", "string").add("run_no", "long")).parquet(path)
    own = run.select(root_key(F.col("root")).alias("root_key")).distinct()
    # Ranked by folder: two roots of one folder, should that ever be, keep more rather than fewer.
    heads = rows.join(own, "root_key", "left_semi").select("root_key", "root", "run_no").distinct()
    ranked = heads.withColumn("r", F.dense_rank().over(Window.partitionBy("root").orderBy(F.desc("run_no"))))
    old = ranked.groupBy("root_key", "run_no").agg(F.min("r").alias("r")).filter(F.col("r") > most)
    name = spark._jvm.org.apache.hadoop.fs.Path
    files = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in old.toLocalIterator():
        files.delete(name(f"{path}/root_key={row.root_key}/run_no={row.run_no}"), True)
