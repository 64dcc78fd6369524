"""Markdown files as a table: (folder_idx, path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(spark: SparkSession, folders: list[str], pattern: str = "*.md") -> DataFrame:
    """All files below the folders whose name fits the pattern, whole. A path begins with its folder as given, so relative
    folders give ids that hold on every machine. There is no order in the rows: (folder_idx, path) is one."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), None
    for k, folder in enumerate(folders):
        base = folder.rstrip("/") or "/"
        place = jvm.org.apache.hadoop.fs.Path(base)
        root = place.getFileSystem(conf).makeQualified(place).toUri().getPath().rstrip("/")
        rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
        path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:(//[^/]*)?", "")
        rows = rows.select(F.lit(k).alias("folder_idx"), F.concat(F.lit(base.rstrip("/")), F.substr(path, F.lit(len(root) + 1))).alias("path"), F.col("value").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "folder_idx int, path string, text string") if out is None else out
