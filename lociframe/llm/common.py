"""Table cuts and text column helpers of the operators here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.session import shared_path


def table_cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a lost executor recomputes nothing before it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete the folders of a table that table_cut made and nothing reads any more."""
    hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        folder = hadoop(path)
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def whole_text(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key() -> list[Column]:
    """What tells documents apart: the id, and a hash of the text where an id is repeated."""
    return [F.col("doc_id").alias("__id"), F.xxhash64(whole_text()).alias("__hash")]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
