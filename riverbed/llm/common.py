"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="riverbed-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Spark removes the shuffle files of a statement at its end where this is set.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends here.

    The shuffle files behind it are of no more use and go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riverbed-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(*tables: DataFrame) -> None:
    """Remove the files of tables written by ``cut`` once nothing reads them again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/riverbed-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text column as a string; null is the empty text."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for an expression that uses it several times."""
    return F.transform(F.array(value), body)[0]
