"""What the operators share: the reader of a table, the word pattern and tables written to the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: the blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in a local session without it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="graphweft-"))
    return _own_folder[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read again: a short lineage that lost executors don't break."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphweft/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more, before the next large shuffle."""
    for _ in range(2):  # the first collection lets go of what refers to a plan, the second one of the plan
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def words(text: Column) -> Column:
    """The words of a text, null as none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def once(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
