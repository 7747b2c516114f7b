"""Helpers that the operators share: table access, scratch tables, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import on_workers

#: The characters between words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


#: Keys of dropped documents that are broadcast, about 50 bytes each in memory.
BROADCAST_GONE = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir`` of the session.

    Where that setting is missing a local session takes a folder of this
    machine; on a cluster, where executors would not see it, it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veclake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there.

    A lost executor costs the reader nothing, as the files are not its own.
    The folder belongs to one application and may be removed when that ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veclake_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._veclake_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    on_workers(df.sparkSession)
    return df.mapInArrow(run, schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) whose doc_id is a pair with a hash of id and text: null and repeated ids tell apart."""
    key = F.struct(docs["doc_id"].alias("a"), F.xxhash64(docs["doc_id"].cast("string"), docs["text"]).alias("b"))
    return docs.select(key.alias("doc_id"), docs["text"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose ``keyed`` doc_id is not in ``gone``, all their columns as they were.

    Up to BROADCAST_GONE keys are broadcast, so that no document moves; more
    are joined by a shuffle.
    """
    g = written(gone.select(F.col("doc_id.a").alias("_gone"), F.col("doc_id.b").alias("_key")), "gone")
    few = g.count() <= BROADCAST_GONE
    same = docs["doc_id"].eqNullSafe(g["_gone"]) & (F.xxhash64(docs["doc_id"].cast("string"), docs["text"]) == g["_key"])
    return docs.join(F.broadcast(g) if few else g, same, "left_anti")
