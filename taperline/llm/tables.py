"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Most bytes of texts in such a table.
BROADCAST_BYTES = 64 << 20


def slices(batches, rows: int = 256):
    """The Arrow batches in pieces of a few rows, so that a task holds few texts at a time in any other form."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; one of our own only where it is unset and all runs in one process (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="taperline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstored(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``. Only for tables that no later job reads: a lost executor's tasks read them again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``rest``, a struct of all other columns, so that none of their names can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias("rest")] if rest else []))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` that ``packed`` was given, in their order."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns))


def numbered(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """``docs`` with a long that names each row: doc_id where ids are whole numbers, none is null and none repeats, else its place in
    the order in which a stored copy was read."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids and dict(docs.dtypes)["doc_id"] in ("bigint", "int"):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
