"""Shared pieces of the training-data operators: tables, words, and written intermediate results."""

from __future__ import annotations

import gc
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset and Spark runs in one
    process, as in tests, a local folder is set; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='outrider-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    ``few`` says that its rows are few beside those they come from: they are dealt anew, so that they fill few files.

    This cuts lineage: a lost executor costs no recomputation of what came before, and values
    such as row tags stay what they were. The files go when the session's JVM ends; the shuffle files
    of what came before go as soon as the driver collects its garbage, which this asks for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if few else df).write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    gc.collect()
    jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Rows that go to Python at once, at most, as texts can be long.
ROWS_AT_ONCE = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ROWS_AT_ONCE, which bounds what Python and the JVM hold of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ROWS_AT_ONCE:
        spark.conf.set(name, ROWS_AT_ONCE)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/").removeprefix("file:").lstrip("/")
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def split_join(many: DataFrame, one: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, an aggregate by ``on``, so that adaptive execution can split a key that ``many`` has often.

    An aggregate's rows lie by its key already, and a join that takes them as they lie is never split. A hash of the
    key as one more key has both sides dealt anew.
    """
    dealt = F.xxhash64(on)
    return many.withColumn("_dealt", dealt).join(one.withColumn("_dealt", dealt), [on, "_dealt"], how).drop("_dealt")


def one_of_each(docs: DataFrame, chosen: DataFrame, on: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """One row of ``docs`` for each row of ``chosen``, by columns that agree (nulls too).

    ``chosen`` has a column ``_key_rows``, the number of rows of ``docs`` that agree. Where that is
    one, a semi-join is all it takes; rows that are there several times go through an aggregate,
    which combines them before the shuffle.
    """
    chosen = written(chosen, "chosen")
    match = lambda some: docs.join(some, [docs[a].eqNullSafe(some[b]) for a, b in on], "left_semi")
    single = match(chosen.filter("_key_rows = 1")).select(*columns)
    if not chosen.filter("_key_rows > 1").head(1):
        return single
    several = match(chosen.filter("_key_rows > 1"))
    first = several.groupBy(*[a for a, _ in on]).agg(F.first(F.struct(*columns)).alias("_row")).select("_row.*")
    return single.unionByName(first)
