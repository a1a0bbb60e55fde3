"""What the operators of this subpackage share: the shared folder and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-process session (``local[...]``, as in tests) may go without the
    setting; it then gets a temporary folder. On a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        base = held.rsplit("/", 1)[0] if held else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cuetide-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below :func:`shared_dir`, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage at a point that survives the loss of any executor, and keeps
    an expensive result from being computed twice.
    """
    spark = df.sparkSession
    path = new_folder(spark, name) + "/t"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, n: int | None = None, *, dealt: bool = False) -> tuple[DataFrame, str]:
    """Like :func:`written`, as a table in ``n`` buckets of ``key``: later joins on it don't shuffle it again.

    Also the table's name; whoever needs it no more drops it from the catalog. ``dealt``: the rows are in ``n``
    partitions of ``key`` already.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(n, key)).write.option("compression", "zstd").option("path", path + "/t").bucketBy(n, key).format("parquet").saveAsTable(table)
    return spark.table(table), table


def map_rows(df: DataFrame, run) -> DataFrame:
    """``df`` through ``run`` over Arrow batches of the same columns, whose names may hold dots: inside they are numbered."""
    inner = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return inner.mapInArrow(run, inner.schema).toDF(*df.columns)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(names: list[str]) -> list[Column]:
    """Columns whose names may hold dots."""
    return [F.col(quoted(c)) for c in names]


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
