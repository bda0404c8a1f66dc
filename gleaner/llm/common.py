"""What the corpus operators share: table access, the shared scratch folder and Arrow helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, local runs).
LOCAL_SHARED = "file:///tmp/checkpoints/gleaner"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see, as a URI: ``spark.checkpoint.dir``. A cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL_SHARED
    return found if ":" in found.split("/")[0] else f"file://{found}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a scratch folder that nothing will read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder (or below ``folder``) and reads it back, so
    that a lost executor costs a read and never the work above."""
    path = f"{folder}/{label}-{uuid.uuid4().hex}" if folder else scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``per_key``: one row a key, with ``n``, the rows it has in ``rows`` of all
    ``total``. Keys with more than a ``share``-th of all rows, fewer than ``share`` of them, are broadcast, so no
    key's rows meet in one task; the others join by shuffle. Rows whose key is not there go."""
    hot = per_key.where(F.col("n") * share > total).drop("n")
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    cold = marked.where("__hot IS NULL").select(*rows.columns).join(per_key.where(F.col("n") * share <= total).drop("n"), key)
    return marked.where("__hot").drop("__hot").unionByName(cold)


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What a document is known by: the hash of its id and text."""
    return F.xxhash64(docs[id_col], docs[text_col])


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each component one row of ``docs``, whole: that of the least id, nulls last, ties by hash. ``found``: key
    (``row_key``), id and root of each row, so neither a shared nor a missing id keeps or drops a row by itself. Of
    rows with one id and text one counts; it is chosen before the shuffle."""
    kept = materialize(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select(F.col("first.key").alias("__key")), "kept")
    once = Window.partitionBy("__key").orderBy(F.xxhash64(*[docs[c] for c in docs.columns]))
    rows = docs.withColumn("__key", row_key(docs, id_col, text_col)).withColumn("__nth", F.row_number().over(once)).where("__nth = 1")
    return rows.join(kept, "__key", "left_semi").select(*docs.columns)


_held: dict = {}


def sole(key, build):
    """The model that this worker holds, made by ``build`` unless it is that of ``key`` already. A worker that runs one stage
    after another holds one model, not one a stage: the earlier one is dropped first."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text"):
    """The column's strings as UTF-8 bytes, null as None, one at a time."""
    for x in column(batch, name).cast(pa.large_binary()):
        yield x.as_py()
