"""Where intermediate tables live, and small helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders that this process made with `scratch`, by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    Only where the setting is absent on a single machine, as in tests, a temporary
    folder is made and used instead; on a cluster its absence is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; `release` deletes it."""
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and what a job has decided from data stays decided.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table that `stored` wrote for `df`, once nothing will read it again.

    Only what has itself been written since may follow from it.
    """
    spark = df.sparkSession
    made = _made.get(spark.sparkContext.applicationId, [])
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for own in [p for p in made if path.endswith(p.rpartition("/")[2])]:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            made.remove(own)


def keep_ids(docs: DataFrame, stay: DataFrame, id_col: str) -> DataFrame:
    """Rows of `docs` whose id is in `stay` (id), and rows without an id, whatever their columns are called."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    known = stay.select(F.col("id").alias("kept"))
    return rows.join(known.hint("merge"), F.col("id") == F.col("kept"), "left").filter("kept is not null or id is null").select("row.*")


def release(spark: SparkSession) -> None:
    """Delete every scratch folder of this application."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions, for operators that number their partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, most: int = 1 << 21):
    """Arrow batches in runs of rows of about `most` bytes, so that what a task makes of a run does not grow with Spark's batches."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def one_thread() -> None:
    """Spark owns the parallelism; the libraries inside a task use one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
