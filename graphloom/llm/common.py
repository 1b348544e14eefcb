"""Session, storage and shipping helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch: bounds the memory of a Python worker, whatever the length of the texts.
BATCH_ROWS = 256
#: Bytes in one Arrow batch: it lies several times outside the heap, whose share of an executor is all but used up.
BATCH_BYTES = 2 << 20

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make the package importable on the executors and bound the Arrow batches."""
    app = spark.sparkContext.applicationId
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), "graphloom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_work(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it once results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Words of 64 bits in the candidate bitmap: 65,536 rows of 16 bytes, whatever the number of candidates.
BITMAP_WORDS = 65_536


def bitmap(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of hashed ids as a table of at most ``BITMAP_WORDS`` rows (word, bits): safe to broadcast at any size."""
    h = F.xxhash64(column)
    return (
        ids.select(F.pmod(h, F.lit(BITMAP_WORDS)).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({column}), 24), 64) as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def probe(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id may be in the bitmap: all that are, and few others."""
    word = F.pmod(F.xxhash64(df[column]), F.lit(BITMAP_WORDS)).cast("int")
    hit = F.expr(f"shiftright(bits, cast(pmod(shiftright(xxhash64({column}), 24), 64) as int)) & 1") == 1
    return df.withColumn("_word", word).join(F.broadcast(bits.withColumnRenamed("word", "_word")), "_word").where(hit).drop("_word", "bits")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is not in ``ids``. Rows that miss the bitmap are kept where they are; only those
    that may be in ``ids`` are shuffled and compared."""
    ids = materialize(ids.select(F.col(column).alias("_gone")).where("_gone is not null").distinct(), "gone")
    bits = materialize(bitmap(ids, "_gone"), "bits").withColumnRenamed("word", "_word").withColumnRenamed("bits", "_bits")
    word = F.pmod(F.xxhash64(F.col(column)), F.lit(BITMAP_WORDS)).cast("int")
    hit = F.coalesce(F.expr(f"shiftright(_bits, cast(pmod(shiftright(xxhash64({column}), 24), 64) as int)) & 1"), F.lit(0)) == 1
    marked = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").withColumn("_hit", hit)
    # an outer join: an anti-join would be moved under the probe, and shuffle all rows
    maybe = marked.where("_hit").join(ids, F.col(column) == F.col("_gone"), "left").where("_gone is null")
    return marked.where("not _hit").select(*df.columns).union(maybe.select(*df.columns))
