"""Session settings and lineage control."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "opsreliability", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster leave ``shuffle_partitions`` unset and size it there (about 128 MB of shuffle
    data per partition); adaptive execution coalesces what turns out to be small.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
         .config("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: Bytes of a generated method above which the JVM's JIT leaves it to the interpreter.
COMPILED_BYTES = 8000


def keep_compiled(spark: SparkSession) -> None:
    """Bring the method-size limit of ``build_session`` to a session that was made elsewhere.

    Spark's own limit lets the wide projections of the legs run as methods that are never compiled.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > COMPILED_BYTES:
        spark.conf.set(limit, str(COMPILED_BYTES))


def apart(df: DataFrame) -> DataFrame:
    """``df`` in methods of its own, apart from those of the projections on it.

    Spark compiles joins and the projections on them into one method.  Where that is above the limit the joins
    run row by row too; an observed count is a boundary that neither expressions nor generated code cross.
    """
    return df.observe("rows", F.count(F.lit(1)).alias("n"))


def _set_checkpoint_dir(spark: SparkSession) -> None:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="opsreliability-")
    spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  A private folder is
    made only for a local session (tests) that names none.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        _set_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path next to the checkpoints, for tables that one step writes and another reads."""
    if spark.sparkContext.getCheckpointDir() is None:
        _set_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a layer once as Parquet in the shared folder and scan it from there.

    Unlike a checkpoint the result is columnar, so every later use reads only its columns.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def spread(df: DataFrame, path: str, per_core: int = 16 << 20) -> DataFrame:
    """Spread a scan too small to fill the cores over all of them.

    A file with one row group is one task whatever its size.  Inputs above ``per_core`` bytes per
    core have enough splits and are left alone, so no large table is ever shuffled by this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if file_bytes(spark, path) < per_core * cores else df
