"""Session helpers: sensible defaults and the shared folder for cut lineage."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores="*", partitions=8, name="flowlattice", **conf):
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The cluster's shared folder. Only a local session without one (a test) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not existing.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = existing.get() if existing.isDefined() else tempfile.mkdtemp(prefix="flowlattice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df):
    """Write `df` to the shared folder and go on from the copy, so lost executors cost no rerun."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def materialized(df, name="table", row_group=None):
    """Write `df` as a table in the shared folder and return a scan of it.

    For rows that several results read: they are computed once, and each reader scans only its
    columns. Readers decode a row group at once, so tables of long rows are given its size in bytes.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    if row_group:
        # By default sizes are looked at after a hundred rows, however long these are.
        writer = writer.options(**{"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1})
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
