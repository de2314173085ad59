"""Totals of a stream, kept by `foreachBatch` so that a batch delivered again changes nothing.

Every batch is summed and written to a folder of its own, and then entered into a ledger. A batch that the ledger holds is left
alone; one that was written without being entered (the driver died in between) is written anew. Readers follow the ledger, so they
never see half a batch. `compact` folds all entered batches into one snapshot, so the number of folders that a reader opens stays small.
"""

from pyspark.sql import functions as F


class Totals:
    """Sums of `values` by `keys`, under `path`, a folder that all executors share."""

    def __init__(self, spark, path, keys, values=("cnt",)):
        self.spark, self.path, self.keys, self.values = spark, path.rstrip("/"), list(keys), list(values)

    def _folders(self, kind):
        """Numbers of the finished folders of a kind."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return set()
        return {int(s.getPath().getName()) for s in files.listStatus(root)
                if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))}

    def _summed(self, rows):
        return rows.groupBy(*self.keys).agg(*(F.sum(v).cast("bigint").alias(v) for v in self.values))

    def write(self, batch, batch_id):
        """Add a batch (keys and values) once; True if it was new."""
        if batch_id in self._folders("ledger") or batch_id <= max(self._folders("snapshots"), default=-1):
            return False
        self._summed(batch).write.mode("overwrite").parquet(f"{self.path}/batches/{batch_id}")
        self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id")).write.mode("overwrite").parquet(f"{self.path}/ledger/{batch_id}")
        return True

    def read(self, like=None):
        """The totals of all entered batches; `like` gives the schema while there are none."""
        upto = max(self._folders("snapshots"), default=-1)
        folders = [f"{self.path}/batches/{n}" for n in sorted(self._folders("ledger")) if n > upto]
        folders += [f"{self.path}/snapshots/{upto}"] * (upto >= 0)
        return self._summed(self.spark.read.parquet(*folders) if folders else like.limit(0))

    def compact(self):
        """Fold what is entered into a snapshot; its number is that of the last batch in it."""
        entered = self._folders("ledger")
        if entered and max(entered) > max(self._folders("snapshots"), default=-1):
            self.read().write.mode("overwrite").parquet(f"{self.path}/snapshots/{max(entered)}")
