"""One ordered CSV file with a header for every run, written by tasks and published by a commit.

A run's rows meet in one task in their order (they are results: as many as a site has routes, zones or tracks). Tasks write into a staging
folder beside the files; only when all of them are done does the driver move the files into place, so a reader sees a run's old file
or its new one and never a part. A job that fails leaves nothing; a task that is run again writes to a folder of its own.
"""

import csv
import io
import itertools
import posixpath
import urllib.parse
import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

RUN = ("run_id", "camera_id")
_STAGING = "_staging"


def _files(path):
    """(file system, folder) of a path or URI that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def file_name(*run):
    """The name of a run's file; a null part is empty, other characters than letters and digits are escaped."""
    return "-".join("" if r is None else urllib.parse.quote(str(r), safe="").replace("-", "%2D") for r in run) + ".csv"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list


class RunFilesWriter(DataSourceWriter):
    def __init__(self, options, columns):
        self.path, self.header = options["path"], columns[len(RUN):]
        self.job = f"{_STAGING}/{uuid.uuid4().hex}"

    def write(self, rows):
        files, root = _files(self.path)
        folder, names = f"{self.job}/{uuid.uuid4().hex}", []
        files.create_dir(posixpath.join(root, folder), recursive=True)
        for run, group in itertools.groupby(rows, key=lambda r: tuple(r[:len(RUN)])):
            names.append(file_name(*run))
            with files.open_output_stream(posixpath.join(root, folder, names[-1])) as raw:
                text = io.TextIOWrapper(io.BufferedWriter(raw), encoding="utf-8", newline="")
                out = csv.writer(text, lineterminator="\n")
                out.writerow(self.header)
                out.writerows(["" if v is None else v for v in r[len(RUN):]] for r in group)
                text.flush()
                text.detach()
        return Written(folder, names)

    def commit(self, messages):
        files, root = _files(self.path)
        names = [n for m in messages if m for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a run's rows came from several tasks")
        for message in filter(None, messages):
            for name in message.names:
                files.move(posixpath.join(root, message.folder, name), posixpath.join(root, name))
        self._drop(files, root)

    def abort(self, messages):
        self._drop(*_files(self.path))

    def _drop(self, files, root):
        from pyarrow import fs

        staging = posixpath.join(root, self.job)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


class RunFiles(DataSource):
    @classmethod
    def name(cls):
        return "run_csv"

    def writer(self, schema, overwrite):
        return RunFilesWriter(self.options, schema.names)


def write_run_files(rows, path, order, run=RUN):
    """Write `rows` (run_id, camera_id, columns of the file in their order) as one file per run, its rows by the columns or expressions `order`.

    Files of runs that are written again are replaced, others stay. An empty table writes nothing. Nulls are empty fields.
    """
    spark = rows.sparkSession
    spark.dataSource.register(RunFiles)
    placed = rows.repartition(*run).sortWithinPartitions(*run, *order)
    placed.select(*run, *(F.col(f"`{c}`").cast("string") for c in rows.columns if c not in run)).write.format("run_csv").mode("append").save(path)


def read_run_files(spark, path, schema):
    """The files as one table with the run that a file's name tells, and no order."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{path}/*.csv").select("*", F.col("_metadata.file_name").alias("_file"))
    part = F.split(F.regexp_replace("_file", r"\.csv$", ""), "-")
    run, camera = (F.nullif(F.url_decode(F.url_decode(F.get(part, F.lit(i)))), F.lit("")) for i in (0, 1))
    return rows.select(run.alias("run_id"), camera.cast("bigint").alias("camera_id"), *[c for c in rows.columns if c != "_file"])
