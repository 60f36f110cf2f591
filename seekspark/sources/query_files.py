"""SNK-4: question files, one text file for each input file.

A Spark sink (``format("question_files")``): every task streams the blocks of the files it was given into
files named by the attempt, and the commit step of the job gives them their names. A task that is tried again or
runs twice leaves nothing readable, a job that fails removes what it wrote, and a replay replaces the files.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "question_files"
SUFFIX = ".txt"


@dataclass
class Written(WriterCommitMessage):
    files: list            # (name, path of the attempt)


class QuestionFileWriter(DataSourceWriter):
    """Rows ``(file, value)``, all rows of a file in one task and next to each other."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.attempts = f"_attempts/{uuid.uuid4().hex}"      # of this job

    def write(self, rows) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        attempt, files, now, out = uuid.uuid4().hex, [], None, None
        store.create_dir(f"{root}/{self.attempts}", recursive=True)
        try:
            for row in rows:
                if row[0] != now:
                    if out:
                        out.close()
                    now, at = row[0], f"{root}/{self.attempts}/{attempt}-{len(files)}"
                    out = store.open_output_stream(at)
                    files.append((now, at))
                out.write(f"{row[1]}\n".encode())
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name, at in message.files if message else []:
                target = f"{root}/{name}{SUFFIX}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                store.move(at, target)
        self._clear(store, root)

    def abort(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        self._clear(store, root)

    def _clear(self, store, root: str) -> None:
        if store.get_file_info(f"{root}/{self.attempts}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.attempts}")


class QuestionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file STRING, value STRING"

    def writer(self, schema, overwrite: bool) -> QuestionFileWriter:
        return QuestionFileWriter(self.options["path"])


def write_question_files(questions: DataFrame, path: str) -> None:
    """``(file, url, queries)`` rows, ``queries`` an array of texts, to ``<path>/<file>.txt`` as blocks
    ``##`` / url / ``#`` / numbered questions, in url order. ``path`` is a uri or an absolute path.

    One task writes a file, block by block, so its memory is that of one block however long the file."""
    spark: SparkSession = questions.sparkSession
    spark.dataSource.register(QuestionFiles)
    numbered = F.transform("queries", lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), F.replace(q, F.lit("\n"), F.lit(" "))))
    block = F.concat_ws("\n", F.lit("##"), F.col("url"), F.lit("#"), F.array_join(numbered, "\n"))
    blocks = questions.select(F.col("file").cast("string").alias("file"), "url", block.alias("value"))
    blocks.repartition("file").sortWithinPartitions("file", "url", "value").select("file", "value") \
        .write.format(FORMAT).mode("append").option("path", path).save()
