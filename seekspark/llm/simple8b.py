"""Token files in Simple-8b words.

A file holds whole documents in ascending order. Ids are first replaced by
their rank in the file's own frequency table, so that frequent ids are small
numbers; ranks are coded in blocks of ``BLOCK``. A 64-bit word has a selector
in its four highest bits that says how many numbers of how many bits the other
60 hold; the encoder takes the most numbers that fit at each place. A number
of more than 60 bits is an escape: the word has 0 in its place, and position
and value stand after the words of the block. The block index has the offset
and counts of each block, so a block decodes on its own, all words of one
selector at a time.

File layout, little-endian: magic, sizes (``HEADER``), rank table (u8 bytes per
id), document ids (i8), null flags of these (u1), document lengths (u8), block
index (``INDEX``), then for each block its words (u8), escape positions (u4)
and escape values (u8).

Files are written by the tasks of a range-partitioned job into the shared
folder under a name of the attempt's own; the manifest, a table that Spark
commits, names the files of the attempts that count.

Cases: a null or empty text is its end id alone; a null doc_id sorts first and
comes back null; rows that repeat are written each, equal ids ordered by a key
of the text; an empty table gives no files and no rows; other columns are not
read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.evaluate import prefix_sums
from ..session import scratch_path
from . import tokens
from .common import small, text_key, written

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
BLOCK = 1 << 16
FILE_IDS = 1 << 22  # a file ends with the document that reaches so many ids
MAGIC = b"S8BT"
HEADER = struct.Struct("<4sIQII")  # magic, documents, ids, table entries, blocks
INDEX = np.dtype([("at", "<u8"), ("ids", "<u4"), ("words", "<u4"), ("escapes", "<u4")])
# Numbers in a word and bits of each, by selector from 1 (fixed values of Simple-8b).
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BITS = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def encode_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escape positions and escape values of up to ``BLOCK`` unsigned integers."""
    values = values.astype(np.uint64)
    if values.max(initial=0) < len(_BITS):
        bits = _BITS[values]
    else:
        bits = np.searchsorted(_POWERS, values, side="right").astype(np.uint8)
    escapes = np.flatnonzero(bits > 60)
    escaped = values[escapes]
    values[escapes], bits[escapes] = 0, 0
    n = len(values)
    padded = np.zeros(n + 60, np.uint8)
    padded[:n] = bits
    # Widest of the next k numbers, for the k of COUNTS in ascending order.
    take, mode = np.ones(n, np.uint8), np.full(n, len(COUNTS), np.uint8)
    widest, k = padded, 1
    for selector in range(len(COUNTS) - 1, 0, -1):
        count = int(COUNTS[selector - 1])
        while k < count:
            step = min(k, count - k)
            widest = np.maximum(widest[:len(widest) - step], widest[step:])
            k += step
        fits = widest[:n] <= WIDTHS[selector - 1]
        take[fits], mode[fits] = count, selector
    starts, at, jumps = [], 0, take.tobytes()
    while at < n:
        starts.append(at)
        at += jumps[at]
    starts = np.array(starts, np.int64)
    chosen = mode[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    room = np.zeros(n + 60, np.uint64)
    room[:n] = values
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        at, packed = starts[mine], words[mine]
        for j in range(COUNTS[selector - 1]):
            packed |= room[at + j] << np.uint64(j * WIDTHS[selector - 1])
        words[mine] = packed
    return words, escapes.astype("<u4"), escaped


def decode_block(words: np.ndarray, n: int, escapes: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector - 1]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + 60, np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        at, rest, width = starts[mine], words[mine], int(WIDTHS[s - 1])
        mask = np.uint64((1 << width) - 1)
        for j in range(COUNTS[s - 1]):
            out[at + j] = rest & mask
            rest >>= np.uint64(width)
    out = out[:n]
    out[escapes] = escaped
    return out


def file_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A whole file."""
    counts = np.bincount(ids)
    table = np.flatnonzero(counts)
    table = table[np.argsort(-counts[table], kind="stable")]
    rank = np.zeros(len(counts), np.uint64)
    rank[table] = np.arange(len(table), dtype=np.uint64)
    ranks = rank[ids]
    index, blocks, at = [], [], 0
    for first in range(0, len(ids), BLOCK):
        words, escapes, escaped = encode_block(ranks[first:first + BLOCK])
        image = words.astype("<u8").tobytes() + escapes.tobytes() + escaped.astype("<u8").tobytes()
        index.append((at, min(BLOCK, len(ids) - first), len(words), len(escapes)))
        blocks.append(image)
        at += len(image)
    nulls = np.array([d is None for d in doc_ids], "<u1")
    return b"".join([
        HEADER.pack(MAGIC, len(doc_ids), len(ids), len(table), len(index)), table.astype("<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.array(lengths, "<u8").tobytes(),
        np.array(index, INDEX).tobytes(), *blocks])


def read_file(stream) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Document ids, document lengths and, block by block, the ids of a file."""
    magic, n_docs, _, n_table, n_blocks = HEADER.unpack(stream.read(HEADER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")

    def numbers(kind, n):
        return np.frombuffer(stream.read(np.dtype(kind).itemsize * n), kind)
    table, doc_ids, nulls = numbers("<u8", n_table), numbers("<i8", n_docs), numbers("<u1", n_docs)
    lengths, index = numbers("<u8", n_docs), numbers(INDEX, n_blocks)

    def blocks():
        for b in index:
            words = numbers("<u8", int(b["words"]))
            escapes, escaped = numbers("<u4", int(b["escapes"])), numbers("<u8", int(b["escapes"]))
            yield table[decode_block(words, int(b["ids"]), escapes, escaped).astype(np.int64)]
    return [None if z else int(d) for d, z in zip(doc_ids, nulls)], lengths, blocks()


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """Write the documents in ascending order of id; the manifest
    ``(task, part, file, n_docs, n_ids, first)`` has a row for each file, ``first`` the ids of all files before it."""
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = tokens.pieces(path), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        part, doc_ids, lengths, held = 0, [], [], []

        def close():
            name = f"{task:06d}-{part:04d}-{uuid.uuid4().hex}.s8b"
            ids = np.frombuffer(b"".join(held), "<u4")
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(file_image(doc_ids, lengths, ids))
            return pa.RecordBatch.from_pydict({"task": [task], "part": [part], "file": [name], "n_docs": [len(doc_ids)],
                                               "n_ids": [len(ids)]})
        store.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), coder.all_ids(t.as_py() for t in batch.column(1))):
                ids += end
                doc_ids.append(d)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n += len(ids) // 4
                if n >= FILE_IDS:
                    yield close()
                    part, doc_ids, lengths, held, n = part + 1, [], [], [], 0
        if doc_ids:
            yield close()
    ordered = (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), text_key(F.col(text)).alias("key"))
               .repartitionByRange("id", "key").sortWithinPartitions("id", "key").select("id", "text"))
    files = written(ordered.mapInArrow(write, "task long, part long, file string, n_docs long, n_ids long"), "manifest")
    # ids of all tasks before, from a row for each task, and of the files before in the task
    tasks = prefix_sums(files.groupBy("task").agg(F.sum("n_ids").alias("n")), "task", ["n"])
    earlier = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = files.withColumn("own", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    before = small(written(tasks.select("task", (F.col("cum_n") - F.col("n")).alias("before")), "token-tasks"))
    return written(own.join(before, "task").select(*files.columns, (F.col("before") + F.col("own")).alias("first")), "manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document, decoded from the files; ``ids`` are
    little-endian unsigned 32-bit integers."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{root}/{row['file']}") as f:
                    doc_ids, lengths, blocks = read_file(f)
                    ends = np.cumsum(lengths.astype(np.int64))
                    at, done, rest = 0, 0, b""
                    for block in blocks:
                        rest += block.astype("<u4").tobytes()
                        to = int(np.searchsorted(ends, done + len(rest) // 4, side="right"))
                        cuts = [0, *((ends[at:to] - done) * 4).tolist()]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids[at:to], pa.int64()), pa.array(row["first"] + done + np.array(cuts[:-1], np.int64) // 4),
                            pa.array([rest[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                            names=["doc_id", "start", "ids"])
                        at, done, rest = to, done + cuts[-1] // 4, rest[cuts[-1]:]
    # a number of its own for the partitions: Spark would put the few small rows of the manifest into one
    rows = manifest.select("file", "first", "task", "part")
    readers = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(readers, "task", "part").mapInArrow(read, "doc_id long, start long, ids binary")


def token_folder(spark) -> str:
    return scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
