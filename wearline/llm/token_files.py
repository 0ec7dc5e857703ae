"""Token ids as flat binary files with 64-bit document offsets that can be memory-mapped.

A data set is a folder of shards, in ascending document order:

* ``<shard>.bin``: unsigned little-endian ids, 16 bits if the vocabulary allows it, else 32;
* ``<shard>.idx``: unsigned 64-bit offsets in ids since the start of the data set, one more than the shard has documents;
* ``<shard>.doc``: signed 64-bit document ids (the smallest number stands for NULL);
* ``manifest.json``: width of an id and, per shard, documents, ids and both bases.

Tasks range-partition the documents by id, write their ids and report how many they wrote. The bases are prefix sums over
those reports (one row per shard), after which a second job writes the offsets. Files appear under their name only when
they are complete, so a task that runs again replaces nothing half-written. Folders may be anywhere the Arrow file systems reach.

Defined results: NULL text counts as empty, so the document holds just the end id; NULL ids come first; rows that repeat an id stay
separate documents, ordered by text; an empty table makes a data set without shards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.byte_tokens import default_path, encoder
from wearline.llm.common import arrow_map, whole_text

END_ID = 2
NULL_ID = np.iinfo(np.int64).min


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _mapped(files: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The numbers of a file; memory-mapped where the file system is a mounted one."""
    if isinstance(files, fs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(path).read_buffer() if files.get_file_info(path).size else b"", dtype=dtype)
    return np.frombuffer(files.open_input_file(path).read_buffer(), dtype=dtype)


#: Letters of a text that divide the rows of one id between tasks.
RANGE_LETTERS = 64


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Writes the data set and returns its manifest's shards."""
    path = path or default_path()
    width = 2 if max(end_id, len(encoder(path).lengths) - 1) < 1 << 16 else 4
    end = np.uint32(end_id).astype("<u4").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        context = TaskContext.get()
        name, tag = f"{root}/{context.partitionId():06d}", f".{context.taskAttemptId()}.draft"
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        total = 0
        out = None
        for batch in batches:
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(name + ".bin" + tag)
            counts = []
            for packed in encoder(path).encode(batch.column(1).to_pylist()):
                packed += end
                counts.append(len(packed) // 4)
                out.write(packed if width == 4 else np.frombuffer(packed, "<u4").astype("<u2").tobytes())
            lengths.append(np.array(counts, dtype=np.uint64))
            ids.append(batch.column(0).fill_null(int(NULL_ID)).to_numpy())
            total += sum(counts)
        if out is None:
            return
        out.close()
        for kind, numbers in ((".doc", np.concatenate(ids).astype("<i8")), (".len", np.concatenate(lengths).astype("<u8"))):
            with files.open_output_stream(name + kind + tag) as stream:
                stream.write(numbers.tobytes())
        for kind in (".bin", ".doc", ".len"):
            files.move(name + kind + tag, name + kind)
        yield pa.RecordBatch.from_pydict({"shard": [f"{context.partitionId():06d}"], "docs": [sum(len(x) for x in lengths)], "tokens": [int(total)]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    # rows that share an id, or have none, are divided by the first letters of their texts, which keeps the order
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, RANGE_LETTERS)).sortWithinPartitions("doc_id", "text")
    reports = sorted(arrow_map(ordered, shard, "shard string, docs long, tokens long").collect())  # one row per shard
    shards, doc_base, token_base = [], 0, 0
    for r in reports:
        shards.append({"shard": r["shard"], "docs": r["docs"], "tokens": r["tokens"], "doc_base": doc_base, "token_base": token_base})
        doc_base, token_base = doc_base + r["docs"], token_base + r["tokens"]

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lengths = _mapped(files, f"{root}/{name}.len", "<u8")
                draft = f"{root}/{name}.idx.{TaskContext.get().taskAttemptId()}.draft"
                with files.open_output_stream(draft) as stream:
                    stream.write(np.concatenate([[np.uint64(base)], np.cumsum(lengths, dtype=np.uint64) + np.uint64(base)]).astype("<u8").tobytes())
                files.move(draft, f"{root}/{name}.idx")
            yield batch

    spark = docs.sparkSession
    _shard_rows(spark, shards).select("shard", "token_base").mapInArrow(offsets, "shard string, token_base long").write.format("noop").mode("overwrite").save()
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as stream:
        stream.write(json.dumps({"id_bytes": width, "shards": shards}).encode())
    return shards


def _shard_rows(spark: SparkSession, shards: list[dict]) -> DataFrame:
    schema = "shard string, docs long, tokens long, doc_base long, token_base long"
    rows = spark.createDataFrame([tuple(s.values()) for s in shards], schema)
    return rows.repartition(max(1, len(shards)))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    files, root = _open(folder)
    with files.open_input_file(f"{root}/manifest.json") as stream:
        manifest = json.loads(stream.read())
    width = manifest["id_bytes"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                ids, starts, docs = _mapped(files, f"{root}/{name}.bin", f"<u{width}"), _mapped(files, f"{root}/{name}.idx", "<u8").astype(np.int64), _mapped(files, f"{root}/{name}.doc", "<i8")
                lengths = np.diff(starts)
                step = 256
                for i in range(0, len(docs), step):
                    some = range(i, min(i + step, len(docs)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs[some.start : some.stop], mask=docs[some.start : some.stop] == NULL_ID), pa.array(starts[some.start : some.stop]), pa.array(lengths[some.start : some.stop]),
                        pa.array([ids[starts[j] - starts[0] : starts[j + 1] - starts[0]].astype("<u4").tobytes() for j in some], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])

    return arrow_map(_shard_rows(spark, manifest["shards"]).select("shard"), documents, "doc_id long, start long, n_tokens long, ids binary")
