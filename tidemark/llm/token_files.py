"""Token ids in binary files: every document compressed on its own with one shared zstandard dictionary.

A file is ``MAGIC``, the sha256 of the dictionary, the frames one after another, and an index: per
document its id (with a flag for NULL), where its frame begins, and how many ids it holds. So one short
document is read with the index and its own frame. Ids are little-endian unsigned 32-bit numbers before
compression. Files are named by their place in the order of ids, documents lie in ascending order of
their ids, NULL first.

The dictionary is trained on the serialized ids of at most ``SAMPLE`` documents of at most
``SAMPLE_CHARS`` characters, those with the smallest hashes of their ids; it only affects the size of
the files. Where training is not possible (too few documents) it is empty.

A file is written under a temporary name and then renamed, so a task that runs again leaves one file.

Defined results: a NULL text is empty and holds the end id only; repeated rows are written each; an empty
table gives no file and an empty result; a very long text is one frame; columns that are not named stay unread.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.llm.tokens import encoder, public_path
from tidemark.operators.ranks import running_sums
from tidemark.session import scratch_folder, settle
from tidemark.sources.files import locate

MAGIC = b"IDFILE01"
SAMPLE, SAMPLE_CHARS = 400, 20_000
DICTIONARY_BYTES = 64 << 10
#: Compressed bytes after which a partition begins another file.
FILE_BYTES = 16 << 20
LEVEL = 3
_ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("at", "<u8"), ("ids", "<u8")])


def train_dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class Writer:
    """One file in memory; ``finish`` gives its bytes."""

    def __init__(self, dictionary: bytes) -> None:
        self.hash = hashlib.sha256(dictionary).digest()
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        self.clear()

    def clear(self) -> None:
        self.frames, self.entries, self.size = [], [], len(MAGIC) + 32

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.compressor.compress(ids.astype("<u4").tobytes())
        self.entries.append((doc_id or 0, doc_id is None, self.size, len(ids)))
        self.frames.append(frame)
        self.size += len(frame)

    def finish(self) -> bytes:
        index = np.array(self.entries, _ENTRY).tobytes()
        return b"".join([MAGIC, self.hash, *self.frames, index, len(self.entries).to_bytes(8, "little"), MAGIC])


class Reader:
    """Random access to the documents of a file's bytes."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a whole file of ids")
        if data[len(MAGIC) : len(MAGIC) + 32] != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        n = int.from_bytes(data[-len(MAGIC) - 8 : -len(MAGIC)], "little")
        self.end = len(data) - len(MAGIC) - 8 - n * _ENTRY.itemsize
        self.index = np.frombuffer(data, _ENTRY, n, self.end)
        self.data, self.decompressor = data, zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> np.ndarray:
        begin = int(self.index["at"][i])
        end = int(self.index["at"][i + 1]) if i + 1 < len(self.index) else self.end
        return np.frombuffer(self.decompressor.decompress(self.data[begin:end]), "<u4")

    def find(self, doc_id: int) -> int | None:
        """The first document with this id, by binary search."""
        nulls = int(self.index["null"].sum())
        i = nulls + int(np.searchsorted(self.index["id"][nulls:], doc_id))
        return i if i < len(self.index) and self.index["id"][i] == doc_id and i >= nulls else None


def _put(folder: str, name: str, data: bytes) -> None:
    where, path = locate(folder)
    where.create_dir(path, recursive=True)
    draft = f"{path}/_{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        out.write(data)
    where.move(draft, f"{path}/{name}")


def write(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> bytes:
    """Write all documents below ``folder``; returns the dictionary, which lies there too."""
    spark, tokenizer = docs.sparkSession, tokenizer or public_path()
    rows = docs.select(F.col(id_column).cast("long").alias("id"), whole(text).alias("text"))
    # Hashes are compared first, so that tasks send texts of the chosen documents only.
    fit, mark = F.length("text").between(1, SAMPLE_CHARS), F.xxhash64("id")
    bound = rows.where(fit).select(mark.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    some = rows.where(fit & (mark <= F.lit(bound))).select("text").limit(SAMPLE).collect() if bound is not None else []
    dictionary = train_dictionary([ids.tobytes() for ids in encoder(tokenizer).documents(pa.array([r[0] for r in some], pa.string()))])
    _put(folder, "_dictionary", dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, writer, made = TaskContext.get().partitionId(), encoder(tokenizer), Writer(dictionary), []

        def flush() -> None:
            name = f"{part:08d}-{len(made):06d}.ids"
            _put(folder, name, writer.finish())
            made.append((name, len(writer.entries), sum(e[3] for e in writer.entries)))
            writer.clear()

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.documents(batch.column(1))):
                writer.add(doc_id, ids)
                if writer.size >= FILE_BYTES:
                    flush()
        if writer.entries:
            flush()
        if made:
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "documents", "ids"])

    # The bounds are drawn from a sample of ids and hashes that reaches the driver, so no text is part of them.
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    settle(ordered.mapInArrow(run, "file string, documents bigint, ids bigint"), "files")
    return dictionary


def read(spark: SparkSession, folder: str, dictionary: bytes) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = Reader(content.as_py(), dictionary)
                n = file.index["ids"].astype(np.int64)
                crc = [zlib.crc32(file.ids(i).tobytes()) for i in range(len(file))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.rsplit("/", 1)[-1]] * len(file)), pa.array(file.index["id"], mask=file.index["null"].astype(bool)),
                        pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()),
                    ],
                    ["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    rows = settle(files.mapInArrow(run, "file string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"), "read-back")
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("all", F.lit(0))
    before = running_sums(per_file, ["all"], [F.col("file")], ["n"]).select(F.col("file").alias("_file"), F.col("below_n").alias("before"))
    return rows.join(before, F.col("file") == F.col("_file")).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared scratch space and read the files back."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "tokens")
    return read(spark, folder, write(docs, folder, **options))
