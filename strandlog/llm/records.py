"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A record frames one document's ids:

    u64 length of the payload, u32 masked checksum of those 8 bytes, payload, u32 masked checksum of the payload

all little-endian. The payload is the document id (i64) and the token ids (u16 where the vocabulary allows, else
u32). A checksum is CRC-32, rotated right by 15 bits plus 0xA282EAD8, so that files of checksums don't check
themselves. Beside each `part-N.rec` stands `part-N.idx`: u64 offsets of its records and the file's end, so that
a reader can fetch records in any order.

Files hold documents in ascending id order: rows are range-partitioned by id and sorted, then each task writes its
own files, under a temporary name that is renamed when complete. A task that runs again writes the same bytes.

Defined cases: a null text has the end id alone; rows of one id stand in order of their texts' hashes; an empty
table gives no files and an empty result; a null id is written as the least 64-bit number, which is no id here; a damaged record raises ValueError.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.bpe import tokenizer
from strandlog.llm.shared import arrow, batch, new_path

END_ID = 0
#: A file is closed once it has this many bytes, and another is begun.
FILE_BYTES = 64 << 20
#: Documents are dealt to tasks of about this many bytes of text, to MOST_PARTS tasks at the most (then larger ones).
PART_BYTES = 256 << 20
MOST_PARTS = 200_000
#: Words that a worker's tokenizer keeps, in each of two generations.
CACHE_ENTRIES = 250_000
NULL_ID = -(1 << 63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload that starts at `at`, and where the next record starts; checks both checksums."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged length at byte {at}")
    n = struct.unpack("<Q", head)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + n


def filesystem(uri: str):
    """The store and the path in it; the same call works on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class RecordWriter:
    """Writes one part of the output; files get their final names on close."""

    def __init__(self, uri: str, part: int):
        self.fs, self.path = filesystem(uri)
        self.part, self.number, self.out, self.files = part, 0, None, []
        self.fs.create_dir(self.path, recursive=True)

    def write(self, payload: bytes, n_tokens: int) -> None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.number:05d}"
            self.temp = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.at, self.offsets, self.tokens = self.fs.open_output_stream(self.temp), 0, [], 0
        self.offsets.append(self.at)
        data = frame(payload)
        self.out.write(data)
        self.at += len(data)
        self.tokens += n_tokens
        if self.at >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(f"{self.temp}.idx") as f:
            f.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        self.fs.move(f"{self.temp}.idx", f"{self.path}/{self.name}.idx")
        self.fs.move(self.temp, f"{self.path}/{self.name}.rec")
        self.files.append((self.part, self.number, f"{self.name}.rec", len(self.offsets), self.tokens))
        self.number, self.out = self.number + 1, None


def read_index(uri: str, name: str) -> np.ndarray:
    store, path = filesystem(uri)
    with store.open_input_file(f"{path}/{name.removesuffix('.rec')}.idx") as f:
        return np.frombuffer(f.read(), "<u8").astype(np.int64)


def read_records(uri: str, name: str, wanted: np.ndarray | None = None, block: int = 8 << 20) -> Iterator[bytes]:
    """Payloads of a file: all in order by blocks of some bytes, or those at the wanted index positions, in that order."""
    offsets = read_index(uri, name)
    store, path = filesystem(uri)
    with store.open_input_file(f"{path}/{name}") as f:
        if wanted is not None:
            for i in wanted:
                yield unframe(f.read_at(int(offsets[i + 1] - offsets[i]), int(offsets[i])), 0)[0]
            return
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
            data, at = f.read_at(int(offsets[j] - offsets[i]), int(offsets[i])), 0
            while at < len(data):
                payload, at = unframe(data, at)
                yield payload
            i = j


FILES = "part int, number int, name string, records long, tokens long"
_FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())])
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOCS = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write_records(docs: DataFrame, uri: str, tokenizer_path: str, n_parts: int, wide: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every text, in ascending id order, as n_parts or more files; one row per file comes back."""
    dtype = "<u4" if wide else "<u2"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, end = tokenizer(tokenizer_path, dtype, CACHE_ENTRIES), np.array([END_ID], dtype).tobytes()
        out = RecordWriter(uri, TaskContext.get().partitionId())
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1)), strict=True):
                out.write(b"".join((struct.pack("<q", NULL_ID if k is None else k), ids.data, end)), len(ids) + 1)
        out.close()
        yield batch(_FILES, *([f[i] for f in out.files] for i in range(len(_FILES))))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("__tie", F.xxhash64("text")).repartitionByRange(n_parts, "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")
    return arrow(rows.select("doc_id", "text"), write, FILES, keeps=True)


def read_documents(files: DataFrame, uri: str, wide: bool = False) -> DataFrame:
    """Read files back, checking every record: doc_id, start, n_tokens, ids_crc32 over 32-bit ids.

    files: (name, before long), before being the ids of all files that stand before.
    """
    dtype = "<u4" if wide else "<u2"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, at = [], before
                for payload in read_records(uri, name):
                    ids = np.frombuffer(payload, dtype, offset=8)
                    key = struct.unpack_from("<q", payload)[0]
                    rows.append((None if key == NULL_ID else key, at, len(ids), zlib.crc32(ids.astype("<u4"))))
                    at += len(ids)
                    if len(rows) == 4096:
                        yield batch(_DOCS, *zip(*rows, strict=True))
                        rows = []
                if rows:
                    yield batch(_DOCS, *zip(*rows, strict=True))

    return arrow(files.select("name", "before"), read, DOCS)


def encode_documents(docs: DataFrame, tokenizer_path: str, uri: str | None = None, n_parts: int | None = None) -> DataFrame:
    """Write the documents' ids as record files and return what the files say. The driver gets a row for each file, that
    is a few bytes for each FILE_BYTES of ids."""
    spark = docs.sparkSession
    uri = uri or new_path(spark, "records")
    if n_parts is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        n_parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MOST_PARTS))
    made = write_records(docs, uri, tokenizer_path, n_parts).collect()
    before, rows = 0, []
    for r in sorted(made, key=lambda r: (r["part"], r["number"])):
        rows.append((r["name"], before))
        before += r["tokens"]
    files = spark.createDataFrame(rows, "name string, before long")
    return read_documents(files.repartition(max(1, len(rows))) if rows else files, uri)
