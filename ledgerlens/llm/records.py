"""Token-id files: length-delimited binary records with a separate offset index.

A record file is a run of records, each

    uint64 length | uint32 masked crc32 of the length | payload | uint32 masked
    crc32 of the payload                                      (little-endian)

A payload is ``int8 kind of id (0 number, 1 null, 2 text) | int64 id (a text's
length in bytes) | uint8 bytes per token | the id's text, if it is one | token ids``.
Beside every record file stands an index file: the uint64 offset of each record
and, last, the size of the record file; a reader can fetch records in any order.

``write_records`` sorts the documents by id over range partitions (ties by a
hash of the text), tokenises them there and writes files of about
``file_bytes``; a task writes under fresh names and only files named in the
manifest count, so a task that runs again after a lost executor does no harm.
``read_records`` checks every length and checksum.

Defined results: a null or empty text is a record with the end id alone; null
ids come first; rows with equal ids stand in the order of their texts' hashes;
repeated rows are written as often as they come; an empty table gives an empty
manifest and no rows.

Scale: one range shuffle of id and text; the driver holds one number per write
task.  ``folder`` must be reachable from all executors (any URI of pyarrow.fs).
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import checkpoint_dir
from ledgerlens.llm.common import shared_folder, shared_table
from ledgerlens.llm.tokens import encoded_batches, token_coder

FILE_BYTES = 32 << 20
_HEAD = struct.Struct("<bqB")
_MANIFEST = ("part long, file_no long, path string, index_path string, "
             "n_records long, n_tokens long, tokens_before long")


def masked_crc(data: bytes) -> int:
    """Checksum rotated and offset, so that a checksum of data that holds
    checksums stays strong."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload,
                     struct.pack("<I", masked_crc(payload))))


def read_frame(stream) -> bytes:
    """The payload of the record at the stream's place."""
    head = stream.read(12)
    if len(head) < 12:
        raise ValueError("record file ends inside a record")
    size, check = head[:8], struct.unpack("<I", head[8:])[0]
    if masked_crc(size) != check:
        raise ValueError("checksum of a record length does not match")
    length = struct.unpack("<Q", size)[0]
    body = stream.read(length + 4)
    if len(body) < length + 4:
        raise ValueError("record file ends inside a record")
    payload = body[:length]
    if masked_crc(payload) != struct.unpack("<I", body[length:])[0]:
        raise ValueError("checksum of a record does not match")
    return payload


def encode_record(doc_id: int | str | None, ids: bytes, width: int) -> bytes:
    if isinstance(doc_id, str):
        name = doc_id.encode("utf-8", "surrogatepass")
        return frame(_HEAD.pack(2, len(name), width) + name + ids)
    return frame(_HEAD.pack(doc_id is None, doc_id or 0, width) + ids)


def decode_record(payload: bytes) -> tuple[int | str | None, np.ndarray]:
    kind, doc_id, width = _HEAD.unpack_from(payload)
    at = _HEAD.size
    if kind == 2:
        doc_id, at = payload[at:at + doc_id].decode("utf-8", "surrogatepass"), at + doc_id
    ids = np.frombuffer(payload, f"<u{width}", offset=at)
    return None if kind == 1 else doc_id, ids


class _Writer:
    """Writes one record file and, on closing, its index."""

    def __init__(self, folder: str, name: str):
        self.system, root = fs.FileSystem.from_uri(_uri(folder))
        self.system.create_dir(root, recursive=True)
        self.path = f"{root}/{name}.rec"
        self.index_path = f"{root}/{name}.idx"
        self.stream = self.system.open_output_stream(self.path)
        self.offsets, self.at, self.tokens = [], 0, 0

    def add(self, record: bytes, tokens: int) -> None:
        self.offsets.append(self.at)
        self.stream.write(record)
        self.at += len(record)
        self.tokens += tokens

    def close(self) -> None:
        self.stream.close()
        with self.system.open_output_stream(self.index_path) as out:
            out.write(np.array(self.offsets + [self.at], "<u8").tobytes())


def _uri(folder: str) -> str:
    """``folder`` with a scheme, as pyarrow.fs wants it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        return "file://" + folder[len("file:"):]
    return folder if "://" in folder else f"file://{folder}"


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text", keep_space: bool = False,
                  end_id: int = 2, file_bytes: int = FILE_BYTES,
                  partitions: int | None = None) -> DataFrame:
    """Write all documents in ascending id order; returns the manifest: part,
    file_no, path, index_path, n_records, n_tokens, tokens_before (tokens of
    all files before)."""
    spark = docs.sparkSession
    folder = _uri(folder or shared_folder(spark, "records"))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType
    id_type = "long" if isinstance(kind, T.IntegralType) else "string"
    rows = docs.select(F.col(id_col).cast(id_type).alias("_id"), F.col(text_col).alias("_text"),
                       F.xxhash64(text_col).alias("_tie"))
    rows = (rows.repartitionByRange(partitions, "_id", "_tie")
            .sortWithinPartitions("_id", "_tie").select("_id", "_text"))

    def write(batches):
        coder = token_coder(tokenizer, keep_space)
        width = coder.dtype.itemsize
        end = np.array([end_id], coder.dtype).tobytes()
        part, before, files, writer = TaskContext.get().partitionId(), 0, [], None

        def finish():
            writer.close()
            files.append((part, len(files), writer.path, writer.index_path,
                          len(writer.offsets), writer.tokens, before))
            return before + writer.tokens

        for batch, texts in encoded_batches(coder, batches, 1):
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts):
                if writer is None:
                    name = f"part-{part:05d}-{len(files):04d}-{uuid.uuid4().hex[:12]}"
                    writer = _Writer(folder, name)
                ids += end
                writer.add(encode_record(doc_id, ids, width), len(ids) // width)
                if writer.at >= file_bytes:
                    before, writer = finish(), None
        if writer is not None:
            finish()
        if files:
            names = [c.split()[0] for c in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if "path" in n else pa.int64())
                 for n, c in zip(names, zip(*files))], names=names)

    manifest = shared_table(rows.mapInArrow(write, _MANIFEST), "manifest")
    # tokens of the partitions before: one number per write task
    sums = {r.part: r.n for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
            .collect()}
    starts, total = [], 0
    for part in sorted(sums):
        starts.append((part, total))
        total += sums[part]
    base = spark.createDataFrame(starts, "part long, base long")
    return (manifest.join(base, "part")
            .withColumn("tokens_before", F.col("tokens_before") + F.col("base"))
            .drop("base"))


def read_records(manifest: DataFrame, folder: str | None = None,
                 id_type: str = "long") -> DataFrame:
    """Every record of the manifest's files: doc_id, start, n_tokens,
    ids_crc32 (of little-endian unsigned 32-bit ids).  ``id_type``: ``string`` for
    files of ids that are no whole numbers."""
    spark = manifest.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = _uri(folder or checkpoint_dir(spark))

    def read(batches):
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                with system.open_input_stream(path) as raw:
                    size = system.get_file_info(path).size
                    at = 0
                    while at < size:
                        payload = read_frame(raw)
                        at += len(payload) + 16
                        doc_id, ids = decode_record(payload)
                        out.append((doc_id, start, len(ids),
                                    zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                if out:
                    doc_ids, *numbers = zip(*out)
                    kind = pa.int64() if id_type == "long" else pa.string()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, kind), *[pa.array(c, pa.int64()) for c in numbers]],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (manifest.select("path", "tokens_before")
            .repartition(partitions, "path")
            .mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))


def read_shuffled(folder: str, path: str, index_path: str, seed: int):
    """Yield (doc_id, ids) of one record file in a random order, by its index."""
    system, _ = fs.FileSystem.from_uri(_uri(folder))
    with system.open_input_file(index_path) as f:
        offsets = np.frombuffer(f.read(), "<u8")[:-1].tolist()
    random.Random(seed).shuffle(offsets)
    with system.open_input_file(path) as f:
        for at in offsets:
            f.seek(at)
            yield decode_record(read_frame(f))
