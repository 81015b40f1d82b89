"""Token-ID files with shuffled bit planes.

Ids are kept in segments. A segment holds whole documents and is a sequence of blocks of ``block`` ids; each block is
transposed into planes, all first bits (or bytes) of its ids, then all second ones, and so on, and each plane is
compressed by itself with zstandard. A segment's bytes are

    magic "SKTB", version, kind (1 bit planes, 8 byte planes), width in bytes, 0          8 bytes in all with the magic
    ids, ids in a block, blocks                                                           3 unsigned 32-bit integers
    for each block and plane: offset after this index, compressed size                    pairs of unsigned 32-bit integers
    the compressed planes

so that any block can be read alone. A file set is a folder with ``segments`` (Parquet: part, number, ids, the
documents' doc_id and sizes, and the bytes) and ``index`` (for each segment the number of ids before it in the whole
set). Spark's committer writes both, so a lost executor leaves no half files, and the folder can be in any store
that Spark writes to. Documents are in ascending doc_id order (null first; equal ids in the order of their content).

Defined results: null text counts as empty and is the end id alone; repeated rows are written each; an empty table
gives a set without segments; a text longer than a segment makes a segment of its own; columns but doc_id and text are
left out of the files, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_rows
from .pretoken import library_memo

MAGIC = b"SKTB"
HEAD = struct.Struct("<4sBBBxIII")
BITS, BYTES = 1, 8


def _planes(ids: np.ndarray, kind: int, width: int) -> list[bytes]:
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    if kind == BYTES:
        return [np.ascontiguousarray(p).tobytes() for p in by_byte]
    return [np.packbits((p >> k) & 1).tobytes() for p in by_byte for k in range(8)]


def encode_segment(ids: np.ndarray, *, block: int = 65_536, kind: int = BYTES, level: int = 1) -> bytes:
    """A segment of unsigned 32-bit ids."""
    top = int(ids.max()) if len(ids) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    compress = zstandard.ZstdCompressor(level=level).compress
    blocks = -(-len(ids) // block)
    packed = [compress(p) for at in range(0, len(ids), block) for p in _planes(ids[at : at + block], kind, width)]
    sizes = np.array([len(p) for p in packed], np.int64)
    index = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype("<u4")
    return HEAD.pack(MAGIC, 1, kind, width, len(ids), block, blocks) + index.tobytes() + b"".join(packed)


def decode_segment(data: bytes, only: range | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks, as little-endian unsigned 32-bit."""
    magic, version, kind, width, n, block, blocks = HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token segment of this version")
    planes = width * (8 if kind == BITS else 1)
    index = np.frombuffer(data, "<u4", blocks * planes * 2, HEAD.size).reshape(blocks, planes, 2)
    body = HEAD.size + index.nbytes
    decompress = zstandard.ZstdDecompressor().decompress
    out = []
    for b in range(blocks) if only is None else only:
        size = min(block, n - b * block)
        raw = [np.frombuffer(decompress(data[body + int(at) : body + int(at) + int(length)]), np.uint8) for at, length in index[b]]
        by_byte = np.zeros((size, 4), np.uint8)
        for k, p in enumerate(raw):
            by_byte[:, k if kind == BYTES else k // 8] |= p if kind == BYTES else np.unpackbits(p, count=size) << (k % 8)
        out.append(by_byte.reshape(-1).view("<u4"))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 2, segment_ids: int = 1 << 18, block: int = 65_536, kind: int = BYTES) -> None:
    """Encode every text, end it with ``end_id``, and write the file set at ``path``."""
    rows = text_rows(docs).select(F.col("doc_id").cast("long"), "text")
    # Sorted files of about the size of the input's partitions; Spark samples doc_id alone to cut the ranges.
    sized = rows.repartitionByRange(max(rows.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "doc_id")
    ordered = sized.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, end = library_memo(tokenizer), end_id.to_bytes(4, "little")
        number, part = 0, 0
        held: list[bytes] = []
        docs_in: list = []
        sizes: list[int] = []
        n = 0

        def segment() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u4")
            data = encode_segment(ids, block=block, kind=kind)
            return pd.DataFrame({"part": [part], "number": [number], "n_ids": [len(ids)], "doc_ids": [list(docs_in)], "sizes": [list(sizes)], "data": [data]})

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for doc, parts in zip(batch["doc_id"].astype("Int64"), memo.of(batch["text"]), strict=True):
                raw = b"".join(parts) + end
                if held and n + len(raw) // 4 > segment_ids:
                    yield segment()
                    number, held, docs_in, sizes, n = number + 1, [], [], [], 0
                held.append(raw)
                docs_in.append(None if doc is pd.NA else int(doc))
                sizes.append(len(raw) // 4)
                n += len(raw) // 4
        if held:
            yield segment()

    schema = "part int, number int, n_ids long, doc_ids array<long>, sizes array<long>, data binary"
    # Planes are compressed already.
    ordered.mapInPandas(encode, schema).write.option("compression", "none").parquet(f"{path}/segments")
    light = docs.sparkSession.read.schema(schema).parquet(f"{path}/segments").select("part", "number", "n_ids")
    parts = light.groupBy("part").agg(F.sum("n_ids").alias("all"))  # a row for each written part
    before = F.sum("all").over(Window.orderBy("part")) - F.col("all")
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    index = light.withColumn("within", within).join(parts.withColumn("before", before), "part")
    index.select("part", "number", "n_ids", (F.col("before") + F.col("within")).alias("first")).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, as bytes), from the files."""
    segments, index = spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/index")
    placed = segments.join(index.select("part", "number", "first"), ["part", "number"])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_ids, sizes, data, first in zip(batch["doc_ids"], batch["sizes"], batch["data"], batch["first"], strict=True):
                raw = memoryview(decode_segment(data).tobytes())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                made = pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in doc_ids], "Int64"), "start": starts + first, "n_tokens": sizes, "ids_crc32": [zlib.crc32(p) for p in parts]})
                if with_ids:
                    made["ids"] = [bytes(p) for p in parts]
                yield made

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return placed.select("doc_ids", "sizes", "data", "first").mapInPandas(decode, schema)


def token_files(docs: DataFrame, tokenizer: str, **options) -> str:
    """Write a file set in the shared folder; its path."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer, path, **options)
    return path
