"""Token ids in flat binary files with 64-bit document offsets.

Rows are range-partitioned and sorted by document id.  Each task writes three files:
``<k>.ids``, the ids of its documents one after the other as little-endian unsigned integers (two
bytes where the vocabulary allows it, else four), ``<k>.ends``, the place after each document as
unsigned 64-bit integers, and ``<k>.docs``, the document ids as signed 64-bit integers.  A task does
not know how many ids come before its own, so places count within the part, and ``bases.json``
holds each part's base: the prefix sums of the parts' totals, one number per part.  A file appears under its final
name only when whole, so a task that runs again replaces it by the same bytes.

Null texts are encoded as empty texts, rows without id come first, rows with the same id follow
their text, an empty table gives a folder with no part that holds rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm.common import longs, shared_folder, table, texts_of
from feedloom.llm.tokens import byte_level

END_ID = 2
NO_ID = -(1 << 63)
READ = 4096


def store(uri: str):
    """File system and path of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def folder_uri(path: str) -> str:
    """``file:/a`` as ``file:///a``."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def put(files, path: str, chunks: list[bytes]) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(temporary, path)


def mapped(files, path: str, dtype: str) -> np.ndarray:
    """The integers of a file: memory-mapped from a local or mounted folder, else read."""
    if files.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> dict:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id`` and write the files.

    Returns the index that ``bases.json`` holds.  ``parts`` defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = folder_uri(folder)
    files, path = store(uri)
    files.create_dir(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        files, path = store(uri)
        part = TaskContext.get().partitionId()
        name = f"{path}/{part:06d}"
        temporary = f"{name}.{uuid.uuid4().hex}"
        lengths, docs_ids = [], []
        with files.open_output_stream(temporary) as out:
            for batch in batches:
                for text in texts_of(batch.column(1)):
                    ids = encoder.ids(text) + end
                    out.write(ids)
                    lengths.append(len(ids) // encoder.dtype.itemsize)
                docs_ids.append(np.asarray(batch.column(0).fill_null(NO_ID), dtype="<i8").tobytes())
        if not lengths:
            files.delete_file(temporary)
            return
        files.move(temporary, f"{name}.ids")
        ends = np.cumsum(np.array(lengths, dtype="<u8"), dtype="<u8")
        put(files, f"{name}.ends", [ends.tobytes()])
        put(files, f"{name}.docs", docs_ids)
        yield pa.record_batch([longs([part]), longs([int(ends[-1])]), longs([len(lengths)])], ["part", "n_tokens", "n_docs"])

    totals = sorted(
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, "part long, n_tokens long, n_docs long")
        .collect()
    )
    bases = accumulate((t.n_tokens for t in totals), initial=0)
    index = {
        "tokenizer": os.path.basename(tokenizer),
        "bytes_per_id": byte_level(tokenizer).dtype.itemsize,
        "parts": [{"part": t.part, "base": b, "n_tokens": t.n_tokens, "n_docs": t.n_docs} for t, b in zip(totals, bases)],
    }
    put(files, f"{path}/bases.json", [json.dumps(index).encode()])
    return index


def read_index(folder: str) -> dict:
    files, path = store(folder_uri(folder))
    with files.open_input_file(f"{path}/bases.json") as f:
        return json.loads(f.read())


def part_of(folder: str, index: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ends within the part and document ids of the k-th part."""
    files, path = store(folder_uri(folder))
    name = f"{path}/{index['parts'][k]['part']:06d}"
    return (
        mapped(files, f"{name}.ids", f"<u{index['bytes_per_id']}"),
        mapped(files, f"{name}.ends", "<u8"),
        mapped(files, f"{name}.docs", "<i8"),
    )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of each document, a task per part."""
    index = read_index(folder)
    n = len(index["parts"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, ends, docs = part_of(folder, index, k)
                base = index["parts"][k]["base"]
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                stops = ends.astype(np.int64)
                for at in range(0, len(docs), READ):
                    own = slice(at, at + READ)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[own], stops[own])]
                    yield pa.record_batch(
                        [
                            pa.array(docs[own], mask=docs[own] == NO_ID),
                            longs(starts[own] + base),
                            longs(stops[own] - starts[own]),
                            longs(crc),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files under the shared folder and read back."""
    folder = shared_folder(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.json")
    return digests(spark, folder)
