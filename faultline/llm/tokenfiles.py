"""Token ids in files of separately compressed documents that share one zstandard dictionary.

A file is a JSON header line (dictionary hash, type of an id), the compressed id array of each document, an Arrow
table with doc_id, offset, size and id count per document, and the length of that table in 8 bytes. One document is
read with the index and one ranged read. The dictionary, trained on a bounded sample of documents, lies beside the
files under its hash.

A null or empty text has only the end id. Repeated doc_ids are written each time; a null doc_id comes first. Other
columns are left out. An empty table gives no files. Very long texts are encoded whole; a task holds one with its ids.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.bytebpe import byte_bpe
from faultline.llm.common import SharedFile, cuts_of, filesystem, map_columns, open_shared, range_of, stage

#: The dictionary is fitted on so many documents, drawn by a hash, and of longer ones on so many pieces, at hashed places of all
#: their ids, that together have SAMPLE_IDS ids.
SAMPLE, SAMPLE_IDS, PIECES, DICTIONARY_BYTES = 2000, 8192, 8, 65_536
ROWS_PER_FILE = 8192
FILES = pa.schema([("bucket", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])


def serialized(ids: bytes, kind: str) -> bytes:
    return np.frombuffer(ids, "<u4").astype(kind).tobytes()


def drawn_pieces(data: bytes, pieces: int, size: int) -> list[bytes]:
    """The data when they are short, otherwise so many pieces of `size` bytes at places that a hash of the data draws.

    Each piece lies in a part of its own, so all of the data can be drawn."""
    if len(data) <= pieces * size:
        return [data]
    # Places are whole ids of four bytes.
    rng, part = np.random.Generator(np.random.PCG64(zlib.crc32(data))), len(data) // pieces // 4
    starts = [4 * (i * part + int(rng.integers(0, part - size // 4 + 1))) for i in range(pieces)]
    return [data[at : at + size] for at in starts]


def train_dictionary(docs: DataFrame, path: str, end_id: int, kind: str) -> bytes:
    """The dictionary's bytes; what is too little to train on serves as the dictionary itself."""
    import zstandard

    # Thinned first, so that few texts meet in the task that takes the sample.
    share = min(1.0, 4 * SAMPLE / max(1, docs.count()))
    thin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(share * (1 << 30))
    drawn = docs.where(thin).select("text").orderBy(F.xxhash64("doc_id", "text")).limit(SAMPLE).select(
        F.coalesce("text", F.lit("")).alias("text"))

    def work(cols):
        bpe = byte_bpe(path)
        end = array("I", [end_id]).tobytes()
        found = [drawn_pieces(bpe.encode(t) + end, PIECES, 4 * SAMPLE_IDS // PIECES) for t in cols["text"]]
        return {"ids": [serialized(piece, kind) for pieces in found for piece in pieces]}

    samples = sorted(r["ids"] for r in map_columns(drawn, work, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(drawn_pieces(b"".join(samples), PIECES, DICTIONARY_BYTES // PIECES))


def write(docs: DataFrame, path: str, folder: str, end_id: int, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write the files in ascending doc_id order; one row per file: bucket, file, n_docs, n_tokens, start (the ids
    before it). Documents travel to their file compressed. A file holds a range of doc_ids."""
    spark = docs.sparkSession
    kind = "<u2" if max(end_id, len(byte_bpe(path).pieces)) < 1 << 16 else "<u4"
    dictionary = train_dictionary(docs, path, end_id, kind)
    name = hashlib.sha256(dictionary).hexdigest()
    _store(folder, f"{name}.dict", dictionary)
    cuts = cuts_of(docs, "doc_id", rows_per_file)
    rows = docs.select(range_of(F.col("doc_id"), cuts).cast("int").alias("bucket"), "doc_id", "text")

    def compress(cols):
        import zstandard

        bpe, end = byte_bpe(path), array("I", [end_id]).tobytes()
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        ids = [bpe.encode(t) + end for t in cols.pop("text")]
        return cols | {"n_tokens": [len(x) // 4 for x in ids], "frame": [packer.compress(serialized(x, kind)) for x in ids]}

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, out, index, done = None, None, [], []

        def close() -> None:
            table = pa.Table.from_pylist(index, schema=INDEX)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, INDEX) as writer:
                writer.write_table(table)
            data = sink.getvalue().to_pybytes()
            out.write(data)
            out.write(len(data).to_bytes(8, "little"))
            out.close()
            done.append({"bucket": bucket, "file": out.name, "n_docs": len(index), "n_tokens": sum(r["n_tokens"] for r in index)})

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if out:
                        close()
                    bucket, index = row["bucket"], []
                    out = SharedFile(folder, f"ids-{bucket:06d}", ".bin")
                    out.write(json.dumps({"dictionary": name, "ids": kind}).encode() + b"\n")
                frame = row["frame"]
                at = out.write(frame)
                index.append({"doc_id": row["doc_id"], "offset": at, "size": len(frame), "n_tokens": row["n_tokens"]})
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=FILES)

    frames = map_columns(rows, compress, "bucket int, doc_id long, n_tokens long, frame binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(cuts) + 1)
    ordered = frames.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", F.crc32("frame"))
    files = stage(ordered.mapInArrow(store, "bucket int, file string, n_docs long, n_tokens long"), "token-files")
    # One row per file, at most as many as cuts_of allows.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _store(folder: str, name: str, data: bytes) -> None:
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(data)


class TokenFile:
    """Reader of one file."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.file = open_shared(folder, name)
        head = json.loads(self.file.read_at(200, 0).partition(b"\n")[0])
        with open_shared(folder, f"{head['dictionary']}.dict") as found:
            dictionary = found.read()
        if hashlib.sha256(dictionary).hexdigest() != head["dictionary"]:
            raise ValueError("the dictionary is not the one that the file names")
        self.kind = head["ids"]
        self.packer = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.index = pa.ipc.open_stream(self.file.read_at(length, size - 8 - length)).read_all()

    def ids(self, offset: int, size: int) -> np.ndarray:
        """One document's ids, by one ranged read."""
        return np.frombuffer(self.packer.decompress(self.file.read_at(size, offset)), self.kind).astype("<u4")

    def document(self, doc_id: int) -> np.ndarray:
        found = self.index.filter(pa.compute.equal(self.index["doc_id"], doc_id)).to_pylist()[0]
        return self.ids(found["offset"], found["size"])


def read(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. Start counts the ids of all before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, start, out = TokenFile(folder, row["file"]), row["start"], []
                for entry in found.index.to_pylist():
                    ids = found.ids(entry["offset"], entry["size"])
                    out.append({"doc_id": entry["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
                    start += len(ids)
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = stage(files.select("bucket", "file", "start"), "token-index").repartition(parts, "bucket")
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
