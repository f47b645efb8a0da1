"""Token ids in files of shuffled bit or byte planes.

A file holds whole documents in ascending doc_id order. Its ids, one after another, are cut into
blocks of a fixed number of ids. A block is transposed: plane k holds bit k (or byte k) of every id,
so that planes of high bits are nearly constant and compress to little. Every plane is compressed
with zstandard by itself. The index at the end names each plane's place, so that one block, or one
plane of it, can be read alone.

Layout, little-endian: magic; planes of block 0, of block 1, ...; index; u64 place of the index; magic.
Index: u32 version, u8 unit (1: bits, 8: bytes), u8 planes, u32 ids a block, u64 ids, u64 documents;
documents' ids (i64) and counts (u64), zstandard; for each block and plane its u64 place and u32 size.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .session import durable, freeing, parts, scratch, ship
from .tokens import encoded, vocabulary_path

MAGIC = b"LWPLANE1"
BLOCK_IDS = 1 << 16
#: Ids after which a file is closed, at the next document's end.
FILE_IDS = 1 << 26
_HEAD = struct.Struct("<IBBIQQ")
_PLACE = np.dtype([("at", "<u8"), ("size", "<u4")])
_NULL_ID = np.iinfo(np.int64).min


def planes(ids: np.ndarray, unit: int, count: int) -> list[bytes]:
    """Planes of a block, lowest first. unit 1: bits, unit 8: bytes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(count)]
    bits = np.unpackbits(raw, axis=1, bitorder="little", count=count)
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def unplanes(parts_: list[bytes], unit: int, n: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if unit == 8:
        for k, p in enumerate(parts_):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts_])
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        raw[:, : packed.shape[1]] = packed
    return raw.view("<u4").ravel()


class PlaneWriter:
    """Streams documents into one open binary file; holds a block of ids and the documents' counts."""

    def __init__(self, out, unit: int = 1, plane_count: int = 16, block_ids: int = BLOCK_IDS, level: int = 3):
        if unit not in (1, 8) or not 1 <= plane_count <= 32 // unit:
            raise ValueError("unit is 1 or 8, and an id has 32 bits")
        self.out, self.unit, self.count, self.block = out, unit, plane_count, block_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.index: list[tuple[int, int]] = []
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (self.unit * self.count):
            raise ValueError("an id does not fit the planes")
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            full = len(flat) // self.block * self.block
            for k in range(0, full, self.block):
                self._flush(flat[k : k + self.block])
            self.waiting, self.held = [flat[full:].copy()], len(flat) - full

    def _flush(self, ids: np.ndarray) -> None:
        for p in planes(ids, self.unit, self.count):
            p = self.pack.compress(p)
            self.out.write(p)
            self.index.append((self.at, len(p)))
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.waiting))
        docs = self.pack.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes())
        tail = _HEAD.pack(1, self.unit, self.count, self.block, self.total, len(self.docs)) + struct.pack("<Q", len(docs)) + docs + np.array(self.index, _PLACE).tobytes()
        self.out.write(tail + struct.pack("<Q", self.at) + MAGIC)


class PlaneFile:
    """Reads a file of planes through anything that can seek; holds one block at a time."""

    def __init__(self, source):
        self.f = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(max(0, end - 16))
        tail = source.read(16)
        if end < 24 or tail[8:] != MAGIC:
            raise ValueError("not a file of planes, or cut short")
        (at,) = struct.unpack("<Q", tail[:8])
        source.seek(at)
        index = source.read(end - 16 - at)
        version, self.unit, self.count, self.block, self.total, n = _HEAD.unpack_from(index)
        if version != 1:
            raise ValueError(f"version {version}")
        (size,) = struct.unpack_from("<Q", index, _HEAD.size)
        k = _HEAD.size + 8
        raw = zstandard.ZstdDecompressor().decompress(index[k : k + size]) if n else b""
        self.docs, self.sizes = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n :], "<u8").astype(np.int64)
        self.index = np.frombuffer(index[k + size :], _PLACE)

    def blocks(self):
        unpack = zstandard.ZstdDecompressor()
        for b in range(-(-self.total // self.block)):
            n = min(self.block, self.total - b * self.block)
            read = []
            for at, size in self.index[b * self.count : (b + 1) * self.count].tolist():
                self.f.seek(at)
                read.append(unpack.decompress(self.f.read(size)))
            yield unplanes(read, self.unit, n)

    def documents(self):
        """doc_id and ids of each document, in order."""
        stream, have = self.blocks(), np.empty(0, "<u4")
        for d, n in zip(self.docs.tolist(), self.sizes.tolist()):
            if len(have) < n:
                got, k = [have], len(have)
                while k < n:
                    got.append(next(stream))
                    k += len(got[-1])
                have = np.concatenate(got)
            yield d, have[:n]
            have = have[n:]


def _tokens(path: str, end_id: int, bounds: list[int]):
    """The texts' ids, and by ``bounds`` the range of doc_id that each belongs to; a null doc_id is below all others.

    A doc_id that is several bounds has so large a share of the rows: these are spread over the ranges between them."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    edges = np.array(bounds, np.int64)

    def run(batches):
        seen, salt = 0, TaskContext.get().partitionId() << 32  # a repeated task deals its rows out alike
        for ids, flat, sizes in encoded(batches, path, end_id):
            kind = np.uint32 if len(flat) and flat.max() > 65535 else np.uint16  # told apart by the first byte
            body, rows, at = flat.astype(kind), [], 0
            mark = bytes([np.dtype(kind).itemsize])
            for n in sizes.tolist():
                rows.append(mark + body[at : at + n].tobytes())
                at += n
            d = ids.fill_null(_NULL_ID).to_numpy()
            part, low = np.searchsorted(edges, d, side="right"), np.searchsorted(edges, d, side="left")
            spread = tc.mix(np.arange(seen, seen + len(d), dtype=np.uint64) + np.uint64(salt)) % (part - low + 1).astype(np.uint64)
            part = np.where(part - low > 1, low + spread.astype(np.int64), part).astype(np.int32)
            seen += len(d)
            yield pa.RecordBatch.from_arrays([pa.array(part), ids, pa.array(rows, pa.binary())], schema=schema)

    return run


def _write(folder: str, unit: int, plane_count: int):
    """Writes the sorted rows of a partition; files appear under their names only when whole."""
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, number, writer, stream = -1, 0, None, None

        def finish():
            nonlocal writer, number
            writer.close()
            size = stream.tell()
            stream.close()
            name = f"part-{part:06d}-{number:04d}.planes"
            if system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                system.move(temporary, f"{root}/{name}")
            else:  # an earlier attempt wrote the same bytes
                system.delete_file(temporary)
            row = pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, number, name, writer.total, len(writer.docs), size), schema)], schema=schema)
            writer, number = None, number + 1
            return row

        for batch in batches:
            for p, d, x in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if p != part:
                    if writer is not None:
                        yield finish()
                    part, number = p, 0
                if writer is None:
                    temporary = f"{root}/.part-{part:06d}-{number:04d}-{context.taskAttemptId()}"
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(temporary)
                    writer = PlaneWriter(stream, unit, plane_count)
                writer.add(_NULL_ID if d is None else d, np.frombuffer(x, np.uint16 if x[0] == 2 else np.uint32, offset=1) if len(x) > 1 else np.empty(0, np.uint32))
                if writer.total >= FILE_IDS:
                    yield finish()
        if writer is not None:
            yield finish()

    return run


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, unit: int = 1, folder: str | None = None) -> DataFrame:
    """Encode every text, add ``end_id``, and write files of planes in ascending doc_id order.

    Returns file, n_ids, n_docs, bytes and start (ids in all files before it), one row a file. Null and
    empty texts are just the end id. Rows with a null doc_id come first; rows with equal doc_id in any order. An
    empty table gives no files. Ranges of doc_id come from its own quantiles, and a doc_id that has a large share of
    the rows has several; texts are encoded where they are read, and only ids are shuffled, once. A document never
    crosses files. A task that is repeated writes the same bytes under the same names.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch(spark)
    folder = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:]
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = parts(spark)
    shares = F.array(*(F.lit(k / n) for k in range(1, n)))
    known = F.coalesce("doc_id", F.lit(_NULL_ID))
    bounds = docs.agg(F.percentile_approx(known, shares, 10_000).alias("b")).first()["b"] if n > 1 else []
    rows = docs.mapInArrow(freeing(_tokens(vocabulary, end_id, sorted(bounds or [])), encodes=True), "part int, doc_id bigint, ids binary")
    from .tokens import encoder

    wide = encoder(vocabulary).wide or end_id > 65535
    count = (20 if wide else 16) if unit == 1 else (4 if wide else 2)
    ranged = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    manifest = durable(ranged.mapInArrow(freeing(_write(folder, unit, count)), "part int, number int, file string, n_ids bigint, n_docs bigint, bytes bigint"))
    found = sorted(manifest.collect())  # a row for each file, some hundred MB of ids
    start, out = 0, []
    for r in found:
        out.append((f"{folder}/{r['file']}", r["n_ids"], r["n_docs"], r["bytes"], start))
        start += r["n_ids"]
    return spark.createDataFrame(out, "file string, n_ids bigint, n_docs bigint, bytes bigint, start bigint")


def _read(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            from pyarrow import fs

            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as source:
                rows: list = []
                for d, ids in PlaneFile(source).documents():
                    rows.append((None if d == _NULL_ID else d, start, len(ids), zlib.crc32(np.ascontiguousarray(ids))))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def read_digests(files: DataFrame) -> DataFrame:
    """From the files (file and start): doc_id, start, n_tokens and the crc32 of the ids of every document, a row each,
    null and equal doc_ids included. Documents of just an end id have one token. No files give no rows."""
    n = max(1, files.count())
    return files.select("file", "start").repartition(n).mapInArrow(freeing(_read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the documents as ids of the word-end vocabulary, written as bit planes and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(write_ids(docs, vocabulary_path("word_bpe_49k.json"), end_id=2))
