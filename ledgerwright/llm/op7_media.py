"""ISO base media files: writing byte payloads as raw 8-bit frames, and reading box trees and sample tables.

The reader walks nested boxes, decodes the sample tables of every track, plain, compact or in fragments, and gives
codec, duration and the byte ranges of keyframes. It never looks inside media data, and every read is held to its box.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .session import freeing, ship

FRAME_WIDTH, FRAME_HEIGHT = 32, 18
FRAME = FRAME_WIDTH * FRAME_HEIGHT
RATE, GOP, CHUNK_FRAMES = 25, 12, 32
_CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_DEEPEST = 32


class BadMedia(ValueError):
    """The bytes are not a well-formed media file."""


def _box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    return struct.pack(">I4s", size, kind) + b"".join(body)


def _full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *body)


def write_media(payload: bytes) -> bytes:
    """A file with one raw 8-bit grey video track whose frames, in order, are the payload (whole frames only)."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes")
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
    tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHH2x", 0, 0, 1, 0, n, 0, 0, 0), _MATRIX, struct.pack(">II", FRAME_WIDTH << 16, FRAME_HEIGHT << 16), flags=7)
    mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0))
    hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"payload\0")
    entry = _box(b"raw ", bytes(6), struct.pack(">H16xHHIIIH32sHh", 1, FRAME_WIDTH, FRAME_HEIGHT, 0x480000, 0x480000, 0, 1, b"\x04grey", 40, -1))
    chunks = -(-n // CHUNK_FRAMES)
    last = n - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, last, 1)] if chunks == 1 else [(1, CHUNK_FRAMES, 1)] + ([(chunks, last, 1)] if last != CHUNK_FRAMES else [])
    keys = range(1, n + 1, GOP)

    def moov(base: int) -> bytes:
        places = (base + np.arange(chunks, dtype=np.int64) * (FRAME * CHUNK_FRAMES)).astype(">u8").tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), np.array(keys, ">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(">I", chunks), places),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl))))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    long = len(payload) + 8 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    front = len(ftyp) + len(moov(0))
    return b"".join((ftyp, moov(front + len(head)), head, payload))


def walk(data: bytes, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, first byte of the content, end, first byte of the box) of every box, outer boxes first. Sizes are checked, never trusted."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise BadMedia(f"{hi - lo} stray bytes at {lo}")
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if hi - lo < 16:
                raise BadMedia(f"cut short at {lo}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = hi - lo
        if kind == b"uuid":
            body += 16
        if lo + size > hi or body > lo + size:
            raise BadMedia(f"box {kind!r} at {lo} has a wrong size")
        here = (*path, kind)
        yield here, body, lo + size, lo
        if kind in _CONTAINERS:
            if len(here) > _DEEPEST:
                raise BadMedia("boxes are nested too deeply")
            yield from walk(data, body, lo + size, here)
        lo += size


def _read(form: str, data: bytes, lo: int, hi: int) -> tuple:
    """Values at a place of a box, none of them beyond its end."""
    if lo + struct.calcsize(form) > hi:
        raise BadMedia(f"a box is cut short at {lo}")
    return struct.unpack_from(form, data, lo)


def _text(data: bytes, lo: int, hi: int) -> str:
    return _read("4s", data, lo, hi)[0].decode("latin-1")


def _table(data: bytes, lo: int, hi: int, width: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    (n,) = _read(">I", data, lo + skip, hi)
    lo += skip + 4
    if lo + n * width * np.dtype(kind).itemsize > hi:
        raise BadMedia("a table is longer than its box")
    return np.frombuffer(data, kind, n * width, lo).reshape(n, width).astype(np.int64)


def _compact_sizes(data: bytes, lo: int, hi: int) -> np.ndarray:
    """Sample sizes of 4, 8 or 16 bits."""
    bits, n = _read(">II", data, lo + 4, hi)
    bits &= 0xFF
    if bits not in (4, 8, 16) or lo + 12 + -(-n * bits // 8) > hi:
        raise BadMedia("compact sizes of a wrong width, or cut short")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, -(-n // 2), lo + 12)
        return np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, lo + 12).astype(np.int64)


class _Track:
    def __init__(self):
        self.number, self.codec, self.handler, self.timescale, self.duration = 0, "", "", 0, 0
        self.width = self.height = 0
        self.times = np.empty((0, 2), np.int64)
        self.shifts = np.empty((0, 2), np.int64)
        self.runs = self.chunks = np.empty((0, 1), np.int64)
        self.sizes = np.empty(0, np.int64)
        self.keys: np.ndarray | None = None
        self.defaults = (0, 0, 0)  # of fragments: a sample's duration, size and flags
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []  # places, sizes, which are keys, ticks

    def offsets(self) -> np.ndarray:
        """First byte of each sample: chunks hold runs of samples that lie one after another."""
        n, chunks = len(self.sizes), self.chunks[:, 0]
        if not n:
            return np.empty(0, np.int64)
        if not len(self.runs) or not len(chunks) or self.runs[0, 0] != 1 or (np.diff(self.runs[:, 0]) <= 0).any():
            raise BadMedia("samples without chunks")
        spans = np.diff(np.append(self.runs[:, 0], len(chunks) + 1))
        if (spans < 0).any():
            raise BadMedia("chunk runs beyond the chunks")
        per = np.repeat(self.runs[:, 1], spans)
        ends = np.cumsum(per)
        if ends[-1] < n:
            raise BadMedia("fewer samples in chunks than in the size table")
        chunk = np.searchsorted(ends, np.arange(n), side="right")
        before = np.cumsum(self.sizes) - self.sizes
        return chunks[chunk] + before - before[(ends - per)[chunk]]


# Bits that say which fields of a fragment's header and of a run are there, and that a sample is no key.
_BASE, _DESCRIPTION, _DURATION, _SIZE, _FLAGS, _MOOF_BASE = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
_RUN_OFFSET, _RUN_FIRST, _RUN_FIELDS = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800)
_NOT_KEY = 0x10000


class _Fragment:
    """One track's part of a moof box: where its data begin, and what its samples have unless a run says otherwise.

    Data are counted from the place that the header names, from the first byte of the moof box where it says so, and
    else from where the part before it in the same moof box (``before``) ends: the first part begins at the moof box."""

    def __init__(self, data: bytes, lo: int, hi: int, moof: int, before: int | None, by_number: dict[int, _Track]):
        flags, number = _read(">II", data, lo, hi)
        if number not in by_number:
            raise BadMedia(f"a fragment of track {number}, which there is none of")
        self.track = by_number[number]
        at, values = lo + 8, list(self.track.defaults)
        self.base = moof if before is None or flags & _MOOF_BASE else before
        if flags & _BASE:
            (self.base,) = _read(">Q", data, at, hi)
            at += 8
        at += 4 * bool(flags & _DESCRIPTION)
        for k, bit in enumerate((_DURATION, _SIZE, _FLAGS)):
            if flags & bit:
                (values[k],) = _read(">I", data, at, hi)
                at += 4
        self.values, self.next = values, self.base

    def run(self, data: bytes, lo: int, hi: int) -> None:
        flags, n = _read(">II", data, lo, hi)
        at = lo + 8
        if flags & _RUN_OFFSET:
            self.next = self.base + _read(">i", data, at, hi)[0]
            at += 4
        first = None
        if flags & _RUN_FIRST:
            (first,) = _read(">I", data, at, hi)
            at += 4
        fields = [bit for bit in _RUN_FIELDS if flags & bit]
        if at + 4 * len(fields) * n > hi or n > len(data):
            raise BadMedia("a run of samples is longer than its box")
        told = np.frombuffer(data, ">u4", len(fields) * n, at).reshape(n, len(fields)).astype(np.int64)
        column = lambda bit, default: told[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)
        durations, sizes, marks = (column(bit, x) for bit, x in zip(_RUN_FIELDS, self.values))
        if first is not None and n:
            marks = marks.copy()
            marks[0] = first
        places = self.next + np.cumsum(sizes) - sizes
        self.next += int(sizes.sum())
        self.track.more.append((places, sizes, (marks & _NOT_KEY) == 0, int(durations.sum())))


def tracks(data: bytes) -> list[dict]:
    """Codec, handler, timescale, duration, dimensions, samples and keyframe byte ranges of every track.

    Samples come from the tables (stsz or stz2, stsc, stco or co64, stss, stts, ctts) and then from fragments (moof, traf,
    tfhd, trun, with trex's defaults), in the order of the file. Whatever is not well-formed raises BadMedia.
    """
    found: list[_Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    moof, fragment, before, by_number = 0, None, None, None
    for path, lo, hi, box in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append(_Track())
        elif kind == b"trex":
            number, _, *rest = _read(">IIIII", data, lo + 4, hi)
            defaults[number] = tuple(rest)
        elif kind == b"moof":
            moof, fragment, before = box, None, None
        elif kind == b"traf":
            before, fragment = fragment.next if fragment is not None else before, None
        elif kind == b"tfhd" and b"traf" in path:
            if by_number is None:
                by_number = {t.number: t for t in found}
                for number, t in by_number.items():
                    t.defaults = defaults.get(number, t.defaults)
            fragment = _Fragment(data, lo, hi, moof, before, by_number)
        elif kind == b"trun" and b"traf" in path:
            if fragment is None:
                raise BadMedia("a run of samples without a fragment header")
            fragment.run(data, lo, hi)
        if not found or b"trak" not in path:
            continue
        t = found[-1]
        if kind == b"tkhd":
            (version,) = _read("B", data, lo, hi)
            (t.number,) = _read(">I", data, lo + (20 if version == 1 else 12), hi)
        elif kind == b"mdhd":
            (version,) = _read("B", data, lo, hi)
            t.timescale, t.duration = _read(">IQ", data, lo + 20, hi) if version == 1 else _read(">II", data, lo + 12, hi)
        elif kind == b"hdlr" and len(path) == 4:
            t.handler = _text(data, lo + 8, hi)
        elif kind == b"stsd":
            t.codec = _text(data, lo + 12, hi)
            if t.handler == "vide":
                t.width, t.height = _read(">HH", data, lo + 40, hi)
        elif kind == b"stts":
            t.times = _table(data, lo, hi, 2)
        elif kind == b"ctts":
            t.shifts = _table(data, lo, hi, 2)
        elif kind == b"stss":
            t.keys = _table(data, lo, hi, 1)[:, 0] - 1
        elif kind == b"stsc":
            t.runs = _table(data, lo, hi, 3)
        elif kind in (b"stco", b"co64"):
            t.chunks = _table(data, lo, hi, 1, ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stsz":
            same, n = _read(">II", data, lo + 4, hi)
            t.sizes = np.full(n, same, np.int64) if same and n <= len(data) else _table(data, lo, hi, 1, skip=8)[:, 0]
        elif kind == b"stz2":
            t.sizes = _compact_sizes(data, lo, hi)
    return [_described(t, len(data)) for t in found]


def _described(t: _Track, size: int) -> dict:
    at = t.offsets()
    if len(t.shifts) and int(t.shifts[:, 0].sum()) > len(at):
        raise BadMedia("more composition offsets than samples")
    keys = np.arange(len(at)) if t.keys is None else t.keys
    if len(keys) and (keys.min() < 0 or keys.max() >= len(at)):
        raise BadMedia("keyframes beyond the samples")
    ticks = int((t.times[:, 0] * t.times[:, 1]).sum())
    marks = np.zeros(len(at), bool)
    marks[keys] = True
    parts = [(at, t.sizes, marks, ticks), *t.more]
    at, sizes, marks = (np.concatenate([p[k] for p in parts]) for k in range(3))
    ticks = sum(p[3] for p in parts)
    if len(at) and (at.min() < 0 or (at + sizes).max() > size):
        raise BadMedia("samples beyond the file")
    duration = t.duration or (ticks if t.more else 0)  # a file in fragments states none
    return {"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": duration, "width": t.width, "height": t.height, "ticks": ticks, "offsets": at, "sizes": sizes, "keys": np.flatnonzero(marks)}


_RANGE = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_TRACK = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("seconds", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int64()), ("keyframes", pa.list_(_RANGE))])
TRACKS = "array<struct<codec:string,handler:string,seconds:double,width:int,height:int,samples:bigint,keyframes:array<struct<start:bigint,length:bigint>>>>"


def _describe(batches):
    schema = pa.schema([("id", pa.int64()), ("tracks", pa.list_(_TRACK)), ("error", pa.string())])
    for batch in batches:
        rows, errors = [], []
        for media in batch.column("media"):
            media = media.as_buffer().to_pybytes() if media.is_valid else b""
            try:
                rows.append(
                    [
                        {"codec": t["codec"], "handler": t["handler"], "seconds": t["duration"] / t["timescale"] if t["timescale"] else None, "width": t["width"], "height": t["height"], "samples": len(t["sizes"]), "keyframes": [{"start": int(t["offsets"][k]), "length": int(t["sizes"][k])} for k in t["keys"]]}
                        for t in tracks(media)
                    ]
                )
                errors.append(None)
            except BadMedia as e:
                rows.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, schema.field("tracks").type), pa.array(errors, pa.string())], schema=schema)


def describe_media(files: DataFrame) -> DataFrame:
    """id and media (binary) to id, tracks and error. A null or empty file has no tracks; a malformed one has
    null tracks and the reason in error. Rows are independent, and other columns are not read."""
    ship(files.sparkSession)
    return files.select(F.col("id").cast("bigint").alias("id"), F.col("media").cast("binary").alias("media")).mapInArrow(freeing(_describe), f"id bigint, tracks {TRACKS}, error string")


def _store(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        for b in tc.blocks(batch.column("text")):
            media = []
            for i in range(len(b)):
                text = b.bytes_of(i)
                media.append(write_media(text + b"\xff" * (FRAME - len(text) if not text else -len(text) % FRAME)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.lo, len(b)), pa.array(np.diff(b.at)), pa.array(media, pa.binary())], schema=schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text's UTF-8 bytes, padded with bytes 255 to whole frames, as a media file.

    Null and empty texts give one frame of padding. One row for each row, whatever its doc_id."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freeing(_store), "doc_id bigint, n_bytes bigint, media binary")


_DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digest(batches):
    names = _DIGEST.replace("bigint", "").replace("string", "").replace(" ", "").split(",")
    for batch in batches:
        rows = []
        for media in batch.column("media"):
            whole = media.as_buffer().to_pybytes()
            (t,) = tracks(whole)
            at, size = t["offsets"], t["sizes"]
            joined = np.append(True, at[1:] != at[:-1] + size[:-1])  # samples that lie together are read together
            lo = at[joined]
            hi = (at + size)[np.append(joined[1:], True)]
            payload = b"".join(whole[a:b] for a, b in zip(lo.tolist(), hi.tolist()))
            keys = np.column_stack([at[t["keys"]], size[t["keys"]]])
            feature = f"{t['codec'].strip()} {t['width']}x{t['height']} {t['duration']}/{t['timescale']} s, {len(size)} samples, {len(keys)} keyframes at {zlib.crc32(keys.astype('<i8').tobytes()):08x}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), feature))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: texts stored as media files, and what the reader finds in these."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(freeing(_digest), _DIGEST)
