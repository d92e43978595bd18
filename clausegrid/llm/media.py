"""Media columns: content-addressed PNG payloads in tar shards."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import may_repeat, new_folder, repeated_keys, table, whole, written

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and the whole IHDR chunk


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey PNG of WIDTH samples a row; the length must be a positive multiple of WIDTH."""
    height, rest = divmod(len(payload), WIDTH)
    if rest or not height:
        raise ValueError(f"{len(payload)} bytes are not a positive multiple of {WIDTH}")
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first HEADER_BYTES of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png made; damage raises ValueError."""
    width, height, _, _ = png_header(media[:HEADER_BYTES])
    at, data = 8, b""
    while at < len(media):
        size = struct.unpack(">I", media[at : at + 4])[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unknown row filter")
    return rows[:, 1:].tobytes()


def _encode_new(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A PNG for each digest that this task has not met before."""
    seen: set[str] = set()
    for batch in batches:
        digests, media = [], []
        for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                media.append(to_png(payload.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])


class _TarShard:
    """A tar file written front to back on any file system that pyarrow knows."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        filesystem, path = pafs.FileSystem.from_uri(self.uri)
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size = filesystem.open_output_stream(path), 0

    def add(self, name: str, data: bytes) -> int:
        """Where the member's data begins."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        at = self.size + len(head)
        self.out.write(head + data + bytes(-len(data) % 512))
        self.size = at + len(data) + -len(data) % 512
        return at

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def _write_shards(folder: str, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        shard = None
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                data = media.as_py()
                if shard and shard.size + len(data) > shard_bytes:
                    shard.close()
                    shard = None
                shard = shard or _TarShard(folder)
                rows.append((digest, shard.uri, shard.add(f"{digest}.png", data), len(data)))
            names = ["digest", "shard", "offset", "length"]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if shard:
            shard.close()

    return write


def store_media(payloads: DataFrame, digest_col: str = "digest", payload_col: str = "payload", folder: str | None = None, shard_bytes: int = 64 << 20, bits: int = 23) -> DataFrame:
    """Stores each distinct payload once in tar shards; returns digest, shard, offset, length.

    `payloads` holds a digest and its bytes (a positive multiple of 64; rows with a null
    digest or payload are not stored), any number of times; other columns are left alone.
    Payloads that a bounded bitmap shows to be alone are written by the task that reads
    them. The others are encoded at most once by each task, so that one that fills a
    third of the table costs a PNG per task, and meet at the task that owns the digest,
    which keeps one. Each attempt of a task writes shards under names of its own and the
    index is written as a table, so a lost executor leaves at most an unreferenced file.
    """
    folder = folder or new_folder(payloads.sparkSession, "media")
    rows = payloads.select(F.col(digest_col).alias("digest"), F.col(payload_col).alias("payload")).dropna()
    rows = rows.withColumn("key", F.xxhash64("digest"))
    rows = may_repeat(rows, repeated_keys(rows.select("key"), bits), "key", "hit", bits)
    encode, write = (_encode_new, "digest string, media binary"), (_write_shards(folder, shard_bytes), "digest string, shard string, offset long, length long")
    alone = rows.filter("NOT hit").select("digest", "payload").mapInArrow(*encode).mapInArrow(*write)
    shared = rows.filter("hit").select("digest", "payload").mapInArrow(*encode).repartition("digest").mapInArrow(*write)
    return written(alone.unionByName(shared), "media-index")


class _Ranges:
    """Range reads; one shard stays open at a time."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            if self.file:
                self.file.close()
            filesystem, path = pafs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, filesystem.open_input_file(path)
        return self.file.read_at(length, offset)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = _Ranges()
    for batch in batches:
        found = [png_header(ranges.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
        more = [pa.array(c, pa.int32()) for c in (zip(*found, strict=True) if found else ((), (), (), ()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "width", "height", "bit_depth", "colour_type"])


def with_metadata(index: DataFrame) -> DataFrame:
    """The index with width, height, bit_depth and colour_type, from reads of the first 33 bytes of each payload."""
    return index.mapInArrow(_headers, "digest string, shard string, offset long, length long, width int, height int, bit_depth int, colour_type int")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = _Ranges()
    for batch in batches:
        rows = []
        for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
            media = ranges.read(shard, offset, length)
            payload = from_png(media)
            samples = np.frombuffer(payload, np.uint8)
            counts = np.bincount(samples, minlength=256)
            share = counts[counts > 0] / len(samples)
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest(), float(samples.mean()), int((counts > 0).sum()), float(-(share * np.log2(share)).sum())))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        more = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "mean", "distinct", "entropy"])
        yield pa.RecordBatch.from_arrays([*batch.columns, *more.columns[1:]], [*batch.schema.names, *more.schema.names[1:]])


def with_features(index: DataFrame) -> DataFrame:
    """An index (with its metadata) with what the stored bytes, read back and decoded, show."""
    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, mean double, distinct int, entropy double"
    return index.mapInArrow(_features, ", ".join(f"{n} {t}" for n, t in index.dtypes) + ", " + kinds)


def text_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, payload (UTF-8 of the text, null as empty, zero bytes up to a positive multiple of 64) and its digest."""
    raw = df.select(F.col(id_col), F.encode(whole(F.col(text_col)), "UTF-8").alias("raw"))
    padded = f"CAST(greatest({WIDTH}, ceil(octet_length(raw) / {WIDTH}) * {WIDTH}) AS INT)"
    payload = F.expr(f"rpad(raw, {padded}, X'00')")
    return raw.select(id_col, F.octet_length("raw").cast("long").alias("n_bytes"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


def tar_members(data: bytes) -> dict[str, bytes]:
    """Members of a whole tar shard by name; for tests and small shards."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the text as a PNG in a tar shard, read back: n_bytes, payload_bytes, digests, feature, and where the PNG lies."""
    docs = text_payloads(table(spark, sf_dir, "documents"))
    stored = with_features(with_metadata(store_media(docs)))
    feature = F.format_string("png:%dx%dx%d;mean=%.4f;distinct=%d;entropy=%.4f", "width", "height", "bit_depth", "mean", "distinct", "entropy")
    return docs.select("doc_id", "n_bytes", "digest").join(stored, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", feature.alias("feature"),
        "shard", "offset", "width", "height",
    )
