"""Media columns: lossless images of payloads in archives, read by a Spark data source.

`store` turns every payload into a grey PNG of 8-bit samples, 24 wide, and appends it as a member to an archive of its
task; beside each archive lies an index of its members' offsets. Archives are written under a name of their own attempt
and renamed when whole, and only the names that the committed table of results lists are read: a task that is run twice
leaves no second copy.

`MediaSource` plans partitions as byte ranges over the archives; a member belongs to the range in which it begins. A
reader opens its archive once, seeks to each member, checks its length and CRC, and retries that member alone; batches
go to Spark as Arrow. The folder may be any that pyarrow.fs can open (local or shared mounts, HDFS, S3, GCS).

Defined cases: a null or empty text is one unit of padding; equal texts give equal values, however often they occur;
long texts are one member; repeated rows are members of their own; a null doc_id is kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsafe.llm import _shared

UNIT = 576
WIDTH = 24
RANGE_BYTES = 8 << 20
#: Partitions planned at most; ranges grow beyond that.
MOST_RANGES = 100_000
#: Schemes of Hadoop under the names that pyarrow.fs has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
BATCH_BYTES = 4 << 20
TRIES = 3
#: magic, doc_id or -1, 1 if doc_id is null, bytes before padding, length and CRC of the image
HEAD = "<4sqBqqI"
HEAD_BYTES = struct.calcsize(HEAD)
MAGIC = b"MDIA"
PNG = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH wide, rows unfiltered."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 5)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of an image that encode made; its chunks' CRCs are checked."""
    if not image.startswith(PNG):
        raise ValueError("not a PNG")
    at, data, width = len(PNG), [], 0
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean and deviation of the samples, the share of each sixteenth of the range, and the mean step."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    step = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    return f"{x.mean():.3f},{x.std():.3f},{step:.3f}," + "-".join(str(int(b * 1000 // len(x))) for b in bins)


def _uri(path: str) -> str:
    uri = path if ":/" in path else f"file://{path}"
    scheme, rest = uri.split(":", 1)
    return f"{SCHEMES.get(scheme, scheme)}:{rest}".replace("file:///", "file:/").replace("file:/", "file:///")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(_uri(path))


def store(docs: DataFrame, text: str = "text") -> tuple[str, DataFrame]:
    """Writes the archives; their folder, and a table of them: archive, members, bytes."""
    path = _shared.new_path(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        name = uuid.uuid4().hex
        members: list[tuple[int, int]] = []
        at, out = 0, None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/.{name}")
                n, samples = payload(texts[i].as_py())
                image = encode(samples)
                doc = ids[i].as_py()
                out.write(struct.pack(HEAD, MAGIC, -1 if doc is None else doc, doc is None, n, len(image), zlib.crc32(image)) + image)
                members.append((at, HEAD_BYTES + len(image)))
                at += HEAD_BYTES + len(image)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.index") as f:
                f.write(np.array(members, "<i8").tobytes())
            fs.move(f"{root}/.{name}", f"{root}/{name}.media")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(members)], pa.int64()), pa.array([at], pa.int64())], ["archive", "members", "bytes"])

    made = _shared.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), run, "archive string, members long, bytes long")
    return path, _shared.written(made, "archives")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.listed = options.get("listed", "")

    def partitions(self) -> list[Range]:
        """Byte ranges of the archives; only names and sizes of files are read here."""
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((f.base_name.removesuffix(".media"), f.size) for f in found if f.base_name.endswith(".media"))
        if self.listed:
            with fs.open_input_stream(f"{root}/{self.listed}") as f:
                names = set(f.read().decode().split())
            files = [x for x in files if x[0] in names]
        step = max(self.step, -(-sum(size for _, size in files) // MOST_RANGES))
        return [Range(n, a, min(a + step, size)) for n, size in files for a in range(0, size, step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, root = _open(self.path)
        with fs.open_input_stream(f"{root}/{part.archive}.index") as f:
            members = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
        mine = members[np.searchsorted(members[:, 0], part.start) : np.searchsorted(members[:, 0], part.end)]
        held: list[tuple] = []
        size = 0
        with fs.open_input_file(f"{root}/{part.archive}.media") as f:
            for at, length in mine.tolist():
                held.append(member(f, at, length) + (part.archive, at))
                size += length
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def member(f, at: int, length: int, tries: int = TRIES) -> tuple[int | None, int, bytes]:
    """The member at an offset, tried again on its own if it comes short or damaged."""
    for k in range(tries):
        try:
            f.seek(at)
            raw = f.read(length)
            magic, doc, null, n, size, crc = struct.unpack_from(HEAD, raw)
            image = raw[HEAD_BYTES :]
            if magic != MAGIC or len(image) != size or zlib.crc32(image) != crc:
                raise OSError(f"member at byte {at} is damaged")
            return None if null else doc, n, image
        except (OSError, struct.error):
            if k + 1 == tries:
                raise
            time.sleep(0.05 * 2**k)
    raise AssertionError


SCHEMA = "doc_id long, n_bytes long, media binary, archive string, offset long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def load(spark, path: str, archives: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, media, archive, offset of every member under path; archives: only those named there."""
    _shared.ship(spark)
    spark.dataSource.register(MediaSource)
    reader = spark.read.format("media_archives").option("path", path)
    if archives is not None:  # a name for each task that wrote, listed in a file beside the archives
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        listed = f"{uuid.uuid4().hex}.listed"
        with fs.open_output_stream(f"{root}/{listed}") as f:
            for r in archives.select("archive").toLocalIterator():
                f.write(f"{r['archive']}\n".encode())
        reader = reader.option("listed", listed)
    return reader.load()


def features(media: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.column("media"):
            image = x.as_py()
            samples = decode(image)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return _shared.arrow_map(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    path, archives = store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return features(load(spark, path, archives))
