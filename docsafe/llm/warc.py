"""WARC archives and their index.

`write` makes a WARC/1.1 record of every page: of equal payloads the row with the largest page_id is a response, an HTTP
message whose body is the payload, and all others are revisits that name it. Every archive begins with a warcinfo
record. Spark's text writer writes the records, to any file system that Spark reaches and under its commit protocol; a
record is one row and ends in the writer's newline. `read` takes the archives back as binary files of about
`FILE_BYTES`, and parses them by Content-Length.

`index` is an external merge. Captures are cut into runs, each sorted by URL key and timestamp; a run is written as
chunks of at most `CHUNK` captures that are known by their first one. Spark deals the chunks to ranges of keys and orders
them by their first capture (with its own spill), and a loser tree merges them as a stream: a chunk joins the tree when
the merge has come to its first capture and leaves it when it is spent, so a task holds one chunk of each run and no
more. While there are more than `most_runs` runs, groups of them are merged into longer ones first. Ranges follow one
another, so the whole is globally ordered, and a capture history is a stretch of it.

Defined cases: a null or empty html is an empty payload; null and empty urls are read back as what they were, and so are
urls with white space or control characters; a null page_id counts as smaller than any other; rows of one page_id are
records of their own, and of rows that tie in page_id and payload one is the response; long payloads pass whole; an empty
table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsafe.llm import _shared

FILE_BYTES = 8 << 20
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
#: Captures of a chunk, of a first run and of a range; keys that the driver takes to set the ranges' bounds.
CHUNK, RUN_ROWS, RANGE_ROWS, SAMPLE = 64, 1 << 16, 1 << 18, 10_000
KEYS = ["url_key", "captured", "page_id", "archive", "record_offset"]
#: Characters that a header line cannot hold as they are. The rest is UTF-8, as WARC/1.1 allows.
UNFIT = re.compile(r"[\x00-\x20\x7f\x85  ]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The host's labels reversed, then path and query, lower case: captures of one page sort together."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return (url or "").lower()
    path = parts.path.rstrip("/") or "/"
    return (",".join(reversed(host.split("."))) + port + ")" + path + (f"?{parts.query}" if parts.query else "")).lower()


def stamp(page_id: int | None) -> str:
    """The capture time of a page, a second for each page_id."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(repr(parts).encode()).hexdigest())}>"


def _decided(pages: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(x or "").encode() for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in found], pa.int64()), pa.array([digest(x) for x in found], pa.string())], ["page_id", "url", "html", "payload_bytes", "payload_digest"])

    return _shared.arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, html string, payload_bytes long, payload_digest string")


def _same(a: DataFrame, b: DataFrame, names: list[str]):
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"_{n}"])
    return out


def _records(pages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The digests of all pages, and a row for each record: row (null for a response), page_id, url, html, payload_bytes, payload_digest, and of what a
    revisit refers to last and last_url. Payloads are read twice, and neither written nor shuffled for the decision."""
    table = _shared.written(_decided(pages).select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "payload_bytes", "payload_digest"), "digests")
    first = table.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(F.struct("page_id", "row", "url")).alias("w"), F.count("*").alias("copies")).where("copies > 1")
    first = _shared.written(first.select("payload_digest", F.col("w.page_id").alias("last"), F.col("w.row").alias("last_row"), F.col("w.url").alias("last_url")), "first")
    revisits = table.join(_shared.small(first, 160 * first.count()), "payload_digest").where("row <> last_row").withColumn("html", F.lit(None).cast("string"))
    revisits = revisits.withColumn("tied", F.col("page_id").eqNullSafe(F.col("last")) & F.col("url").eqNullSafe(F.col("last_url")))
    keys = ["page_id", "url", "payload_digest"]
    keyed = lambda tied: revisits.where(F.col("tied") == tied).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    gone = _shared.written(keyed(False), "gone")
    decided = _decided(pages)
    answers = decided.join(_shared.small(gone, 160 * gone.count()), _same(decided, gone, keys), "left_anti")
    tied = _shared.written(keyed(True), "tied")
    if rows := tied.count():  # rows alike in all that is kept: one of them stands for the response
        hint = _shared.small(tied, 160 * rows)
        once = answers.join(hint, _same(answers, tied, keys), "left_semi").groupBy(*keys, "payload_bytes").agg(F.first("html").alias("html"))
        answers = answers.join(hint, _same(answers, tied, keys), "left_anti").unionByName(once)
    nothing = {"row": F.lit(None).cast("long"), "last": F.lit(None).cast("long"), "last_url": F.lit(None).cast("string")}
    columns = ["row", "page_id", "url", "html", "payload_bytes", "payload_digest", "last", "last_url"]
    return table, answers.withColumns(nothing).select(*columns).unionByName(revisits.select(*columns))


def _info() -> str:
    body = "software: docsafe\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {stamp(0)}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head) + "\r\n\r\n" + body + "\r\n\r"


def _record(r: dict, least: int, place: tuple) -> str:
    payload, url = r["html"] or "", r["url"]
    revisit = r["row"] is not None
    own = (r["page_id"], url, r["payload_digest"])
    ident = record_id(*own, r["row"]) if revisit else record_id(*own) if r["payload_bytes"] >= least else record_id(*own, place)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {ident}", f"WARC-Date: {stamp(r['page_id'])}"]
    if url is not None:
        fit = UNFIT.sub(lambda m: quote(m[0]), url)
        head += [f"WARC-Target-URI: {fit}"] * bool(fit) + [f"X-Target-URI: {quote(url, safe='')}"] * (fit != url or not url)
    if r["page_id"] is not None:
        head.append(f"X-Page-Id: {r['page_id']}")
    head += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Payload-Length: {r['payload_bytes']}"]
    message = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(r['last'], r['last_url'], r['payload_digest'])}"]
        head += [f"X-Refers-To-Page: {r['last']}"] * (r["last"] is not None)
        message, payload, size = message + "\r\n", "", 0
    else:
        message, size = message + f"Content-Length: {r['payload_bytes']}\r\n\r\n", r["payload_bytes"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(message) + size}"]
    # the writer ends the row with the last newline of the record's closing \r\n\r\n
    return "\r\n".join(head) + "\r\n\r\n" + message + payload + "\r\n\r"


def write(pages: DataFrame, least: int = 0) -> str:
    """The folder of archives written. Payloads of fewer than `least` bytes are responses always."""
    spark = pages.sparkSession
    table, records = _records(pages, least)
    total = table.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    per_file = max(2, int(FILE_BYTES / (total[0] / max(total[1], 1) + 600)))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if done % per_file == 0:  # the writer begins a new archive here
                    out.append(_info())
                    done += 1
                out.append(_record(r, least, (part, done)))
                done += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    path = _shared.new_path(spark, "warc")
    lines = _shared.mapped(records, render, "value string")
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        body = end + 4
        size = int(head["Content-Length"])
        if data[body + size : body + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        yield at, head, data[body : body + size]
        at = body + size + 4


READ = "archive string, record_offset long, url_key string, url string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
NAMES = [x.split()[0] for x in READ.split(", ")]


def capture(name: str, at: int, head: dict[str, str], block: bytes) -> tuple:
    """The row of one record; the digest and size of a response are those of its payload, and must be its header's."""
    kind, got = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(head["X-Payload-Length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        found = digest(payload)
        if (found, len(payload)) != (got, n):
            raise ValueError(f"{name}: payload at byte {at} has digest {found}, not {got}")
    url = unquote(head["X-Target-URI"]) if "X-Target-URI" in head else head.get("WARC-Target-URI")
    number = lambda k: int(head[k]) if k in head else None
    return (name, at, url_key(url), url, head["WARC-Date"], number("X-Page-Id"), n, got, kind, number("X-Refers-To-Page"))


def read(spark, path: str) -> DataFrame:
    """A row for each capture of the archives, an archive's in order of URL key and timestamp."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                own = name.rsplit("/", 1)[-1]
                rows = [capture(own, at, head, block) for at, head, block in parse(content.as_py()) if head["WARC-Type"] in ("response", "revisit")]
                rows.sort(key=lambda r: (r[2], r[4], -1 if r[5] is None else r[5], r[1]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    # sizes of files are bounded by write; few rows a batch keep few files in memory
    return _shared.mapped(files, run, READ)


class LoserTree:
    """Merges sorted runs of any number: a path of losers of length log2 k is replayed for every row. Runs may join
    between rows; spent ones are dropped then, and the tree is played anew."""

    def __init__(self, runs: list[Iterator[tuple]] = ()):
        self.runs, self.heads, self.tree = [], [], []
        for r in runs:
            self.add(r)

    def add(self, run: Iterator[tuple]) -> None:
        if (head := next(run, None)) is not None:
            self.runs.append(run)
            self.heads.append(head)
            self.tree = []

    def _begin(self) -> None:
        live = [i for i, h in enumerate(self.heads) if h is not None]
        self.runs, self.heads = [self.runs[i] for i in live], [self.heads[i] for i in live]
        self.tree = [-1] * len(live)
        for i in range(len(live) - 1, -1, -1):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and x is not None or x is not None and y is not None and (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # the first to come waits for its rival
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def least(self) -> tuple | None:
        """The row that comes next."""
        if not self.tree and self.runs:
            self._begin()
        return self.heads[self.tree[0]] if self.tree else None

    def pop(self) -> tuple | None:
        if (out := self.least()) is not None:
            best = self.tree[0]
            self.heads[best] = next(self.runs[best], None)
            self._play(best)
        return out

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.pop()) is not None:
            yield row


def _keys(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    return [(u or "", c or "", -1 if p is None else p, a or "", o or 0) for u, c, p, a, o in zip(*[table.column(k).to_pylist() for k in KEYS], strict=True)]


def runs(records: DataFrame, size: int = RUN_ROWS) -> DataFrame:
    """records as sorted runs of `size` rows: the sorted stretches that a task is given are merged; run tells them apart."""
    names = records.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId() << 32

        def merged() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            keys = _keys(table)
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] < keys[i - 1]], len(keys)]
            order = [i for _, i in LoserTree([iter([(keys[i], i) for i in range(a, b)]) for a, b in zip(starts, starts[1:], strict=False)])]
            out = table.take(pa.array(order)).append_column("run", pa.array([number] * len(order), pa.int64()))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            held += [batch] * bool(batch.num_rows)
            if sum(x.num_rows for x in held) >= size:
                yield from merged()
                held, number = [], number + 1
        if held:
            yield from merged()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields) + ", run long"
    return _shared.mapped(records.select(*names), cut, schema)


def _merged(sorted_runs: DataFrame, names: list[str], slots: int, fences: list[tuple] | None, chunk: int) -> DataFrame:
    """Rows of the runs merged within every slot, in the order of the slots; a slot is a range between fences, or without
    them a group of runs. Its number is the rows' new run."""
    row = sorted_runs.select(*names).schema
    struct = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in row.fields)
    firsts = [f"_{i}" for i in range(len(KEYS))]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, keys, cuts, slot = batch.column("run").to_pylist(), _keys(batch), [], []
            ends, end = [0] * len(keys), len(keys)  # of the sorted stretch of one run that each row lies in
            for i in range(len(keys) - 1, -1, -1):
                ends[i] = end
                if i and (run[i] != run[i - 1] or keys[i] < keys[i - 1]):
                    end = i
            at = 0
            while at < len(keys):
                to = min(at + chunk, ends[at])
                if fences is None:
                    s = hash((run[at], 0x9E3779B9)) % slots
                else:
                    s = bisect.bisect_right(fences, keys[at])
                    if s < len(fences):
                        to = bisect.bisect_left(keys, fences[s], at, to)
                cuts.append(at)
                slot.append(s)
                at = to
            if cuts:
                inner = pa.StructArray.from_arrays([batch.column(n) for n in names], names)
                rows = pa.ListArray.from_arrays(pa.array([*cuts, len(keys)], pa.int32()), inner)
                first = [pa.array(c, t) for c, t in zip(zip(*[keys[i] for i in cuts], strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), *first, rows], ["slot", *firsts, "rows"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda r: (r["url_key"] or "", r["captured"] or "", -1 if r["page_id"] is None else r["page_id"], r["archive"] or "", r["record_offset"] or 0)
        out: list[dict] = []
        tree, now = LoserTree(), None
        number = iter(range(1 << 62))  # no two rows tie, so that rows are never compared

        def emitted(upto: tuple | None) -> Iterator[pa.RecordBatch]:
            """Rows before a key, or all."""
            while (head := tree.least()) is not None and (upto is None or head[0] < upto):
                out.append(tree.pop()[2] | {"run": now})
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()

        schema = None
        for batch in batches:
            schema = schema or pa.schema([*batch.schema.field("rows").type.value_type, pa.field("run", pa.int64())])
            for i in range(batch.num_rows):
                slot, first = batch.column("slot")[i].as_py(), tuple(batch.column(f)[i].as_py() for f in firsts)
                yield from emitted(first if slot == now else None)
                now = slot
                tree.add(iter([(key(r), next(number), r) for r in batch.column("rows")[i].as_py()]))
        yield from emitted(None)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    flat = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in row.fields)
    dealt = _shared.mapped(sorted_runs, chunks, f"slot int, _0 string, _1 string, _2 long, _3 string, _4 long, rows array<struct<{struct}>>")
    return _shared.mapped(dealt.repartitionByRange("slot").sortWithinPartitions("slot", *firsts), merge, flat + ", run long")


def index(records: DataFrame, run_rows: int = RUN_ROWS, most_runs: int = 4096, fan_in: int = 64, chunk: int = CHUNK) -> DataFrame:
    """records in the global order of url_key and captured."""
    spark, names = records.sparkSession, records.columns
    table = _shared.written(runs(records, run_rows), "runs")
    total, many = table.agg(F.count("*"), F.count_distinct("run")).first()
    while many > most_runs:
        longer = _shared.written(_merged(table, names, max(1, many // fan_in), None, chunk), "runs")
        _shared.remove(table)
        table, many = longer, longer.agg(F.count_distinct("run")).first()[0]
    # bounds of the ranges from a sample by hash, whose size does not grow with the table
    step = max(1, total // SAMPLE)
    taken = table.where(F.pmod(F.xxhash64("archive", "record_offset"), F.lit(step)) == 0).select(*KEYS).toArrow() if total else None
    sample = sorted(_keys(taken)) if total else []
    ranges = max(1, min(max(total // RANGE_ROWS, spark.sparkContext.defaultParallelism), len(sample) // 8))
    fences = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})
    return _merged(table, names, ranges, fences, chunk).select(*names)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Captures as they are indexed; where their records lie differs between runs and is left to `index`."""
    path = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


#: The same of pages with distinct page_ids and URLs of http or https, without ports.
OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
u AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '') AS host, rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM p),
h AS (SELECT *, list_transform(string_split(regexp_replace(sha1(html), '(.{5})', '\1 ', 'g'), ' ')[:8], lambda x: ('0x' || x)::BIGINT) AS parts FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to,
lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '' THEN '' ELSE '?' || query END) AS url_key,
strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 315360000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM h JOIN u USING (page_id)"""
