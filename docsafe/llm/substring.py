"""Substring dedup by prefix-partitioned suffix trees.

Suffixes begin at every word and matter to a depth of `window` words, since a repeat is a node that deep. Prefixes of
variable length place them: the prefix of a suffix runs to the end of the least of the half-window grams inside its
window, so it has between half a window and a whole window of words; prefixes that end in the same gram are one group.
Neighbouring suffixes mostly share a group, so their text travels once, and equal windows always have equal prefixes.
Groups whose suffixes all come from one document hold no repeat across documents and end there. A group of more than
`most` suffixes does not fit a task: its prefixes are lengthened, to the ends of grams of three quarters of a window and
then of the whole window, and only what still does not fit goes on. One task sorts the suffixes of a group that fits and
reads its subtree off their common prefixes: an interval of common prefix >= window is a deep node, a repeat, and its
smallest document keeps the words. A prefix as long as the window is that node itself, so the last step needs no sort:
partial aggregates have found the node's smallest document already.

Documents of equal word sequences are collapsed before: only the one with the smallest doc_id enters, and the others
with a window or more lose every word.

Defined cases: a null or empty text has no words; texts shorter than the window lose nothing; very long texts are
scanned whole; rows that repeat a doc_id are cut each by its own text and never count as smaller than each other; rows
with a null doc_id are kept as they are; an empty table gives no rows; other columns pass through `deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsafe.llm import _shared
from docsafe.llm._words import grams, mix, words

WINDOW = 50
#: Suffixes that one group may bring to a task.
MOST = 1 << 15
#: Words of the grams that end a prefix, in shares of the window; each step lengthens the prefixes of what did not fit.
STEPS = (0.5, 0.75, 1.0)
EMPTY = hashlib.sha256(b"").hexdigest()
SPANS = "array<struct<start:int,many:int>>"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values from each place on."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """Of each row: tid, n_words, the identity of its words, their digest, and the runs of suffixes of one group."""
    half = window // 2

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        outs = []
        ids, texts, tid = batch.column(0), batch.column(1), batch.column(2)
        for a, b in _shared.slices(texts):
            part = texts.slice(a, b - a)
            w = words(part)
            h, counts = w.hashes(), w.counts
            seq = np.zeros((2, len(part)), np.uint64)
            full = np.flatnonzero(counts)
            if len(full):
                place = np.arange(len(h), dtype=np.uint64) - np.repeat(w.bounds[:-1], counts).astype(np.uint64)
                for i, salt in enumerate((0x51ED270B1F8D4A35, 0x2545F4914F6CDD1D)):
                    seq[i, full] = np.add.reduceat(mix(h ^ mix(place * np.uint64(salt) + np.uint64(i + 1))), w.bounds[full])
            digests = [hashlib.sha256(b" ".join((x.as_py() or "").encode().split())).hexdigest() for x in part]
            gid, first, many, owner = [np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64)]
            if (counts >= window).any():
                least = _sliding_min(grams(h, half), window - half + 1)
                place = np.arange(len(least))
                own = np.searchsorted(w.bounds, place, "right") - 1
                inside = place + window <= w.bounds[own + 1]
                place, own, least = place[inside], own[inside], least[inside]
                cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])]))
                gid, owner = least[cut].view(np.int64), own[cut]
                first = (place[cut] - w.bounds[owner]).astype(np.int32)
                many = np.diff(np.append(cut, len(place))).astype(np.int32)
            at = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (gid, first, many)]
            outs.append(pa.RecordBatch.from_arrays([ids.slice(a, b - a), tid.slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(seq[0].view(np.int64)), pa.array(seq[1].view(np.int64)), pa.array(digests), *lists], ["doc_id", "tid", "n_words", "seq_a", "seq_b", "sha256", "gid", "first", "many"]))
        return pa.Table.from_batches(outs).combine_chunks().to_batches()[0]

    return _shared.arrow_map(docs.select("doc_id", "text", "tid"), run, "doc_id long, tid long, n_words long, seq_a long, seq_b long, sha256 string, gid array<long>, first array<int>, many array<int>")


def _matrix(texts: pa.ChunkedArray, many: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the runs, a row of word hashes each; the run and the place in it of every suffix."""
    w = words(texts)
    h = w.hashes()
    run = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    start = w.bounds[:-1][run] + place
    return np.lib.stride_tricks.sliding_window_view(h, window)[start], run, place


def _tree(suffixes: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Whether each suffix's window also starts in a smaller document: the deep nodes of the suffixes' tree."""
    n = len(suffixes)
    keys = np.ascontiguousarray(suffixes.astype(">u8")).view(f"V{8 * window}").ravel()
    order = np.argsort(keys, kind="stable")
    ordered = suffixes[order]
    equal = ordered[1:] == ordered[:-1]
    common = np.where(equal.all(axis=1), window, equal.argmin(axis=1))
    heads = np.flatnonzero(np.concatenate([[True], common < window]))
    least = np.minimum.reduceat(docs[order], heads)
    out = np.empty(n, bool)
    out[order] = docs[order] > np.repeat(least, np.diff(np.append(heads, n)))
    return out


def _sized(rows: DataFrame, keys: list[str], most: int, tag: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups (keys) that more than one document has, with lo, the least of these: those of groups of at most
    `most` suffixes, and those of larger ones. Hot groups are few, `most` suffixes or more each, and are told apart first,
    so that no task gathers one."""
    sizes = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("many").alias("n")).where("lo < hi").drop("hi")
    sizes = _shared.written(sizes, tag)
    hot, fit = sizes.where(F.col("n") > most).drop("n"), sizes.where(F.col("n") <= most).drop("n")
    if not (many := hot.count()):
        return rows.join(fit, keys), None
    hot = _shared.small(hot, 40 * many)
    return rows.join(hot, keys, "left_anti").join(fit, keys), rows.join(hot, keys)


def _cut(joined: DataFrame, window: int) -> DataFrame:
    """The text of each run: gid, wide, doc_id, tid, first, many, text."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [] for k in ("gid", "wide", "doc_id", "tid", "first", "many", "text")}
        ids, tid, texts, found = batch.column("doc_id").to_pylist(), batch.column("tid").to_pylist(), batch.column("text"), batch.column("runs")
        for a, b in _shared.slices(texts):
            w = words(texts.slice(a, b - a))
            raw = w.data.tobytes()
            for i in range(a, b):
                low = w.bounds[i - a]
                for r in found[i].as_py():
                    s, e = low + r["first"], low + r["first"] + r["many"] + window - 1
                    for k in ("gid", "wide", "first", "many"):
                        cols[k].append(r[k])
                    cols["doc_id"].append(ids[i])
                    cols["tid"].append(tid[i])
                    cols["text"].append(raw[w.starts[s] : w.ends[e - 1]])
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)], list(cols))

    return _shared.arrow_map(joined.select("doc_id", "tid", "text", "runs"), cut, "gid long, wide boolean, doc_id long, tid long, first int, many int, text binary")


def _lengthened(pieces: DataFrame, gram: int, window: int) -> DataFrame:
    """pieces cut anew where the least gram of `gram` words changes: gid and sub are two hashes of that gram. At the whole
    window the gram is all of a suffix, and the text stays behind."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        many = batch.column("many").to_numpy().astype(np.int64)
        w = words(batch.column("text"))
        h, raw = w.hashes(), w.data.tobytes()
        piece = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
        start = w.bounds[:-1][piece] + place
        gid, sub = (_sliding_min(grams(x, gram), window - gram + 1)[start] for x in (h, mix(h ^ np.uint64(0x9FB21C651E98DF25))))
        change = np.ones(len(piece), bool)
        change[1:] = (piece[1:] != piece[:-1]) | (gid[1:] != gid[:-1]) | (sub[1:] != sub[:-1])
        cut = np.flatnonzero(change)
        n = np.diff(np.append(cut, len(piece)))
        first = batch.column("first").to_numpy()[piece[cut]] + place[cut]
        low, high = w.starts[start[cut]].tolist(), w.ends[start[cut] + n + window - 2].tolist()
        text = [b"" if gram == window else raw[a:b] for a, b in zip(low, high, strict=True)]
        owner = pa.array(piece[cut])
        return pa.RecordBatch.from_arrays([pa.array(gid[cut].view(np.int64)), pa.array(sub[cut].view(np.int64)), batch.column("doc_id").take(owner), batch.column("tid").take(owner), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(text, pa.binary())], ["gid", "sub", "doc_id", "tid", "first", "many", "text"])

    return _shared.arrow_map(pieces.select("doc_id", "tid", "first", "many", "text"), run, "gid long, sub long, doc_id long, tid long, first int, many int, text binary")


def _trees(pieces: DataFrame, window: int, most: int) -> DataFrame:
    """doc_id, tid, start, many: suffixes of the groups gid whose window a smaller document has; one subtree a group."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shared.groups(batches, ["gid"]):
            gid, many = table.column("gid").to_numpy(), table.column("many").to_numpy().astype(np.int64)
            ids, tid, first = table.column("doc_id").to_numpy(), table.column("tid").to_numpy(), table.column("first").to_numpy().astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
            total = np.concatenate([np.add.reduceat(many, heads), [most]])
            start = held = 0
            for i, e in enumerate([*heads[1:], len(gid)]):
                held += total[i]
                if held + total[i + 1] > most:  # whole groups only
                    s, start, held = start, int(e), 0
                    suffixes, run, place = _matrix(table.column("text").slice(s, e - s), many[s:e], window)
                    hit = np.flatnonzero(_tree(suffixes, ids[s:e][run], window))
                    hit = hit[np.lexsort((first[s:e][run[hit]] + place[hit], tid[s:e][run[hit]], ids[s:e][run[hit]]))]
                    row, at = s + run[hit], first[s:e][run[hit]] + place[hit]
                    if len(row):
                        change = (ids[row][1:] != ids[row][:-1]) | (tid[row][1:] != tid[row][:-1]) | (at[1:] != at[:-1] + 1)
                        cut = np.flatnonzero(np.concatenate([[True], change]))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[row[cut]]), pa.array(tid[row[cut]]), pa.array(at[cut].astype(np.int32)), pa.array(np.diff(np.append(cut, len(row))).astype(np.int32))], ["doc_id", "tid", "start", "many"])

    return _shared.mapped(pieces.select("gid", "doc_id", "tid", "first", "many", "text").repartition("gid").sortWithinPartitions("gid"), trees, "doc_id long, tid long, start int, many int")


def _known(docs: DataFrame) -> DataFrame:
    """doc_id, text, and tid, which tells rows of one doc_id apart: rows alike in both are the same row here."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid"))


def repeats(docs: DataFrame, window: int = WINDOW, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(scan, spans). scan: a row for each row with doc_id, tid, n_words, sha256, copy (its words are those of a smaller
    document). spans: doc_id, tid, spans: starts and counts of windows that also start in a smaller document."""
    docs = _known(docs)
    scan = _shared.written(_scan(docs, window), "scan")
    classes = scan.where(f"n_words >= {window} and doc_id is not null").groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    known = _shared.look_up(scan, _shared.written(classes, "classes"), ["seq_a", "seq_b"], "n", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)))
    runs = known.where(F.col("rep") == F.col("doc_id")).select("doc_id", "tid", F.explode(F.arrays_zip("gid", "first", "many")).alias("r")).select("r.gid", "doc_id", "tid", "r.first", "r.many")
    runs = _shared.written(runs, "runs")
    fit, hot = _sized(runs, ["gid"], most, "shared")
    named = fit.withColumn("wide", F.lit(False)) if hot is None else fit.withColumn("wide", F.lit(False)).unionByName(hot.withColumn("wide", F.lit(True)))
    wanted = _shared.written(named.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("gid", "first", "many", "wide")).alias("runs")), "wanted")
    # what a document is wanted for grows with the input and is never broadcast; texts are dealt by document once
    pieces = _cut(docs.join(wanted.hint("merge"), ["doc_id", "tid"]), window)
    if hot is None:
        hits = _trees(pieces, window, most)
    else:
        pieces = _shared.written(pieces, "pieces")
        hits, level = _trees(pieces.where("not wide"), window, most), pieces.where("wide")
        for share in STEPS[1:]:
            gram = round(share * window)
            cut = _shared.written(_lengthened(level, gram, window), "lengthened")
            fit, level = _sized(cut, ["gid", "sub"], most, "shared")
            if gram < window:
                hits = hits.unionByName(_trees(fit, window, most))
                if level is None:
                    break
            else:  # a group is a node
                found = fit if level is None else fit.unionByName(level)
                hits = hits.unionByName(found.where("doc_id > lo").select("doc_id", "tid", F.col("first").alias("start"), "many"))
    spans = hits.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("start", "many")).cast(SPANS).alias("spans"))
    return known.select("doc_id", "tid", "n_words", "sha256", "copy"), _shared.written(spans, "spans")


def _keep(texts: pa.Array, spans: pa.Array, window: int) -> Iterator[tuple[bytes, int, bytes]]:
    """Of each text: its kept words joined by one space, how many went, and the text without the words that went."""
    for a, b in _shared.slices(texts):
        w = words(texts.slice(a, b - a))
        raw = w.data.tobytes()
        for i in range(a, b):
            low, high = int(w.bounds[i - a]), int(w.bounds[i - a + 1])
            change = np.zeros(high - low + 1, np.int64)
            for s in spans[i].as_py() or ():
                change[min(s["start"], high - low)] += 1
                change[min(s["start"] + s["many"] + window - 1, high - low)] -= 1
            gone = np.cumsum(change[:-1]) > 0
            starts, ends = w.starts[low:high], w.ends[low:high]
            kept = np.flatnonzero(~gone)
            joined = b" ".join([raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)])
            # a stretch that goes takes the white space after it along
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            base, end = int(w.offsets[i - a]), int(w.offsets[i - a + 1])
            out, at = [], base
            for s, e in edges.reshape(-1, 2).tolist():
                out.append(raw[at : starts[s]])
                at = int(starts[e]) if e < high - low else end
            out.append(raw[at:end])
            yield joined, int(gone.sum()), b"".join(out)


def digests(docs: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    scan, spans = repeats(docs, window, most)
    hit = _known(docs).join(spans.hint("merge"), ["doc_id", "tid"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(hashlib.sha256(j).hexdigest(), n) for j, n, _ in _keep(batch.column("text"), batch.column("spans"), window)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "tid", "after", "removed"])

    cut = _shared.arrow_map(hit.select("doc_id", "tid", "text", "spans"), run, "doc_id long, tid long, after string, removed long").distinct()
    copy = F.col("copy")
    return scan.join(cut, ["doc_id", "tid"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("after", "sha256")).alias("kept_sha256"),
    )


def deduplicate(docs: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """docs with the repeated words cut from text; a document that loses all its words goes."""
    scan, spans = repeats(docs, window, most)
    gone = scan.where("copy").select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), F.lit(True).alias("_copy")).distinct()
    marks = gone.join(spans.select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), "spans"), ["_doc", "_tid"], "full")
    marks = _shared.written(marks, "marks")
    columns = docs.columns
    same = (docs["doc_id"] == marks["_doc"]) & (F.xxhash64(docs["text"]) == marks["_tid"])
    joined = docs.join(marks.hint("merge"), same, "left").where("_copy is null").drop("_doc", "_tid", "_copy")
    at = columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts, spans_ = batch.column(at), batch.column(len(columns))
        touched = np.flatnonzero(spans_.is_valid().to_numpy(zero_copy_only=False))
        new, alive = texts.to_pylist(), np.ones(len(texts), bool)
        take = pa.array(touched)
        for i, (joined_words, _, text) in zip(touched, _keep(texts.take(take), spans_.take(take), window), strict=True):
            new[i], alive[i] = text.decode(), bool(joined_words)
        cols = [batch.column(i) for i in range(len(columns))]
        cols[at] = pa.array(new, texts.type)
        return pa.RecordBatch.from_arrays(cols, columns).filter(pa.array(alive))

    return _shared.arrow_map(joined, run, docs.schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same by the words of every window.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word, len(w) AS n FROM d),
a AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS run FROM t),
b AS (SELECT doc_id, i, word, i + 50 <= n AND min(doc_id) OVER (PARTITION BY run, i + 50 <= n) < doc_id AS known FROM a),
c AS (SELECT *, bool_or(known) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM b),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
