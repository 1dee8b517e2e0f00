"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents with equal shingle sets are one class, and classes are what is compared. A signature has `coordinates` minima.
A pair is a candidate if at least `matches` coordinates agree. Each class posts itself under coordinate-value pairs; the
order of a class's pairs is rising frequency, and two classes that agree on `matches` of them share one of the first
`coordinates - matches + 1` (the prefix), so only those are posted, and those that occur once are not posted at all.
Within a block of a posting list a member's own lists are merged: collisions are counted over its short lists, the
prefix, and only members met there are looked up in its long lists, which the merge skips. Members that are connected
already are passed over.

Lists and groups of any size run in blocks: a block meets itself and the first block of its list, then only members
that are still apart from their list's largest component meet every block. So a group of n near copies costs about n
rows, its connecting links are found whole, and no task gathers more than two blocks, which are bounded in members and in
bytes. Links are confirmed on the full shingle sets; a component is what confirmed links connect.

Defined cases: a null, empty or wordless text has an empty set, n_shingles 0, and is linked with nothing; a text with
fewer words than a shingle has its whole word sequence as the one shingle; rows of one doc_id are one document, which is
linked with whatever any of them is linked with, and have one component_id; rows with a null doc_id are left alone with a
null component_id and kept true; an empty table gives no rows; other columns are ignored.
A pair of similarity 0.8 agrees on 64 coordinates 51.2 times on average (standard deviation 3.2), so 38 matches miss it
with a chance of about 4 in 100,000.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsafe.llm import _shared
from docsafe.llm._words import grams, mix, words

#: Members and bytes of a block; a task holds two blocks of one group at a time.
BLOCK = 512
BLOCK_BYTES = 32 << 20


def shingle_sets(texts: pa.Array, width: int, fold: bool = True) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    w = words(texts)
    h = w.hashes(fold)
    g = grams(h, width)
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(g[a : b - width + 1])
        elif b > a:
            yield mix(np.array([grams(h[a:b], int(b - a))[0] ^ np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """int32 minima, a row for each set; sets must not be empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), coordinates), np.int32)
    scale = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    for c in range(coordinates):
        out[:, c] = np.minimum.reduceat((flat * scale[c]) >> np.uint64(32), at).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, tid, n_shingles, set_a, set_b (together the identity of the set), signature (array of int; null if empty)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        outs = []
        ids, tid, texts = batch.column(0), batch.column(1), batch.column(2)
        for a, b in _shared.slices(texts):
            sets = list(shingle_sets(texts.slice(a, b - a), width))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sums = np.zeros((2, len(sets)), np.uint64)
            sig = [None] * len(sets)
            if len(full):
                kept = [sets[i] for i in full]
                flat, at = np.concatenate(kept), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                sums[0, full] = np.add.reduceat(mix(flat), at)
                sums[1, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                for i, row in zip(full, _signatures(kept, coordinates), strict=True):
                    sig[i] = row
            outs.append(pa.RecordBatch.from_arrays([ids.slice(a, b - a), tid.slice(a, b - a), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "tid", "n_shingles", "set_a", "set_b", "signature"]))
        return pa.Table.from_batches(outs).combine_chunks().to_batches()[0]

    return _shared.arrow_map(docs.select("doc_id", F.xxhash64("text").alias("tid"), "text"), run, "doc_id long, tid long, n_shingles long, set_a long, set_b long, signature array<int>")


#: Of a member and of those not yet connected: which of these it is linked with.
Links = Callable[[int, np.ndarray], np.ndarray]


def _connect(links: Links, start: np.ndarray) -> np.ndarray:
    """Smallest member index that each member reaches over links and equal start labels. Every member is asked once, and
    only for members that no other has reached."""
    n = len(start)
    label, alive = np.full(n, -1), np.ones(n, bool)
    order = np.argsort(start, kind="stable")
    bounds = np.append(np.flatnonzero(np.concatenate([[True], start[order][1:] != start[order][:-1]])), n)
    alike = np.empty(n, np.int64)
    alike[order] = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for seed in range(n):
        if not alive[seed]:
            continue
        queue = [seed]
        alive[seed] = False
        while queue:
            p = queue.pop()
            label[p] = seed
            found = order[bounds[alike[p]] : bounds[alike[p] + 1]]
            found = found[alive[found]]
            alive[found] = False
            queue += found.tolist()
            rest = np.flatnonzero(alive)
            if len(rest):
                found = links(p, rest)
                alive[found] = False
                queue += found.tolist()
    return label


def _spanning(members: DataFrame, payload: str, test: Callable[[pa.ChunkedArray], Links], tag: str, largest: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect within every group gid whatever test connects there.

    members: gid, node, nb (blocks of the group, at most largest), payload. test: payloads -> links.
    """
    if largest > 1:
        members = _shared.written(members, f"{tag}-members")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    # block 0 is dealt to every block of its group
    near = dealt.select("gid", F.explode(F.when(F.col("own") == 0, every).otherwise(F.array("own"))).alias("block"), "node", F.lit(0).cast("long").alias("root"), payload)
    links = _shared.written(_block_links(near, payload, test, False), f"{tag}-near")
    if largest <= 1:
        return links
    # groups of several blocks: members apart from the group's largest part meet every block
    parts = _shared.components(links.select("a", "b"), f"{tag}-parts").withColumnRenamed("node", "_node")
    named = dealt.where(F.col("nb") > 1).join(parts, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")
    sizes = named.groupBy("gid", "root").agg(F.count("*").alias("size"))
    split = sizes.groupBy("gid").agg(F.max_by("root", F.struct("size", "root")).alias("main"), (F.sum("size") - F.max("size")).alias("rest"), F.count("*").alias("parts")).where("parts > 1")
    named = named.join(split.withColumn("fars", F.ceil(F.col("rest") / block).cast("int")), "gid")
    apart = named.where("root <> main").select("gid", F.pmod(F.xxhash64("node", F.lit(1)), F.col("fars")).cast("int").alias("far"), F.explode(every).alias("other"), "node", "root", payload)
    others = named.select("gid", F.explode(F.sequence(F.lit(0), F.col("fars") - 1)).alias("far"), F.col("own").alias("other"), "node", "root", payload)
    both = apart.unionByName(others).select("gid", F.concat_ws("-", "far", "other").alias("block"), "node", "root", payload)
    return links.unionByName(_shared.written(_block_links(both, payload, test, True), f"{tag}-far"))


def _block_links(rows: DataFrame, payload: str, test: Callable[[pa.ChunkedArray], Links], rooted: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shared.groups(batches, ["gid", "block"]):
            gid, blk = table.column("gid").to_numpy(), table.column("block").to_numpy()
            ids, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
            data = table.column(payload)
            cuts = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (blk[1:] != blk[:-1])]))
            a, b = [], []
            for s, e in zip(cuts, [*cuts[1:], len(gid)], strict=True):
                s, e = int(s), int(e)
                own, at = np.unique(ids[s:e], return_index=True)
                start = roots[s:e][at] if rooted else np.arange(len(own))
                if len(own) < 2 or (rooted and (start == start[0]).all()):
                    continue
                label = _connect(test(data.slice(s, e - s).take(pa.array(at))), start)
                linked = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[linked])
                b.append(own[label[linked]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return _shared.mapped(rows.repartition("gid", "block").sortWithinPartitions("gid", "block"), run, "a long, b long")


def _agree(matches: int) -> Callable[[pa.ChunkedArray], Links]:
    """At least `matches` coordinates agree: posting lists of the block, merged with prefix and skip."""

    def test(column: pa.ChunkedArray) -> Links:
        sig = column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)
        n, wide = sig.shape
        if n <= 16:  # few members: all their lists at once
            count = (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
            return lambda p, rest: rest[count[p, rest] >= matches]
        keys = (np.arange(wide, dtype=np.int64) << 32)[None, :] | sig.view(np.uint32).astype(np.int64)
        _, lists, times = np.unique(keys, return_inverse=True, return_counts=True)
        lists = lists.reshape(n, wide)
        members = np.argsort(lists.ravel(), kind="stable") // wide
        ends = np.cumsum(times)
        order = np.argsort(times[lists] * wide + np.arange(wide)[None, :], axis=1)  # one order of lists for all members

        def links(p: int, rest: np.ndarray) -> np.ndarray:
            short, long = order[p, : wide - matches + 1], order[p, wide - matches + 1 :]
            posted = [members[ends[k] - times[k] : ends[k]] for k in lists[p, short] if times[k] > 1]
            if not posted:
                return rest[:0]
            count = np.bincount(np.concatenate(posted), minlength=n)[rest]
            met = np.flatnonzero(count)
            agreed = count[met] + (lists[rest[met]][:, long] == lists[p, long]).sum(axis=1)
            return rest[met[agreed >= matches]]

        return links

    return test


def _similar(percent: int) -> Callable[[pa.ChunkedArray], Links]:
    """Exact: 100 * shared >= percent * union of the full sets."""

    def test(column: pa.ChunkedArray) -> Links:
        sets = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(values), np.int64)

        def links(p: int, rest: np.ndarray) -> np.ndarray:
            # sets of too different a size cannot be alike enough
            near = rest[(100 * sizes[rest] >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes[rest])]
            if not len(near):
                return near
            own = place[at[p] : at[p + 1]]
            mark[own] = 1
            if 4 * sizes[near].sum() > len(place):
                total = np.concatenate([[0], np.cumsum(mark[place])])
                shared = total[at[near + 1]] - total[at[near]]
            else:
                shared = np.array([mark[place[at[i] : at[i + 1]]].sum() for i in near])
            mark[own] = 0
            return near[100 * shared >= percent * (sizes[near] + sizes[p] - shared)]

        return links

    return test


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = 64, matches: int = 38, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    sig = _shared.written(signatures(docs.select("doc_id", "text"), width, coordinates), "signatures")
    known = sig.where("doc_id is not null")
    several = _shared.written(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "several")
    repeated = not several.isEmpty()
    classes = known.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "tid")).alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"), F.count("*").alias("copies"))
    classes = _shared.written(classes.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "rep.doc_id", "rep.tid", "size", "copies", "signature"), "classes")
    posts = classes.select("node", F.posexplode("signature").alias("c", "v")).select("node", F.expr("shiftleft(cast(c as bigint), 32) | (cast(v as bigint) & 4294967295)").alias("gid"))
    often = _shared.written(posts.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1"), "often")
    prefix = coordinates - matches + 1
    shared = _shared.look_up(posts, often, ["gid"], "n")
    ranked = Window.partitionBy("node").orderBy("n", "gid")
    # pairs that occur once come first in the order and take up places of the prefix
    listed = shared.withColumn("place", F.row_number().over(ranked) + coordinates - F.count("*").over(Window.partitionBy("node"))).where(F.col("place") <= prefix)
    listed = _shared.written(listed.select("gid", "node"), "posts")
    sizes = _shared.written(listed.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").withColumn("nb", F.ceil(F.col("n") / block).cast("int")), "lists")
    most = sizes.agg(F.coalesce(F.max("nb"), F.lit(0))).first()[0]
    members = _shared.look_up(listed, sizes, ["gid"], "n").join(classes.select("node", "signature"), "node")
    rough = _shared.written(_shared.components(_spanning(members, "signature", _agree(matches), "agree", most, block), "rough"), "rough")
    sized = rough.join(classes.select("node", "doc_id", "tid", "size"), "node")
    groups = _shared.written(sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")), "groups")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    groups = groups.select("root", "n", blocks.alias("nb"))
    rows, most = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("nb"), F.lit(0))).first()
    sized = _shared.look_up(sized, groups, ["root"], "n").select("node", F.col("root").alias("gid"), "nb", "doc_id", "tid")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tid")).join(_shared.small(sized, 48 * rows), ["doc_id", "tid"])
    if repeated:  # one row of those alike
        texts = texts.groupBy("node").agg(*[F.first(c).alias(c) for c in ("gid", "nb", "text")])

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = batch.column("text")
        found = [s.tobytes() for a, b in _shared.slices(t) for s in shingle_sets(t.slice(a, b - a), width)]
        return pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("node"), batch.column("nb"), pa.array(found, pa.binary())], ["gid", "node", "nb", "shingles"])

    full = _shared.arrow_map(texts.select("gid", "node", "nb", "text"), sets, "gid long, node long, nb int, shingles binary")
    found = _shared.components(_spanning(full, "shingles", _similar(percent), "similar", most, block), "near")
    named = classes.select("node", "set_a", "set_b", "doc_id", "copies").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = _shared.written(named, "named")
    if repeated:
        named = _shared.written(_joined(known, several, named), "joined")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    table = named.join(least, "root").select("set_a", "set_b", "component", "copies")
    out = _shared.look_up(sig.select("doc_id", "n_shingles", "set_a", "set_b"), table, ["set_a", "set_b"], "copies", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    if repeated:  # a row without words goes where the document's other rows go
        own = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("_own"), F.count("*").alias("_n"))
        out = _shared.look_up(out, _shared.written(own, "own"), ["doc_id"], "_n", "left").withColumn("component_id", F.coalesce("_own", "component_id")).drop("_own", "_n")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _joined(known: DataFrame, several: DataFrame, named: DataFrame) -> DataFrame:
    """named with the roots of all classes that a doc_id of several rows has made one."""
    rows = known.where("n_shingles > 0").join(several, "doc_id", "left_semi").select("doc_id", "set_a", "set_b").distinct()
    rows = _shared.look_up(rows, named.select("set_a", "set_b", "root", "copies"), ["set_a", "set_b"], "copies").select("doc_id", "root")
    least = rows.groupBy("doc_id").agg(F.min("root").alias("b"))
    links = rows.join(least, "doc_id").select(F.col("root").alias("a"), "b")
    over = _shared.components(links, "documents").select(F.col("node").alias("root"), F.col("root").alias("_over"))
    return named.join(over, "root", "left").withColumn("root", F.coalesce("_over", "root")).drop("_over")


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2, percent=80)


#: The same by all pairs that share a shingle.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)"""
