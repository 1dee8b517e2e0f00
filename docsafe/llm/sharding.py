"""Sharding by vector bin packing.

The things to place are groups of equal texts, each a vector of bytes, words and rows. A group goes whole to one shard;
only a group that is larger than a shard in one of the three is split, by the digest of its rows, into as many parts as
make each part fit. A group or part is placed where the dot product of its vector with the shards' residual capacity is
highest, from the largest down.

Groups of at least a `fineness`-th of a shard number at most 3 * shards * fineness whatever the corpus: they are placed
first, on the driver. All smaller groups are placed in lots of some LOT groups by the hash of their text, one task a lot:
each lot has its share, in proportion to what it holds, of the capacity that the large ones left, and fills it by the
same rule. So every lot is balanced to within one of its smallest groups, and no task sees more than a lot.

The law is `bytes`: sizes near equal. Defined cases: a null text counts as an empty one in its group and has no bytes;
ties go to the lower shard; repeated rows and doc_ids, and null doc_ids, are placed each; very long texts are one row
and cannot be split; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsafe.llm import _shared

SHARDS = 40
FINENESS = 128
#: Small groups that one task places.
LOT = 1 << 16
ROW_BYTES = 16
#: Bytes are the law; words and rows decide where bytes leave a choice.
WEIGHTS = (5000.0, 10.0, 1.0)


def place(vectors: np.ndarray, left: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each row of vectors (bytes, words, rows, in shards): largest first, to the highest weighted dot
    product with what is left of every shard's capacity, which is updated. Bytes weigh most, since they are the law."""
    out = np.empty(len(vectors), np.int32)
    pull = vectors * weights
    for i in np.lexsort((np.arange(len(vectors)), -vectors[:, 0])):
        best = int(np.argmax(left @ pull[i]))
        out[i] = best
        left[best] -= vectors[i]
    return out


def _lots(groups: DataFrame, left: np.ndarray, unit: np.ndarray) -> DataFrame:
    """text_digest and shard of the groups (lot, text_digest, size, words, n), each lot placed in its share of left."""
    free = np.maximum(left, 0)
    share = free / np.maximum(free.sum(axis=0), 1e-12)

    def lot(table: pa.Table) -> pa.Table:
        table = table.sort_by("text_digest")
        vectors = np.stack([table.column(c).to_numpy().astype(float) for c in ("size", "words", "n")], axis=1) / unit
        at = place(vectors, share * vectors.sum(axis=0))
        return pa.table({"text_digest": table.column("text_digest"), "shard": pa.array(at, pa.int32())})

    _shared.ship(groups.sparkSession)
    return groups.groupBy("lot").applyInArrow(lot, "text_digest string, shard int")


def shard(docs: DataFrame, shards: int = SHARDS, fineness: int = FINENESS) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, size, words, text_crc32, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long").alias("words"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("text_digest"),
    )
    rows = _shared.written(rows.withColumn("own_digest", F.sha2(F.concat_ws("/", "text_digest", F.col("doc_id").cast("string")), 256)), "rows")
    groups = _shared.written(rows.groupBy("text_digest").agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "words", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    unit = np.array([max(total[c], 1) / shards for c in ("size", "words", "n")])
    vector = [F.col(c) / float(u) for c, u in zip(("size", "words", "n"), unit, strict=True)]
    widest = F.greatest(*vector)
    # their widest shares add up to 3 * shards at most: under 3 * shards * fineness rows
    found = groups.where(widest * fineness >= 1).orderBy("text_digest").collect()
    left = np.ones((shards, 3))
    parts = []
    for r in found:
        v = np.array([r["size"], r["words"], r["n"]]) / unit
        k = max(1, min(int(np.ceil(v.max() - 1e-9)), r["n"]))
        parts += [(r["text_digest"], i, k, v / k) for i in range(k)]
    spark = docs.sparkSession
    at = place(np.array([p[3] for p in parts]).reshape(-1, 3), left)
    large = spark.createDataFrame([(d, i, k, int(s)) for (d, i, k, _), s in zip(parts, at, strict=True)], "text_digest string, part int, parts int, shard int")
    number = lambda c, m: F.pmod(F.conv(F.substring(c, 1, 12), 16, 10).cast("long"), m)
    whole = rows.join(F.broadcast(large.where("part = 0").select("text_digest", "parts")), "text_digest", "left")
    big = whole.where("parts is not null").withColumn("part", number("own_digest", F.col("parts")).cast("int")).join(F.broadcast(large.drop("parts")), ["text_digest", "part"])
    small = groups.where(widest * fineness < 1)
    lots = max(1, -(-(total["groups"] - len(found)) // LOT))
    placed = _shared.written(_lots(small.withColumn("lot", number("text_digest", F.lit(lots))), left, unit), "placed")
    # none of the small groups has more than a few thousandths of the rows
    rest = whole.where("parts is null").join(placed, "text_digest")
    columns = ["doc_id", "size", "words", "text_crc32", "own_digest", "shard"]
    out = big.select(*columns).unionByName(rest.select(*columns))
    return _shared.running(out, ["shard"], F.col("own_digest"), F.lit(1).cast("long"), "slot", total["n"]).drop("own_digest")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
