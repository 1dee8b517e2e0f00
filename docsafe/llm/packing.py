"""Packing by concatenate and cut.

The ids of all documents, each closed by one separator id, are one long line; sequence q holds its ids from
q * length on. Pass one encodes every document once and writes its ids with the partition and the running offset
inside it. Prefix sums over the partitions' totals (a row for each partition) turn these into global offsets, and pass
two cuts every document at the multiples of the length; its pieces are the boundary records. All sequences are full
but the last, so at most length - 1 places are padding in the whole corpus.

Defined cases: a null or empty text is the separator alone; very long texts cover many sequences; repeated rows and
ties are packed as separate documents; a null doc_id is carried as null; an empty table gives no pieces; other columns
are ignored. The string <|endoftext|> inside a text is the added token of that name, as the JSON form has it.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsafe.llm import _shared

LENGTH = 1024
SEPARATOR = 0
RANKS = "byte_bpe_50k.tiktoken"
#: The added token of byte_bpe_50k.json, which the ranks do not hold.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(ranks: str = RANKS):
    """The encoding of byte_bpe_50k.json: the same vocabulary and pattern, held as ranks, which encode about seven
    times as fast as the other library's form of it. Tests hold both against each other."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks) if "/" not in ranks else ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)


def width(ranks: str = RANKS) -> int:
    """Bytes that hold any id of the vocabulary."""
    return 2 if encoder(ranks).max_token_value < 1 << 16 else 4


def encoded(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, part, before (ids of the part before this document), ids (little-endian, unsigned, `width` bytes each), n."""
    kind = f"<u{width(ranks)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, before = encoder(ranks), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _shared.slices(texts):
                found = [np.append(code.encode_to_numpy(x.as_py() or "", allowed_special=set(SPECIAL)), SEPARATOR).astype(kind) for x in texts.slice(a, b - a)]
                n = np.array([len(x) for x in found], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(start), pa.array(n), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "part", "before", "n", "ids"])

    return _shared.mapped(docs.select("doc_id", "text"), run, "doc_id long, part int, before long, n long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked)."""
    table, kind = _shared.written(encoded(docs, ranks), "ids"), f"<u{width(ranks)}"
    totals = table.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # a row of 12 bytes for each partition of the scan: a million of them stay within the bound
    placed = table.join(_shared.small(bases, 12 * totals.count()), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
        first, last = at // length, (at + n - 1) // length
        pieces = last - first + 1
        row = np.repeat(np.arange(len(at)), pieces)
        seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low, high = np.maximum(seq * length, at[row]), np.minimum((seq + 1) * length, (at + n)[row])
        blobs = batch.column("ids").to_pylist()
        crc, out, held, wide = np.empty(len(row), np.int64), [], -1, b""
        for k, (r, s, e) in enumerate(zip(row.tolist(), (low - at[row]).tolist(), (high - at[row]).tolist(), strict=True)):
            if r != held:
                held, wide = r, np.frombuffer(blobs[r], kind).astype("<u4").tobytes()
            crc[k] = zlib.crc32(wide[4 * s : 4 * e])
            if with_ids:
                out.append(np.frombuffer(wide[4 * s : 4 * e], "<u4").astype(np.int32))
        cols = {"doc_id": batch.column("doc_id").take(pa.array(row)), "start": pa.array(low - at[row]), "length": pa.array(high - low), "ids_crc32": pa.array(crc), "doc_tokens": pa.array(n[row]), "sequence_id": pa.array(seq), "offset": pa.array(low - seq * length)}
        if with_ids:
            cols["ids"] = pa.array(out, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return _shared.arrow_map(placed, cut, schema + (", ids array<int>" if with_ids else ""))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
