"""What the operators of this subpackage share: written tables, prefix sums, components, grouped Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast by hint, by an estimate that callers take from the data first.
BROADCAST_BYTES = 24 << 20
#: Neighbours beyond which a node's edges are dealt to several tasks.
HUB = 1 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session, whose driver
    is its one executor, may go without it: it takes a temporary folder. Elsewhere its absence raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="docsafe-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/docsafe-{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: lineage ends there, a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` returned, once nothing that is still to run reads them."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, size: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated bytes are within the bound; else Catalyst shuffles."""
    return F.broadcast(df) if size <= bound else df


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner", most: int = 1 << 12) -> DataFrame:
    """rows joined with a table of one row a key. Keys that its column `count` says more than `most` rows have are told
    apart and broadcast, while they are few enough: no task gathers the rows of a hot key."""
    hot = table.where(F.col(count) > most)
    if not (many := hot.count()):
        return rows.join(table, keys, how)
    hot = small(hot, many * 16 * len(table.columns))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(table.where(F.col(count) <= most), keys, how))


#: Rows that one bucket of a running sum should hold.
BUCKET_ROWS = 1 << 16


def running(df: DataFrame, keys: list[str], order: Column, value: Column, into: str, rows: int) -> DataFrame:
    """Adds the sum of value over the rows of the same keys that come before in the order, gapless over hot keys.

    order must be a string of hexadecimal digits spread evenly (a digest): its first eight digits cut every key into
    buckets, whose totals are summed first; only the rows of one bucket of one key meet in a task. The number of buckets
    follows `rows`, the rows of df, so that a bucket holds some BUCKET_ROWS rows even where one key has them all. Sums run
    over the buckets of a key in one task: a row for each bucket of a key.
    """
    buckets = max(64, -(-rows // BUCKET_ROWS))
    df = df.withColumns({"_o": order, "_v": value})
    df = df.withColumn("_b", F.floor(F.conv(F.substring("_o", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("int"))
    totals = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    here = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    left = df.withColumn("_run", F.coalesce(F.sum("_v").over(here), F.lit(0)))
    renamed = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), "_base")
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = left.join(renamed, same, "left").withColumn(into, F.col("_base") + F.col("_run"))
    return joined.drop(*[f"_k{i}" for i in range(len(keys))], "_kb", "_base", "_run", "_b", "_o", "_v")


def components(links: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b) reaches; alternating large and small stars.

    Each round is two aggregations with partial sums; the driver sees counts and a checksum. The edges of a hub, a node of
    more than HUB neighbours, stay where they lie: the hubs' least neighbours are broadcast to them. Stars settle in
    some log2 of the longest path; `rounds` is far beyond that for any graph that fits a cluster, and reaching it raises.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    seen, before = None, None
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        many = seen is None or 2 * seen[0] > HUB  # fewer edges have no hub
        least = written(least, f"{tag}-least") if many else least
        edges = written(star(both.where("v > u"), least, many), f"{tag}-stars")
        remove(before, least if many else None)
        before = edges
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components of {tag} did not settle in {rounds} rounds")
    tree = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())


def star(upward: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """One large and one small star over edges (u, v > u), of which least knows m, the least of u's neighbourhood, and n."""
    total, most = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first() if hubs else (0, 0)
    split = max(HUB, total // 100_000)
    if most > split:
        hubs = least.where(F.col("n") > split).select("u", "m")  # at most 100,000 rows of 16 bytes whatever the graph
        plain = upward.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
        hot = upward.join(F.broadcast(hubs), "u")  # m comes along: no shuffle on the hub
        joined = plain.select("u", "v", "m").unionByName(hot.select("u", "v", "m"))
    else:
        joined = upward.join(least.select("u", "m"), "u")
    # large star: every larger neighbour hangs on the least of the neighbourhood
    large = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # small star: every smaller neighbour and the node itself hang on the least
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges (start, end) of an Arrow string or binary array, each of about `most` bytes, or one row."""
    n = len(texts)
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield start, end
        start = end


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key; several groups share a table, none is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in key:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
            if held:
                change[0] |= held[-1].column(k)[-1].as_py() != x[0]
        cuts = np.flatnonzero(change)
        if len(cuts) and (held or cuts[-1] > 0):
            last = int(cuts[-1])
            whole = [*held, batch.slice(0, last)] if last else held
            yield pa.Table.from_batches(whole)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that they can import it whatever their working folder."""
    sc = spark.sparkContext
    if getattr(sc, "_docsafe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="docsafe-code-")) / "docsafe_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json", ".npz"):
                z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(to))
    sc._docsafe_shipped = True


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with the package sent along."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return mapped(df, run, schema)
