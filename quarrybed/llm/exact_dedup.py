"""Exact dedup by an extendible-hash index kept on shared files.

Texts meet in the index and nowhere else: each map task chains what it has seen, so that copies leave it
as one entry; entries go to the owner of their key's range by the directory; owners insert
them in key order, chain texts whose keys collide, and compare bytes link by link.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, hot_join, partitions, small_batches, text_or_empty, written

#: Keys of a bucket, and slots of the directory at most; buckets grow beyond where the slots are used up.
CAPACITY, MAX_DEPTH = 65536, 16
#: Characters that a map task holds before it passes its entries on, and bytes that an owner task should get.
HELD, SHARE = 1 << 24, 1 << 27


class Directory:
    """Directory of an extendible hash: 2^depth slots, each pointing to a bucket.

    A bucket has a local depth; while one holds more than ``capacity`` keys it is split on
    its next leading bit, and the directory doubles when the bucket's depth is its own.
    """

    def __init__(self, capacity: int, max_depth: int):
        self.capacity, self.max_depth = capacity, max_depth
        self.depth, self.slots = 0, [(0, 0)]  # a bucket is (prefix, local depth)

    def load(self, cells: dict[int, int], cell_bits: int) -> Directory:
        """Split until no bucket is overfull, by key counts of cells of ``cell_bits`` leading bits."""
        sums: dict[tuple[int, int], int] = {}
        for cell, n in cells.items():
            for d in range(cell_bits + 1):
                key = (cell >> (cell_bits - d), d)
                sums[key] = sums.get(key, 0) + n
        todo = [(0, 0)]
        while todo:
            prefix, local = bucket = todo.pop()
            if sums.get(bucket, 0) <= self.capacity or local >= min(cell_bits, self.max_depth):
                continue
            if local == self.depth:
                self.slots = [b for b in self.slots for _ in (0, 1)]
                self.depth += 1
            halves = [(prefix * 2, local + 1), (prefix * 2 + 1, local + 1)]
            span = 1 << (self.depth - local - 1)
            first = prefix << (self.depth - local)
            for k, half in enumerate(halves):
                self.slots[first + k * span : first + (k + 1) * span] = [half] * span
            todo += halves
        self.overfull = any(sums.get(b, 0) > self.capacity for b in set(self.slots))
        return self

    def ranges(self) -> list[tuple[int, int, int]]:
        """(bucket number, first slot, slots) of each bucket, by key range."""
        out, at = [], 0
        while at < len(self.slots):
            n = 1 << (self.depth - self.slots[at][1])
            out.append((len(out), at, n))
            at += n
        return out

    def bucket(self, h: Column) -> Column:
        """Bucket number of a key, by its slot."""
        numbers = F.from_json(F.lit(str([b for b, _, n in self.ranges() for _ in range(n)])), "array<int>")
        slot = F.shiftrightunsigned(h, 64 - self.depth) if self.depth else F.lit(0)
        return F.element_at(numbers, (slot + 1).cast("int"))


class Link:
    """A text of a chain: largest id, rows with it, rows."""

    __slots__ = ("text", "best", "ties", "rows")

    def __init__(self, text: str, best, ties: int, rows: int):
        self.text, self.best, self.ties, self.rows = text, best, ties, rows

    def add(self, best, ties: int, rows: int) -> None:
        self.rows += rows
        if best == self.best:
            self.ties += ties
        elif self.best is None or (best is not None and best > self.best):
            self.best, self.ties = best, ties


def insert(chain: list[Link], text: str, best, ties: int, rows: int) -> bool:
    """Put a text in a chain: into the link whose bytes are the same, or (True) as a new one."""
    for link in chain:
        if link.text == text:
            link.add(best, ties, rows)
            return False
    chain.append(Link(text, best, ties, rows))
    return True


@dataclass
class Index:
    """The index: its directory and the bucket files. Rows: bucket, h, link, links (of the chain), sha, keep_id, ties, group_size."""

    directory: Directory
    table: DataFrame
    rows: int

    def probe(self, rows: DataFrame, h: str, sha: str) -> DataFrame:
        """Rows with the link of their text: the only one of the key's chain, or the one of its digest."""
        found = rows.withColumn("bucket", self.directory.bucket(F.col(h)))
        return hot_join(found, self.table.withColumnsRenamed({"sha": "sha0", "h": "h0", "bucket": "bucket0"}), [("bucket", "bucket0"), (h, "h0")], "chain_size", self.rows).where((F.col("links") == 1) | (F.col(sha) == F.col("sha0"))).drop("bucket0", "h0", "sha0")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int = MAX_DEPTH, key: Callable[[Column], Column] = F.xxhash64) -> Index:
    """Build the index of the distinct texts: bucket files in the shared folder, one range of keys an owner task.

    The directory is made from counts of distinct keys by leading bits, at most 2^max_depth
    of them; a bucket that is still overfull there stays one. ``capacity`` is by default as
    many keys as give each owner some buckets, CAPACITY at most. Owners read entries sorted
    by key, so that they hold one chain at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tasks = partitions(spark)
    keyed = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).withColumn("h", key(F.col("t")))
    keys = written(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("t")).alias("size")), "keys")
    n_keys, n_rows, n_bytes = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = capacity or min(CAPACITY, max(64, n_keys // (4 * tasks)))
    bits = min(max_depth, max(1, (4 * n_keys // capacity).bit_length()))
    counts = {r[0]: r[1] for r in keys.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).count().collect()}
    directory = Directory(capacity, max_depth).load(counts, bits)
    buckets = len(directory.ranges())
    owners = min(buckets, max(tasks, n_bytes // SHARE))
    id_kind = docs.select(id_col).schema[0].dataType.simpleString()

    def combine(batches):
        """Entries of a map task: equal texts of what it holds, as one."""
        chains: dict[int, list[Link]] = {}
        held, kind = 0, None

        def entries():
            links = [(h, link) for h, chain in chains.items() for link in chain]
            for k in range(0, len(links), 1000):
                part = links[k : k + 1000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in part], pa.int64()), pa.array([x.text for _, x in part], pa.string()), pa.array([x.best for _, x in part], kind), pa.array([x.ties for _, x in part], pa.int64()), pa.array([x.rows for _, x in part], pa.int64())],
                    ["h", "t", "best", "ties", "n"],
                )

        for b in batches:
            kind = b.column(0).type
            for best, text, h in zip(*(c.to_pylist() for c in b.columns)):
                if insert(chains.setdefault(h, []), text, best, 1, 1):
                    held += len(text) + 64
                if held > HELD:
                    yield from entries()
                    chains, held = {}, 0
        if chains:
            yield from entries()

    def own(batches):
        """Links of an owner's range, key by key: (bucket, h, link, links, t, ...)."""
        at, chain, out, size, kind = None, [], [], 0, None

        def rows():
            columns = list(zip(*out))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), kind, pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "h", "link", "links", "t", "keep_id", "ties", "group_size", "chain_size"])

        def close():
            total = sum(x.rows for x in chain)
            return [(*at, k + 1, len(chain), x.text, x.best, x.ties, x.rows, total) for k, x in enumerate(sorted(chain, key=lambda x: x.text))]

        for b in batches:
            kind = b.column(3).type
            for bucket, h, text, best, ties, n in zip(*(c.to_pylist() for c in b.columns)):
                if (bucket, h) != at:
                    out += close() if chain else []
                    size += sum(len(x.text) for x in chain)
                    at, chain = (bucket, h), []
                    if len(out) >= 1000 or size > HELD:
                        yield rows()
                        out, size = [], 0
                insert(chain, text, best, ties, n)
        if chain:
            out += close()
            yield rows()

    entries = keyed.select("id", "t", "h").mapInArrow(combine, f"h long, t string, best {id_kind}, ties long, n long").withColumn("bucket", directory.bucket(F.col("h")))
    owner = F.floor(F.col("bucket").cast("long") * owners / buckets).cast("int")
    dealt = entries.select("bucket", "h", "t", "best", "ties", "n").repartitionById(owners, owner).sortWithinPartitions("bucket", "h")
    links = dealt.mapInArrow(own, f"bucket int, h long, link int, links int, t string, keep_id {id_kind}, ties long, group_size long, chain_size long")
    links = links.select("h", "link", "links", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "ties", "group_size", "chain_size", "bucket")
    path = fresh_path(spark, "index")
    links.write.partitionBy("bucket").parquet(path)
    spark.createDataFrame([(s, b) for b, first, n in directory.ranges() for s in range(first, first + n)], "slot int, bucket int").coalesce(1).write.parquet(fresh_path(spark, "directory"))
    return Index(directory, spark.read.schema(links.schema).parquet(path), n_rows)


def _probed(docs: DataFrame, index: Index, id_col: str, text_col: str, key, *more: Column) -> DataFrame:
    t = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), key(t).alias("h"), F.unhex(F.sha2(t, 256)).alias("sha"), *more)
    return index.probe(rows, "h", "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int = MAX_DEPTH, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256, bucket, link.

    Equal texts are byte-identical ones; null counts as empty. The row with the largest id
    stays. Rows repeated with the same id and text are ties: all carry kept = true (the id
    stays); ``without_copies`` leaves one of them. A null id loses to any other; a group of
    null ids only keeps null. Very long texts are held one chain at a time. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    index = build_index(docs, id_col, text_col, capacity, max_depth, key)
    hit = _probed(docs, index, id_col, text_col, key)
    return hit.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "link")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int = MAX_DEPTH, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Rows of docs, of each group of equal texts one: a row with the largest id (any of them, if rows repeat that id and text).

    Nulls, empty tables and other columns as in ``exact_dedup``; all columns are kept as they are.
    """
    index = build_index(docs, id_col, text_col, capacity, max_depth, key)
    kept = _probed(docs, index, id_col, text_col, key, F.struct(*[docs[c] for c in docs.columns]).alias("row")).where(F.col("id").eqNullSafe(F.col("keep_id")))
    once = kept.where("ties = 1").select("row.*")
    if index.table.where("ties > 1").isEmpty():
        return once
    tied = kept.where("ties > 1").groupBy("bucket", "h", "link").agg(F.first("row").alias("row"))  # combined before its shuffle
    return once.unionByName(tied.select("row.*"))
