"""SimHash near-dedup: fingerprints, a popcount embedding, a grid join and components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, partitions, small_batches, text_or_empty, written
from .components import connected_components

SEED, BITS = 42, 64
#: Two-bit segments: their bit counts are the coordinates of the embedding.
SEGMENT = 2


def fingerprint(text: str | None, words: int = 4, seed: int = SEED) -> int:
    """64-bit SimHash: bit b is set if it is set in over half of the hashes of the shingles.

    A-Z is lower-cased, words are runs of anything but ASCII white space, a text with fewer
    words than a shingle is one shingle; no words give zero.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        starts, ends = [0], [len(joined)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate(([0], gaps[: len(gaps) - words + 1] + 1)).tolist()
        ends = np.concatenate((gaps[words - 1 :], [len(joined)])).tolist()
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(starts)
    for k in range(0, n, 1 << 15):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)])], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def _popcounts(fps: np.ndarray) -> np.ndarray:
    """Bit counts by two-bit segment: 32 coordinates of 0 to 2 a fingerprint, packed two bits each."""
    x = fps.view(np.uint64)
    odd = np.uint64(0x5555555555555555)
    return (x & odd) + ((x >> np.uint64(1)) & odd)


def _blocks(parts: int) -> list[np.uint64]:
    """Masks that cut the 32 segments into as many runs."""
    cuts = [round(32 * k / parts) for k in range(parts + 1)]
    return [np.uint64(((1 << 2 * (b - a)) - 1) << 2 * a) for a, b in zip(cuts, cuts[1:])]


def grid_cells(fps: np.ndarray, radius: int, spare: int) -> list[np.ndarray]:
    """Cells of the embedding in which a fingerprint is filed, one array for each choice of blocks.

    A Manhattan distance up to ``radius`` touches at most that many of ``radius + spare``
    blocks of segments, so two points that near agree on all counts of some ``spare``
    blocks: every pair within range meets in the cell of such a choice.
    """
    counts, masks = _popcounts(fps), _blocks(radius + spare)
    out = []
    for k, chosen in enumerate(combinations(masks, spare)):
        x = counts & np.bitwise_or.reduce(np.array(chosen, np.uint64))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out.append((x ^ (x >> np.uint64(29))).view(np.int64))
    return out


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed counts: |x - y| of two-bit fields of 0 to 2, summed."""
    even, one = np.uint64(0x3333333333333333), np.uint64(0x1111111111111111)
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for shift in (0, 2):
        x, y = (a >> np.uint64(shift)) & even, (b >> np.uint64(shift)) & even
        d = x + (one * np.uint64(4)) - y  # each nibble holds 4 + difference: no borrow
        high = (d >> np.uint64(2)) & one  # 1 where the difference is not negative
        size = (d & (high * np.uint64(3))) + ((one - high) * np.uint64(4) - (d & ((one - high) * np.uint64(15))))
        total += np.bitwise_count(size & one) + 2 * np.bitwise_count((size >> np.uint64(1)) & one).astype(np.int64)
    return total


def ordered_bits(fps: np.ndarray) -> np.ndarray:
    """The embedding in unary: a segment's set bits moved to its low end, so that counts are as many bits apart as their Manhattan distance."""
    x, odd = fps.view(np.uint64), np.uint64(0x5555555555555555)
    low, high = x & odd, (x >> np.uint64(1)) & odd
    return low | high | ((low & high) << np.uint64(1))


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of one cell's links: points within the radius, by the lower bound first.

    Breadth-first: a point that has been reached leaves the pool, so that a group of near
    copies costs about its size, not its square, and never emits its pairs.
    """
    pool = np.arange(len(fps))
    counts, raw, out = _popcounts(fps), fps.view(np.uint64), []
    while len(pool) > 1:
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            p = queue.pop()
            near = _manhattan(counts[pool], counts[p]) <= radius
            near[near] = np.bitwise_count(raw[pool[near]] ^ raw[p]) <= radius
            if near.any():
                out += [(p, q) for q in pool[near]]
                queue += pool[near].tolist()
                pool = pool[~near]
    return out


SMALL_CELL = 48


def _cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells; rows are sorted by cell. Small cells together, by shifting; others one by one."""
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(first, len(cell)))
    us, vs = [], []
    keep = np.repeat((size > 1) & (size <= SMALL_CELL), size)
    c, x = cell[keep], fp[keep]
    counts, raw = _popcounts(x), x.view(np.uint64)
    for d in range(1, min(SMALL_CELL, len(c))):
        i = np.flatnonzero(c[d:] == c[:-d])
        if not len(i):
            break
        i = i[_manhattan(counts[i], counts[i + d]) <= radius]
        i = i[np.bitwise_count(raw[i] ^ raw[i + d]) <= radius]
        us.append(x[i])
        vs.append(x[i + d])
    for k in np.flatnonzero(size > SMALL_CELL):
        x = fp[first[k] : first[k] + size[k]]
        pairs = np.array(_links(x, radius), np.int64).reshape(-1, 2)
        us.append(x[pairs[:, 0]])
        vs.append(x[pairs[:, 1]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(us or none), np.concatenate(vs or none)


def spare_blocks(points: int, radius: int, fill: int = 256) -> int:
    """Blocks on which a cell agrees, so that cells of so many distinct fingerprints hold about ``fill`` on average.

    A segment's count has 1.5 bits of information. For a radius of 4: 2 of 6 blocks (15 cells a
    fingerprint, some 2^16 cells each) up to 2^24 points, 3 of 7 (35, 2^20) up to 2^28, 4 of 8
    (70, 2^24) up to 2^32. Every choice is exact; it decides how much work a cell is.
    """
    spare = 2
    while spare < 8 and points > fill * 2 ** (48 * spare / (radius + spare)):
        spare += 1
    return spare


def grid_join(fps: DataFrame, radius: int = 4, spare: int = 2) -> DataFrame:
    """Links (fp_u, fp_v) that connect all distinct fingerprints within a Hamming distance.

    Each cell yields a spanning forest of its links, at most one row a point. A cell's points
    are distinct fingerprints alike in ``spare`` blocks of counts; see ``spare_blocks``.
    """
    spark = fps.sparkSession
    n_choices = len(list(combinations(range(radius + spare), spare)))

    def file(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            cells = grid_cells(x, radius, spare)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.tile(x, n_choices))], ["cell", "fp"])

    def link(batches):
        held_c, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            c = np.concatenate((held_c, b.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((held_f, b.column(1).to_numpy(zero_copy_only=False)))
            last = int(np.searchsorted(c, c[-1])) if len(c) else 0
            held_c, held_f = c[last:], f[last:]
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in _cell_links(c[:last], f[:last], radius)], ["fp_u", "fp_v"])
        if len(held_c):
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in _cell_links(held_c, held_f, radius)], ["fp_u", "fp_v"])

    filed = fps.select("fp").mapInArrow(file, "cell long, fp long")
    met = filed.repartition(max(partitions(spark), 1), "cell").sortWithinPartitions("cell", "fp")
    return met.mapInArrow(link, "fp_u long, fp_v long").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, spare: int | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id (smallest id reachable).

    Null and blank texts have fingerprint zero and link like any other. Rows with one
    fingerprint are one point, so groups of copies never meet pairwise. A null id takes part
    with its text, but a component is named by its smallest id that is not null (null if
    there is none). Repeated rows repeat in the result; a very long text is read whole. An
    empty table gives no rows. Other columns are ignored, whatever their names. A fingerprint
    or component with a large share of all rows is joined by broadcast, the others by shuffle.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    points = written(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "points")
    n_points, n_rows = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    links = grid_join(points.select("fp"), radius, spare_blocks(n_points, radius) if spare is None else spare)
    # the nodes of the components are fingerprints; their names come afterwards
    parts = connected_components(links.select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")))
    linked = written(points.join(parts, points.fp == parts.node).select("fp", "rep", "rows", "component"), "linked")
    roots = points.join(linked.select(F.col("component").alias("fp")).distinct(), "fp").select("fp", "rep", "rows", F.col("fp").alias("component"))
    linked = linked.unionByName(roots)  # components come without their smallest node
    names = written(linked.groupBy(F.col("component").alias("part")).agg(F.min("rep").alias("name"), F.count(F.lit(1)).alias("size")), "names")
    named = hot_join(linked, names, [("component", "part")], "size", n_points).select(F.col("fp").alias("fp0"), "name", "rows")
    alone = points.join(named.select(F.col("fp0").alias("fp")), "fp", "left_anti").select(F.col("fp").alias("fp0"), F.col("rep").alias("name"), "rows")
    labels = written(named.unionByName(alone), "labels")
    out = hot_join(fps, labels, [("fp", "fp0")], "rows", n_rows)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("name").alias("component_id"))
