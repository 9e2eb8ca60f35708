"""Near copies of a corpus: SimHash finds candidates, the exact Jaccard similarity of shingles decides.

Candidates are found as in ``simhash``: points of the popcount embedding meet in the cells of
its grid, by the Manhattan bound, then by the exact distance of their fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, partitions, small_batches, text_or_empty, written
from .components import connected_components
from .simhash import _blocks, fingerprint, grid_cells, ordered_bits
from .suffix_dedup import _mix

WORDS, RADIUS, SIMILAR = 5, 14, (4, 5)
#: Pairs that a point yields in a cell at first, the nearest ones; the others follow where they can still connect something.
FIRST = 2
#: 64-bit words of a sketch, pairs of points that are compared at once.
MARKS, HELD_PAIRS = 8, 1 << 18
#: Links up to which the components are one task's.
ONE_TASK = 1 << 19
#: Points for which a table without texts gets a file.
NARROW = 10_000


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """Distinct shingles of a text, its words as in ``fingerprint``; fewer words are one shingle, none are none."""
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def similar(a: set, b: set) -> bool:
    """Jaccard similarity of at least SIMILAR; two texts without words are alike."""
    both = len(a & b)
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def sketch(found: set[bytes]) -> np.ndarray:
    """Parities of the shingles dealt to 64 * MARKS bits: two sketches differ in no more bits than their sets have shingles apart."""
    bits = np.bincount([xxhash.xxh64_intdigest(x) % (64 * MARKS) for x in found], minlength=64 * MARKS) & 1 if found else np.zeros(64 * MARKS, np.int64)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def size_bands(size: np.ndarray) -> np.ndarray:
    """Bands of shingle counts: counts that allow the similarity are in one band or in neighbouring ones."""
    edges, top = [1], int(size.max(initial=0))
    while edges[-1] <= top:
        edges.append(edges[-1] * SIMILAR[1] // SIMILAR[0] + 1)
    return np.searchsorted(edges, size, "right")


def spare_blocks(points: int, radius: int = RADIUS, fill: int = 1 << 20) -> int:
    """Blocks of counts on which a cell agrees, so that cells of so many points hold about ``fill`` on average before bands part them. Every choice is exact."""
    spare = 1
    while spare < 8 and points > fill * 2 ** (48 * spare / (radius + spare)):
        spare += 1
    return spare


#: Cells of a fingerprint: those of the popcount embedding.
bit_cells = grid_cells


def band_cells(fps: np.ndarray, size: np.ndarray, radius: int, spare: int) -> list[np.ndarray]:
    """The cells of the embedding in a point's own band and in the next one: pairs within the radius whose counts allow the similarity meet."""
    band = size_bands(size)
    return [_mix(c.view(np.uint64) + _mix((band + step).astype(np.uint64) + np.uint64(1))).view(np.int64) for c in bit_cells(fps, radius, spare) for step in (0, 1)]


def first_met(cell: np.ndarray, fps: np.ndarray, size: np.ndarray, radius: int, spare: int) -> list:
    """For each cell, of which a point is given: the test for pairs that meet in it and in no cell before, so that a pair is one cell's."""
    masks = [np.bitwise_or.reduce(np.array(chosen, np.uint64)) for chosen in combinations(_blocks(radius + spare), spare)]
    kind = (np.stack(band_cells(fps, size, radius, spare)) == cell).argmax(axis=0)
    band = size_bands(size) + kind % 2

    def test(k: int, own: int):
        def only(apart, larger):
            good = size_bands(larger) == own
            for mask in masks[:k]:
                good &= (apart & mask) != 0
            return good

        return only

    return [test(k, own) for k, own in zip((kind // 2).tolist(), band.tolist())]


def cell_pairs(fp: np.ndarray, node: np.ndarray, size: np.ndarray, label: np.ndarray | None, marks: np.ndarray | None, radius: int, nearest: bool = True, only=None):
    """(u, v) of one cell, nodes ascending: points within the radius whose shingle counts allow the similarity.

    The Manhattan distance of the embedded points, which bounds that of the fingerprints, comes first.
    ``only`` (embedded points apart, larger count -> booleans) tells the pairs that are this cell's.
    Without labels each point is paired with the FIRST of those before it whose fingerprints
    are nearest; if it has more, it and all of them are paired with themselves. With labels it
    is paired with those before it that have another label and whose sketch (a row of marks)
    is not too far from its own: the ``nearest`` one by sketch, or all.
    """
    raw, low = fp.view(np.uint64), ordered_bits(fp)
    step = max(1, min(256, HELD_PAIRS // max(1, len(fp))))
    for i in range(0, len(fp), step):
        j = min(i + step, len(fp))
        near = np.flatnonzero(np.bitwise_count(low[i:j, None] ^ low[None, :j]).ravel() <= radius)
        rows, cols = near // j + i, near % j
        far = np.bitwise_count(raw[rows] ^ raw[cols]).astype(np.int64)
        good = (cols < rows) & (far <= radius) & (SIMILAR[1] * np.minimum(size[rows], size[cols]) >= SIMILAR[0] * np.maximum(size[rows], size[cols]))
        if only is not None:
            good[good] = only(low[rows[good]] ^ low[cols[good]], np.maximum(size[rows[good]], size[cols[good]]))
        if label is not None:
            good &= label[rows] != label[cols]
        rows, cols, far = rows[good], cols[good], far[good]
        if label is not None:
            far = np.zeros(len(rows), np.int64)
            for m in marks.view(np.uint64).T:
                far += np.bitwise_count(m[rows] ^ m[cols])
            good = (SIMILAR[1] + SIMILAR[0]) * far <= (SIMILAR[1] - SIMILAR[0]) * (size[rows] + size[cols])
            rows, cols, far = rows[good], cols[good], far[good]
            if not nearest:
                yield node[cols], node[rows]
                continue
        order = np.lexsort((cols, far, rows))
        rows, cols = rows[order], cols[order]
        late = np.arange(len(rows)) - np.searchsorted(rows, rows) >= (FIRST if label is None else 1)
        more = np.unique(np.concatenate((rows[late], cols[np.isin(rows, rows[late])]))) if label is None else np.zeros(0, np.int64)
        yield np.concatenate((node[cols[~late]], node[more])), np.concatenate((node[rows[~late]], node[more]))


def _candidates(points: DataFrame, labelled: bool, radius: int, spare: int, nearest: bool = True) -> DataFrame:
    """Distinct (u, v) of all cells; points: node, fp, size and, for labelled ones, label and m0, m1, ..."""
    names = ["node", "fp", "size", *(["label", *(f"m{k}" for k in range(MARKS))] if labelled else [])]

    def file(batches):
        for b in batches:
            cells = band_cells(b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), radius, spare)
            for c in cells:
                yield pa.RecordBatch.from_arrays([pa.array(c), *b.columns], ["cell", *names])

    def meet(batches):
        held = None
        for b in batches:
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(names) + 1)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            first = np.flatnonzero(np.concatenate(([True], now[0][1:] != now[0][:-1]))) if len(now[0]) else np.zeros(1, np.int64)
            yield from of(now, first)
            held = [x[first[-1] :] for x in now]
        if held is not None and len(held[0]):
            yield from of(held, np.array([0, len(held[0])]))

    def of(now, cuts):
        us, vs, n = [], [], 0
        some = np.flatnonzero(np.diff(cuts) > 1)
        at = cuts[some]
        for a, z, only in zip(at, cuts[some + 1], first_met(now[0][at], now[2][at], now[3][at], radius, spare)):
            if z - a > 1:
                for u, v in cell_pairs(now[2][a:z], now[1][a:z], now[3][a:z], now[4][a:z] if labelled else None, np.stack([m[a:z] for m in now[5:]], axis=1) if labelled else None, radius, nearest, only):
                    us.append(u)
                    vs.append(v)
                    n += len(u)
                    if n > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                        us, vs, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    filed = points.select(*names).mapInArrow(file, ", ".join(f"{c} long" for c in ["cell", *names]))
    met = filed.repartition(max(partitions(points.sparkSession), 1), "cell").sortWithinPartitions("cell", "node")
    return met.mapInArrow(meet, "u long, v long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs whose texts are similar."""

    def run(batches):
        last, a = None, set()
        for b in batches:
            us, keep = b.column(0).to_pylist(), []
            for u, x, y in zip(us, b.column(2).to_pylist(), b.column(3).to_pylist()):
                if u != last:
                    last, a = u, shingles(x, words)
                keep.append(similar(a, shingles(y, words)))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.select(F.col("node").alias("u"), F.col("t").alias("x")), texts.select(F.col("node").alias("v"), F.col("t").alias("y"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Rows of docs, of each group of linked ones that with the smallest id (a null id last).

    Rows are linked if their fingerprints differ in at most ``radius`` bits and the Jaccard
    similarity of their word shingles, compared in full, is at least SIMILAR. Candidates are
    exact for the radius. Of rows alike in id and text one is left. In a dense group rows are
    compared with their nearest first, and pairs whose rows are connected already, or whose
    sketches are too far apart for the similarity, are not compared.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(docs.withColumn("near_node", F.monotonically_increasing_id()), "near-rows")
    texts = rows.select(F.col("near_node").alias("node"), text_or_empty(text_col).alias("t"))

    def run(batches):
        for b in batches:
            text = b.column(1).to_pylist()
            fps = np.array([fingerprint(t, words) for t in text], np.uint64).view(np.int64)
            sizes = np.array([len(shingles(t, words)) for t in text], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array(sizes)], ["node", "fp", "size"])

    points = written(texts.mapInArrow(run, "node long, fp long, size long"), "near-points")
    n = points.count()
    spare = spare_blocks(n, radius)
    # narrow tables of so many points, in no more files than that takes: each is a task, and on local disks three processes
    narrow = lambda df, name: written(df.coalesce(max(spark.sparkContext.defaultParallelism, n // NARROW)), name)
    pairs = narrow(_candidates(points, False, radius, spare), "near-pairs")
    tried = pairs.where("u != v")
    links = written(_verified(tried, texts, words), "near-links")
    parts = connected_components(links, small=ONE_TASK)
    dense = pairs.where("u = v").select(F.col("u").alias("node"))
    if not dense.isEmpty():

        def mark(batches):
            for b in batches:
                marks = np.array([sketch(shingles(t, words)) for t in b.column(1).to_pylist()], np.int64).reshape(-1, MARKS)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(m)) for m in marks.T)], ["node", *(f"m{k}" for k in range(MARKS))])

        marked = narrow(texts.join(dense, "node", "left_semi").mapInArrow(mark, "node long, " + ", ".join(f"m{k} long" for k in range(MARKS))).join(points, "node"), "near-marks")
        for nearest in (True, False):  # the nearest of what is apart, which joins most; then all that still is
            labelled = narrow(marked.join(parts, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "near-dense")
            more = narrow(_candidates(labelled, True, radius, spare, nearest).join(tried, ["u", "v"], "left_anti"), "near-pairs")
            if not more.isEmpty():
                tried = tried.unionByName(more)
                links = links.unionByName(narrow(_verified(more, texts, words), "near-links"))
                parts = connected_components(links, small=ONE_TASK)
    parts = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())  # components come without their smallest node
    named = narrow(rows.select("near_node", F.col(id_col).alias("id")).join(parts, F.col("near_node") == parts.node).drop("node"), "near-named")
    best = named.groupBy(F.col("component").alias("part")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "near_node")).alias("best"), F.count(F.lit(1)).alias("size"))
    gone = hot_join(named, narrow(best, "near-best"), [("component", "part")], "size", named.count()).where("near_node != best.near_node").select("near_node")
    return rows.join(gone, "near_node", "left_anti").select(*docs.columns)
