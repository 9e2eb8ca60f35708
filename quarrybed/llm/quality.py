"""Quality classifier: a linear-chain conditional random field labels every line good or bad."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_share, slices, small_batches, text_or_empty, utf8_buffers
from .language_id import held_out

#: The sample that is learned from: labelled documents and their lines at most. Documents are taken whole, in runs of so many neighbouring lines.
SAMPLE_ROWS, SAMPLE_LINES, RUN = 4000, 200_000, 64
#: Share of a document's length that its label speaks for at least, rounds of learning lines' labels, and steps in each.
SPOKEN, PHASES, STEPS = 0.9, 4, 60
THRESHOLD = 0.3
NAMES = ("upper", "symbol", "bar", "digit", "other", "space", "repeat", "near_repeat", "seen", "length", "word", "tail")
_UPPER, _SYMBOL, _BAR, _DIGIT, _OTHER, _SPACE = range(6)
#: Shares of these kinds are scaled and capped at 1, as a few such bytes already tell.
_SCALE = (2, 8, 16, 1, 1, 1)
_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91] = _UPPER
for _c in b"!#$%&*+/<=>@[\\]^_`{}~":
    _CLASS[_c] = _SYMBOL
_CLASS[ord("|")] = _BAR
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _OTHER
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = _SPACE
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from sums of mixed (byte, place in range) values: equal ranges, equal hashes."""
    n = end - start
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    x = (data[start[own] + place].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER + place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
    at = np.concatenate(([0], np.cumsum(n)))
    return total[at[1:]] - total[at[:-1]] + n.astype(np.uint64) * _MULTIPLIER


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every line; an empty text is one empty line, a final newline ends its line."""
    breaks = np.flatnonzero(data == 10)
    sizes = np.diff(offsets)
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:][sizes > 0] - 1] = True
    inner = breaks[~last[breaks]]
    start = np.concatenate((offsets[:-1], inner + 1))
    doc = np.concatenate((np.arange(len(sizes)), np.searchsorted(offsets, inner, "right") - 1))
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.append(start[1:], offsets[-1])
    new = np.append(doc[1:] != doc[:-1], True)
    end = np.where(new, offsets[doc + 1], end)
    trimmed = (end > start) & (data[np.maximum(end - 1, 0)] == 10) if len(data) else np.zeros(len(start), bool)
    return doc, start, end - trimmed


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, lengths, features): shares of byte kinds, repeated words, repeated lines, lengths."""
    doc, start, end = lines_of(data, offsets)
    n = (end - start).astype(np.float64)
    kinds = _CLASS[data]
    shares = []
    for k in range(6):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        share = (total[end] - total[start]) / np.maximum(n, 1)
        shares.append(np.minimum(1, share * _SCALE[k]))
    word = (kinds != _SPACE) & (data != 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[start] = True
    before = np.concatenate(([False], word[:-1])) if len(data) else word
    begin = np.flatnonzero(word & (~before | edge[: len(data)]))
    after = np.concatenate((word[1:], [False])) if len(data) else word
    stop = np.flatnonzero(word & (~after | edge[1:])) + 1
    line = np.searchsorted(start, begin, "right") - 1
    hashed = _hashes(data, begin, stop)
    words = np.bincount(line, minlength=len(start))
    again = np.zeros(len(begin))
    again[1:] = (hashed[1:] == hashed[:-1]) & (doc[line[1:]] == doc[line[:-1]]) if len(begin) else 0
    # the same word within the four before it, in the same document
    close = np.zeros(len(begin), bool)
    for k in (2, 3, 4):
        if len(begin) > k:
            close[k:] |= (hashed[k:] == hashed[:-k]) & (doc[line[k:]] == doc[line[:-k]])
    per = np.maximum(words, 1)
    repeat = np.bincount(line, weights=again, minlength=len(start)) / per
    near = np.bincount(line, weights=close, minlength=len(start)) / per
    letters = np.bincount(line, weights=stop - begin, minlength=len(start))
    whole = _hashes(data, start, end)
    order = np.lexsort((start, whole, doc))
    seen = np.zeros(len(start))
    same = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (n[order][1:] > 20)
    seen[order[1:][same]] = 1
    tail = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(start), np.uint8)
    ended = ((tail == ord(".")) & (n > 0)).astype(np.float64)
    x = np.stack([*shares, repeat, near, seen, np.log1p(n) / 5, np.minimum(letters / per, 20) / 10, ended], axis=1)
    return doc, n, x.astype(np.float32)


def with_neighbours(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A line's own features, those of the line before and after it (zero beyond the text) and a constant."""
    same = np.concatenate(([False], doc[1:] == doc[:-1]))
    prev, nxt = np.zeros_like(x), np.zeros_like(x)
    prev[1:] = x[:-1] * same[1:, None]
    nxt[:-1] = x[1:] * same[1:, None]
    edges = np.stack((~same, ~np.append(same[1:], False), np.ones(len(x))), axis=1)
    return np.concatenate((x, prev, nxt, edges), axis=1).astype(np.float32)


class LineField:
    """The field: a weight vector for the log-odds of good, and scores of neighbouring labels."""

    def __init__(self, width: int):
        self.w = np.zeros(width)
        self.a = np.zeros((2, 2))  # a[i, j]: label i before label j

    @staticmethod
    def _pass(x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Log-odds that a message carries over one step."""
        return np.logaddexp(x + a[1, 1], a[0, 1]) - np.logaddexp(x + a[1, 0], a[0, 0])

    def messages(self, doc: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds of every line: all documents step together, longest first."""
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.append(first, len(doc)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        f, b = e.copy(), np.zeros(len(e))
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # documents of at least so many lines
        for t in range(1, steps):
            at = first[: live[t]] + t
            f[at] += self._pass(f[at - 1], self.a)
        for t in range(steps - 2, -1, -1):
            at = first[: live[t + 1]] + t
            b[at] = self._pass(e[at + 1] + b[at + 1], self.a.T)
        return f, b

    def marginals(self, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Probability of good, for every line."""
        f, b = self.messages(doc, x @ self.w)
        return 1 / (1 + np.exp(-np.clip(f + b, -40, 40)))

    def _pairs(self, e: np.ndarray, f: np.ndarray, b: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Expected numbers of neighbours labelled i and j."""
        left, right = f[pair], e[pair + 1] + b[pair + 1]
        joint = np.stack([self.a[u, v] + u * left + v * right for u in (0, 1) for v in (0, 1)])
        joint -= joint.max(axis=0, initial=-np.inf)
        joint = np.exp(joint)
        return (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)

    @staticmethod
    def _logistic(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def expected_labels(self, run: np.ndarray, doc: np.ndarray, e: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the lines, and of neighbours, nearest to the field's under which SPOKEN of each document's length agrees with its label.

        Lines are hidden: only documents are labelled. The nearest distribution shifts the
        log-odds of a document's lines alike, by as little as will do, which bisection finds.
        """
        pair = np.flatnonzero(run[1:] == run[:-1])
        n = len(y)
        whole = np.bincount(doc, weights=weight, minlength=n)
        low, high, shift = np.zeros(n), np.full(n, 24.0), np.zeros(n)
        sign = np.where(y == 1, 1.0, -1.0)
        for k in range(14):
            f, b = self.messages(run, e + (sign * shift)[doc])
            p = self._logistic(f + b)
            agree = np.bincount(doc, weights=np.where(y[doc] == 1, p, 1 - p) * weight, minlength=n) / whole
            enough = agree >= SPOKEN
            if k == 0:
                done = enough  # as it is
            high, low = np.where(enough, shift, high), np.where(enough, low, shift)
            shift = np.where(done, 0.0, (low + high) / 2)
        shifted = e + (sign * np.where(done, 0.0, high))[doc]
        f, b = self.messages(run, shifted)
        return self._logistic(f + b), self._pairs(shifted, f, b, pair)

    def fit(self, run: np.ndarray, doc: np.ndarray, x: np.ndarray, weight: np.ndarray, y: np.ndarray, rate: float = 0.3, ridge: float = 3e-5) -> LineField:
        """Expectation and maximisation: hidden labels of lines given their documents', then conditional likelihood by Adam.

        ``run`` and ``doc`` number the chain and document of each line, ``y`` has a label for
        each document. At first a line has its document's label.
        """
        x = x.astype(np.float64)
        pair = np.flatnonzero(run[1:] == run[:-1])
        wanted, seen = y[doc].astype(np.float64), np.zeros((2, 2))
        np.add.at(seen, (y[doc][pair], y[doc][pair + 1]), 1)
        n = len(y)
        m, s = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        for i in range(1, PHASES * STEPS + 1):
            e = x @ self.w
            if i > 1 and i % STEPS == 1:
                wanted, seen = self.expected_labels(run, doc, e, weight, y)
            f, b = self.messages(run, e)
            p = self._logistic(f + b)
            g = np.concatenate(((wanted - p) @ x - ridge * n * self.w, (seen - self._pairs(e, f, b, pair) - ridge * n * self.a).ravel())) / n
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            step = rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-9)
            self.w += step[:-4]
            self.a += step[-4:].reshape(2, 2)
        return self

    def document_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean of the lines' marginals, weighted by their lengths (an empty line weighs 1)."""
        doc, n, x = line_features(data, offsets)
        p = self.marginals(doc, with_neighbours(doc, x))
        weight = np.maximum(n, 1)
        size = len(offsets) - 1
        return np.bincount(doc, weights=p * weight, minlength=size) / np.bincount(doc, weights=weight, minlength=size)


WIDTH = 3 * len(NAMES) + 3


def training_lines(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, document, features, length) of all lines of a bounded sample of labelled documents that are not held out, and the documents' labels.

    The sample is the first ``rows`` labels by a hash of the id, as far as their documents have
    ``lines`` lines together; a broadcast of at most so many ids picks the documents, whose
    lines become features where they lie. Of texts that share an id the longest is taken.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = known.where(sample_share(F.xxhash64("doc_id"), known, rows))
    some = few.select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), text_or_empty(text_col).alias("t"))
    size = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1
    counted = texts.join(F.broadcast(some), "k").groupBy("k", "y").agg(F.max(size).cast("long").alias("n")).orderBy(F.xxhash64("k"), "k").collect()  # a row for each of at most ``rows`` labels
    taken = [(r["k"], r["y"]) for r, total in zip(counted, np.cumsum([r["n"] for r in counted])) if total <= lines]
    if not taken:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, WIDTH), np.float32), none, none
    chosen = docs.sparkSession.createDataFrame(taken, "k long, y int")
    whole = texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.max(F.struct(size.alias("n"), "t")).alias("best"))

    def run(batches):
        for b in batches:
            data, offsets = utf8_buffers(b.column(2))
            out, sizes = [], []
            for i, j in slices(offsets, 1 << 20):
                doc, n, x = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                full = with_neighbours(doc, x)
                for k in range(j - i):
                    a, z = np.searchsorted(doc, (k, k + 1))
                    out.append(full[a:z].tobytes())
                    sizes.append(np.maximum(n[a:z], 1).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(sizes, pa.binary())], ["k", "y", "x", "n"])

    found = sorted(whole.select("k", "y", "best.t").mapInArrow(run, "k long, y int, x binary, n binary").collect(), key=lambda r: r["k"])
    blocks = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in found]
    count = np.array([len(x) for x in blocks])
    doc = np.repeat(np.arange(len(blocks)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return np.cumsum(place % RUN == 0), doc, np.concatenate(blocks), np.concatenate([np.frombuffer(r["n"], np.float64) for r in found]), np.array([int(r["y"] == 1) for r in found], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> LineField:
    """A field learned from a bounded sample of whole labelled documents (see ``training_lines``); without any, one that gives every text 0.5."""
    small_batches(docs.sparkSession)
    run, doc, x, weight, y = training_lines(docs, labels, id_col, text_col, rows)
    field = LineField(WIDTH)
    return field.fit(run, doc, x, weight, y) if len(doc) else field


def score(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", carry: tuple = (), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score (probability of good), predicted (score >= threshold).

    A null text counts as empty: one empty line. Whole texts count, however long. Each row
    stands alone: repeated rows repeat, an empty table gives no rows, and other columns are
    ignored, whatever their names. ``carry`` keeps other columns, in a struct ``carried``.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = utf8_buffers(b.column(2))
            parts = [np.zeros(0)]
            for i, j in slices(offsets, 1 << 20):
                parts.append(field.document_scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            s = np.clip(np.concatenate(parts), 0, 1)
            columns = [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + ([b.column(3)] if carry else []), ["id", "held_out", "score", "predicted", *["carried"] * bool(carry)])

    more = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, 5, 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *more)
    kind = "id long, held_out boolean, score double, predicted int"
    if carry:
        kind += f", carried {docs.select(*carry).schema.simpleString()}"
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)
