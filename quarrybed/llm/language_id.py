"""Language ID by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_share, slices, small_batches, utf8_buffers

#: Units a direction, byte embedding, bytes that a lane of the network answers for, bytes it reads before and after them, positions in a training step.
HIDDEN, EMBED, SEGMENT, MARGIN, STEP = 8, 6, 192, 32, 64
#: The sample that is learned from: labelled rows and bytes at most, and bytes of the longest row that is taken. Rows are taken whole.
SAMPLE_ROWS, SAMPLE_BYTES, ROW_BYTES = 6000, 1 << 25, 1 << 22


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the squashing function of gates and candidates, in place."""
    x /= np.abs(x) + 1
    return x


def _slope(s: np.ndarray) -> np.ndarray:
    """Its slope where it has the value s."""
    return (1 - np.abs(s)) ** 2


class Network:
    """Gated recurrent units, one layer each way, and a softmax at every position.

    z = (1 + s(Wz [h; x])) / 2, r = (1 + s(Wr [h; x])) / 2, c = s(Wc [r h; x]),
    h' = z h + (1 - z) c with s(x) = x / (1 + |x|).
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        f = lambda *shape, s=0.3: (r.standard_normal(shape) * s).astype(np.float32)
        bias = np.repeat(np.array([1.0, 1.0, 0.0]), hidden)[:, None]
        self.p = {
            "emb": f(embed, 256, s=0.5),
            "w": f(2, 3 * hidden, hidden + embed),  # rows: update gate, reset gate, candidate
            "b": np.stack((bias, bias)).astype(np.float32),
            "v": f(len(labels), 2 * hidden),
            "vb": np.zeros((len(labels), 1), np.float32),
        }

    def states(self, x: np.ndarray, inside: np.ndarray | None = None, keep: bool = False):
        """x: positions x lanes of bytes -> states (directions x positions x hidden x lanes) and gates (z, r, c).

        Positions that are not ``inside`` leave a state of zero, as before a text's first byte.
        """
        p, h = self.p, self.hidden
        steps, n = x.shape
        kind = p["w"].dtype
        out = np.empty((2, steps, h, n), kind)
        gates = np.empty((2, steps, 3 * h, n), kind) if keep else None
        cut = None if inside is None else ~inside.all(axis=1)
        for d in (0, 1):
            w = p["w"][d]
            table = w[:, h:] @ p["emb"] + p["b"][d]  # what each byte adds
            u, uc = np.ascontiguousarray(w[: 2 * h, :h]), np.ascontiguousarray(w[2 * h :, :h])
            state = np.zeros((h, n), kind)
            for t in range(steps - 1, -1, -1) if d else range(steps):
                a = table.take(x[t], axis=1)
                zr, c = a[: 2 * h], a[2 * h :]
                zr += u @ state
                _soft(zr)
                zr *= 0.5
                zr += 0.5
                c += uc @ (zr[h:] * state)
                _soft(c)
                new = out[d, t]
                np.subtract(state, c, out=new)
                new *= zr[:h]
                new += c
                if cut is not None and cut[t]:
                    new *= inside[t]
                state = new
                if keep:
                    gates[d, t] = a
        return out, gates

    def _logits(self, out: np.ndarray) -> np.ndarray:
        h, v = self.hidden, self.p["v"]
        logits = np.matmul(v[:, :h], out[0])
        logits += np.matmul(v[:, h:], out[1])
        logits += self.p["vb"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def probabilities(self, x: np.ndarray, inside: np.ndarray | None = None, first: int = 0, last: int | None = None) -> np.ndarray:
        """positions (first to last) x labels x lanes."""
        return self._logits(self.states(x, inside)[0][:, first:last])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over positions of lanes with labels y, and its gradients, by backpropagation through time."""
        p, h = self.p, self.hidden
        steps, n = x.shape
        out, gates = self.states(x, keep=True)
        emb = np.stack([row[x] for row in p["emb"]], axis=1)  # positions x embed x lanes
        prob = self._logits(out)
        cols = np.arange(n)
        loss = float(-np.log(prob[:, y, cols] + 1e-9).mean())
        prob[:, y, cols] -= 1
        prob /= steps * n
        g = {k: np.zeros_like(a) for k, a in p.items()}
        both = np.concatenate((out[0], out[1]), axis=1)
        g["v"] = np.einsum("tln,thn->lh", prob, both, optimize=True)
        g["vb"] = prob.sum(axis=(0, 2))[:, None]
        d_both = np.matmul(p["v"].T, prob)
        d_emb = np.zeros_like(emb)
        zero = np.zeros((h, n), out.dtype)
        for d in (0, 1):
            w, carry = p["w"][d], zero
            wg, wc = w[: 2 * h], w[2 * h :]
            for k in reversed(range(steps)):
                t = steps - 1 - k if d else k
                prev = (out[d, t + 1] if d else out[d, t - 1]) if k else zero
                z, r, c = gates[d, t, :h], gates[d, t, h : 2 * h], gates[d, t, 2 * h :]
                dh = d_both[t, d * h : (d + 1) * h] + carry
                dc = dh * (1 - z) * _slope(c)
                d_reset = wc[:, :h].T @ dc  # of r h
                dg = np.concatenate((dh * (prev - c) * 0.5 * _slope(2 * z - 1), d_reset * prev * 0.5 * _slope(2 * r - 1)))
                g["w"][d, : 2 * h] += dg @ np.concatenate((prev, emb[t])).T
                g["w"][d, 2 * h :] += dc @ np.concatenate((r * prev, emb[t])).T
                g["b"][d, : 2 * h] += dg.sum(axis=1, keepdims=True)
                g["b"][d, 2 * h :] += dc.sum(axis=1, keepdims=True)
                carry = dh * z + wg[:, :h].T @ dg + d_reset * r
                d_emb[t] += wg[:, h:].T @ dg + wc[:, h:].T @ dc
        for e in range(emb.shape[1]):
            g["emb"][e] = np.bincount(x.ravel(), weights=d_emb[:, e].ravel(), minlength=256)
        return loss, g

    def train(self, pieces: list[bytes], y: list[int], rounds: int = 260, batch: int = 384, step: int = STEP, rate: float = 0.03, seed: int = 11) -> Network:
        """Adam over random segments; short pieces are repeated to fill a segment; labels drawn evenly by the root of their counts."""
        r = np.random.default_rng(seed)
        y = np.array(y)
        weight = 1 / np.sqrt(np.bincount(y, minlength=len(self.labels))[y])
        weight /= weight.sum()
        m = {k: np.zeros_like(a) for k, a in self.p.items()}
        s = {k: np.zeros_like(a) for k, a in self.p.items()}
        for i in range(1, rounds + 1):
            chosen = r.choice(len(y), batch, p=weight)
            x = np.empty((step, batch), np.int64)
            for j, k in enumerate(chosen):
                piece = np.frombuffer(pieces[k], np.uint8)
                at = r.integers(0, max(1, len(piece) - step + 1))
                x[:, j] = np.resize(piece[at : at + step], step)
            _, g = self.gradients(x, y[chosen])
            size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1.0, 1.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                s[k] = 0.99 * s[k] + 0.01 * a * a
                lr = rate * min(1.0, 2.0 * (1 - i / (rounds + 1)))
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT, margin: int = MARGIN) -> np.ndarray:
        """Mean of the probabilities over all positions of each document: documents x labels.

        A text is cut into segments of so many bytes, so that many are read side by side. A
        lane begins ``margin`` bytes before its segment and ends as many after it, so the states
        of each position come from at least so much of the text on either side, or from its end.
        """
        sizes = np.diff(offsets)
        counts = -(-sizes // segment)
        own = np.repeat(np.arange(len(sizes)), counts)
        total = np.zeros((len(sizes), len(self.labels)))
        first = np.cumsum(counts) - counts
        at = (np.arange(len(own)) - first[own]) * segment  # of the segment in its text
        padded = np.concatenate((data, np.zeros(1, np.uint8)))
        place = np.arange(-margin, segment + margin)[:, None]
        for k in range(0, len(own), 1024):
            doc, a = own[k : k + 1024], at[k : k + 1024]
            p = a + place
            inside = (p >= 0) & (p < sizes[doc])
            x = padded[np.where(inside, offsets[doc] + p, len(data))].astype(np.intp)
            probs = self.probabilities(x, inside, margin, margin + segment)
            sums = np.einsum("tln,tn->nl", probs, inside[margin : margin + segment].astype(np.float32), optimize=True)
            np.add.at(total, doc, sums)
        return total / np.maximum(sizes, 1)[:, None]


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    low = data | 32
    count = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))))
    some = count[offsets[1:]] > count[offsets[:-1]]
    for k in np.flatnonzero(~some & (np.diff(offsets) > 0)):
        some[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return some


def held_out(id_col: str, mod: int, rest: int):
    """crc32 of the id as text, modulo ``mod``, is ``rest``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)) == rest, F.lit(False))


def training_texts(docs: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, n_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[str]]:
    """A bounded sample of labelled rows that are not held out: whole texts, the first by a hash of the id, ``rows`` of them and ``n_bytes`` at most."""
    h, size = F.xxhash64(F.col(id_col)), F.octet_length(text_col)
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 4, 2) & (size > 0) & (size <= ROW_BYTES))
    usable = labelled.where(sample_share(h, labelled, rows)).select(h.alias("h"), size.alias("n"), F.col(label_col).alias("y"), F.col(text_col).alias("t"))
    sizes = usable.select("h", "n").orderBy("h", "n").limit(rows).collect()
    taken = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), n_bytes, "right"))
    if not taken:
        return [], []
    some = usable.where(F.col("h") <= sizes[taken - 1]["h"]).orderBy("h", "n", "y", "t").limit(taken).collect()
    return [r["t"].encode() for r in some], [r["y"] for r in some]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS) -> Network | None:
    """A network learned from a bounded sample of whole labelled texts (see ``training_texts``); None without any."""
    pieces, names = training_texts(docs, id_col, text_col, label_col, rows)
    labels = sorted(set(names))
    if not labels:
        return None
    return Network(labels).train(pieces, [labels.index(n) for n in names])


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (the pooled probability of lang_pred).

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned; of
    equal probabilities the first label in order wins. Whole texts count, however long.
    Each row stands alone: repeated rows repeat, an empty table gives no rows, other columns
    are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = utf8_buffers(b.column(2))
            names, scores = [], []
            for i, j in slices(offsets, 1 << 20):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if network is None:
                    names += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                known, probs = _letters(part, off), network.pooled(part, off)
                best = probs.argmax(axis=1)
                names += [network.labels[k] if ok else "und" for k, ok in zip(best.tolist(), known)]
                scores += np.where(known, np.clip(probs[np.arange(j - i), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, 4, 2).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
