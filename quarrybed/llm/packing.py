"""Tokenise documents and pack them into fixed windows by the online sum-of-squares rule."""

from __future__ import annotations

import gc
import struct
import zlib
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, written

WINDOW, END_ID = 4096, 2
#: Pieces dealt to one packing task, on average; the number of tasks follows the input.
LANE = 65536


#: Lower-case Latin-1 letters, which no normaliser changes; and the characters that stand for their bytes.
_SMALL = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
LATIN_SMALL = {ord(c): "a" for c in _SMALL}
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHAR = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
BYTE_CHARS = {ord(c): "".join(_BYTE_CHAR[b] for b in c.encode()) for c in _SMALL}


class WordMemo(dict):
    """Ids by chunk of text between spaces, as packed little-endian 32-bit integers.

    Kept in two generations, so that its size is bounded.

    The tokenizer's splits never cross white space, and a trailing comma or full stop after a
    letter is a piece of its own, so a chunk's ids are those of its parts. (A letter that the
    normalisers turn into a letter and a mark is no such letter.)
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok, self.limit, self.old = Tokenizer.from_file(path), limit, {}
        self.split = self.tok.model.tokenize

    def plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if len(chunk) > 64:
                return self.pack(self.plain(chunk))
            if len(chunk) > 1 and chunk[-1] in ",." and normalize("NFC", chunk[-2]).lower().isalpha():
                ids = self[chunk[:-1]] + self[chunk[-1]]
            elif chunk.isalpha() and (chunk.isascii() or chunk.translate(LATIN_SMALL).isascii()):
                ids = self.pack([t.id for t in self.split(chunk.translate(BYTE_CHARS))])  # one piece already normalised
            else:
                ids = self.pack(self.plain(chunk)) if chunk else b""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as the tokenizer gives them without special tokens, packed."""
        if "<|" in text:  # a special token's own spelling: the tokenizer finds those before it lower-cases
            return self.pack(self.plain(text))
        try:
            text.encode("latin-1")
            low = text.lower()
        except UnicodeEncodeError:
            low = text.encode().lower().decode()
        low = low.replace("\n", " ").replace("\t", " ")
        return b"".join(map(self.__getitem__, low.split(" ")))


_MEMOS: dict[str, WordMemo] = {}


def memo(path: str) -> WordMemo:
    """One memo a worker process, kept over its tasks."""
    if path not in _MEMOS:
        _MEMOS[path] = WordMemo(path)
    return _MEMOS[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Cut each document's ids (and its end id) into windows and a rest: id, start, length, ids_crc32, doc_tokens."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        gc.disable()  # the memo holds no cycles
        words, last = memo(tokenizer), WordMemo.pack([end_id])
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = words.encode(text) + last
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    for column, value in zip(out, (key, at, len(piece) // 4, zlib.crc32(piece), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long")


class SumOfSquares:
    """Online bin packing: levels[h] counts the windows filled to h, 0 < h < window.

    A piece goes to the level (or a new window) after which the sum of squared counts is
    least; ties go to the fuller window.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) of a piece."""
        n, w = self.levels, self.window
        best, at = (2 * int(n[size]) + 1, 0) if size < w else (0, 0)
        if size < w:
            low = n[1 : w - size + 1]
            cost = 2 * (n[1 + size : w + 1] - low) + 2  # the window leaves level h for h + size
            cost[-1] -= 1  # a full window is no longer counted
            cost[low == 0] = np.iinfo(np.int64).max
            h = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[h] <= best:
                at = h + 1
        if at:
            which = self.open[at].pop()
            n[at] -= 1
        else:
            which, self.made = self.made, self.made + 1
        if at + size < w:
            n[at + size] += 1
            self.open[at + size].append(which)
        return which, at


def pack_lane(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows and offsets of pieces, in the order given."""
    packer = SumOfSquares(window)
    placed = np.array([packer.place(int(n)) for n in lengths], np.int64).reshape(-1, 2)
    return placed[:, 0], placed[:, 1]


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, lane: int = LANE) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id; null text counts as empty, so it is the end id
    alone. Whole windows are cut from its start and fill a sequence each; the rest is packed.
    Pieces are dealt to ceil(pieces / lane) lanes by a hash of the id, the start and the ids, packed in
    the order of id and start (a null id first); of levels with one cost the fuller wins.
    Repeated rows are packed as often as they occur; they share a lane, which grows with them.
    A very long text is encoded whole. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    cut = written(pieces(docs, tokenizer, id_col, text_col, window, end_id), "pieces")
    lanes = max(1, -(-cut.count() // lane))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "start", "ids_crc32"], na_position="first", kind="stable")
        which, at = pack_lane(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=pdf["lane"].to_numpy(np.int64) * (1 << 32) + which, offset=at)[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = cut.withColumn("lane", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(lanes)))
    packed = dealt.groupBy("lane").applyInPandas(pack, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
