"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

A sequence of tokens is the encoding of its bytes if every adjacent pair of it is the
encoding of the pair's bytes. So each prefix of a piece of text has one last token, found
from the prefixes before it, and the encoding of any prefix is a chain of last tokens. The
transducer reads bytes; its state is the last token it has emitted and the bytes since. It
emits a token once every chain that a longer text could still extend passes through it,
which happens within the length of the longest token. States are made lazily, when they
are needed again.
"""

from __future__ import annotations

import array
import base64
import gc
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_BYTE = [bytes((k,)) for k in range(256)]


class State:
    """``tokens[k - 1]`` is the last token of the tail's prefix of length k, and ``chains[k]`` has
    the bits of the places where the tokens of that prefix end. ``alive`` has the places where a
    token that covers the rest of the tail and more may begin."""

    __slots__ = ("base", "tail", "tokens", "chains", "alive", "next", "final")

    def __init__(self, base: int, tail: bytes, tokens: list, chains: list, alive: list):
        self.base, self.tail = base, tail  # last token emitted (-1: none), bytes read since
        self.tokens, self.chains, self.alive = tokens, chains, alive
        self.next: dict[int, tuple] | None = None  # most states end a rare piece and lead nowhere
        self.final: tuple | None = None


class Transducer:
    """Merges compiled lazily; ``limit`` bounds the states and the remembered pairs."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000):
        self.ranks, self.limit = ranks, limit
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.starts = {t[:k] for t in ranks for k in range(len(t))}  # proper prefixes: bytes that a token may go on from
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the states made so far; they are made again when reached."""
        self.shared: dict[tuple[int, bytes], State] = {}  # states after a token was emitted
        self.states = 1
        self.start = State(-1, b"", [], [1], [0])

    def merged(self, data: bytes) -> list[int]:
        """Plain merging of lowest ranks first, for short strings."""
        parts = [data[k : k + 1] for k in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b encode to a, b."""
        got = self.pairs.get(a << 32 | b)
        if got is None:
            if len(self.pairs) >= 4 * self.limit:
                self.pairs.clear()
            x, y = self.token[a], self.token[b]
            got = self.pairs[a << 32 | b] = (x + y) not in self.ranks and self.merged(x + y) == [a, b]
        return got

    def step(self, state: State, byte: int) -> tuple:
        """(next state, tokens emitted) on a byte; made once, then looked up."""
        if state.next is None:
            state.next = {}
        elif made := state.next.get(byte):
            return made
        tail, tokens, chains = state.tail + _BYTE[byte], state.tokens, state.chains
        n, ranks, starts, token, chain_n, alive, common = len(tail), self.ranks, self.starts, None, 0, [], -1
        for at in state.alive:
            rest = tail[at:]
            if token is None and (token := ranks.get(rest)) is not None:
                before = tokens[at - 1] if at else state.base
                if before < 0 or self.follows(before, token):
                    chain_n = chains[at] | 1 << n
                else:
                    token = None
            if rest in starts:  # a longer text may still put a token here
                common &= chains[at]
                alive.append(at)
        alive.append(n)
        cut = (common & chain_n).bit_length() - 1
        tokens, chains = [*tokens, token], [*chains, chain_n]
        self.states += 1
        if not cut:
            made = state.next[byte] = (State(state.base, tail, tokens, chains, alive), ())
            return made
        out = self._path(tokens, chains[cut])
        key = (out[-1], tail[cut:])
        to = self.shared.get(key)
        if to is None:
            to = self.shared[key] = State(out[-1], tail[cut:], tokens[cut:], [c >> cut for c in chains[cut:]], [at - cut for at in alive])
        made = state.next[byte] = (to, out)
        return made

    @staticmethod
    def _path(tokens: list, ends: int) -> tuple:
        """The tokens that end at the places set in ``ends``, but for place 0."""
        return tuple([t for k, t in enumerate(tokens, 1) if ends >> k & 1])

    def finish(self, state: State) -> tuple:
        """Tokens still held when the piece ends."""
        if state.final is None:
            state.final = self._path(state.tokens, state.chains[-1])
        return state.final

    def run(self, data: bytes) -> tuple:
        """Tokens of one piece of text.

        A move is compiled when it is made for the second time; before, the rest of the piece
        is read with the same rules and without making states, as most moves never recur.
        """
        if self.states >= self.limit:
            self.forget()
        state, out = self.start, ()
        for k, byte in enumerate(data):
            moves = state.next
            if moves is None:
                moves = state.next = {}
            made = moves.get(byte)
            if made is None:
                moves[byte] = False
                return out + self.rest(state, data[k:])
            if made is False:
                del moves[byte]
                made = self.step(state, byte)
            state = made[0]
            if made[1]:
                out += made[1]
        return out + self.finish(state)

    def rest(self, state: State, data: bytes) -> tuple:
        """Tokens of what a state holds and the bytes that end the piece, without making states."""
        ranks, starts, base, alive = self.ranks, self.starts, state.base, state.alive
        n, text, tokens = len(state.tail), state.tail + data, state.tokens[:]
        begins = [(c ^ 1 << k).bit_length() - 1 for k, c in enumerate(state.chains)][1:]
        for n in range(n + 1, len(text) + 1):
            still, token = [], None
            for at in alive:
                rest = text[at:n]
                if token is None and (found := ranks.get(rest)) is not None:
                    before = tokens[at - 1] if at else base
                    if before < 0 or self.follows(before, found):
                        token = found
                        begins.append(at)
                if rest in starts:
                    still.append(at)
            still.append(n)
            tokens.append(token)
            alive = still
        out, at = [], len(text)
        while at:
            out.append(tokens[at - 1])
            at = begins[at - 1]
        out.reverse()
        return tuple(out)


#: The usual splitting pattern, and what it comes to on Latin-1 texts, which the plain engine reads faster.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\x0b\x0c\r \x85\xa0"
USUAL_LATIN = rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class Encoder(dict):
    """Tokens by piece, packed as little-endian 32-bit integers: the transducer's outputs,
    remembered in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 350_000):
        super().__init__()
        self.fst, self.limit, self.old = Transducer(ranks), limit, {}
        self.find = regex.compile(pattern).findall
        self.find_latin = re.compile(USUAL_LATIN).findall if pattern == USUAL else self.find

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            if len(data) > 256:
                return self.long(data)
            out = self.fst.run(data)
            ids = struct.pack(f"<{len(out)}I", *out)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def long(self, data: bytes) -> bytes:
        """A long piece, its tokens put out as they come."""
        parts, state = array.array("I"), self.fst.start
        for byte in data:
            state, out = self.fst.step(state, byte)
            parts.extend(out)
            if self.fst.states >= self.fst.limit:
                self.fst.forget()
        parts.extend(self.fst.finish(state))
        return np.array(parts, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_latin(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), "<u4")


class Utf8Stream:
    """Incremental UTF-8 decoding: feed bytes in any cuts, get text as soon as it is whole.

    The state is the bytes of a sequence begun and not ended. Malformed bytes become U+FFFD.
    """

    #: by lead byte: bytes in its sequence; 0 for bytes that can't begin one
    NEED = [1] * 128 + [0] * 66 + [2] * 30 + [3] * 16 + [4] * 5 + [0] * 11

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # the last lead byte: is its sequence whole?
                if self.NEED[byte] > back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


def decode(ids: np.ndarray, token: list[bytes], chunk: int = 8192):
    """Text of token ids, in pieces, by the UTF-8 state machine."""
    stream = Utf8Stream()
    for k in range(0, len(ids), chunk):
        yield stream.feed(b"".join(map(token.__getitem__, ids[k : k + chunk].tolist())))
    yield stream.end()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process, kept over its tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and (with_ids) ids, decoded.

    Ids are those of byte-level BPE with the ranks at ``ranks_path`` (a file that every
    executor has), each match of the pattern on its own, no special tokens. The sums are of
    the ids as little-endian 32-bit integers and of the text decoded from them. A null text
    counts as empty: no tokens. Each row stands alone, so ties and repeated rows repeat, an
    empty table gives no rows, and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        gc.disable()  # the tables hold no cycles; walking them again and again would cost much
        enc = encoder(ranks_path, pattern)
        token = enc.fst.token
        for b in batches:
            counts, sums, back, all_ids, texts = [], [], [], [], []
            for text in b.column(1).to_pylist():
                ids = enc.encode(text)
                counts.append(len(ids))
                sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                seen, whole = hashlib.sha256(), []
                for part in decode(ids, token):
                    seen.update(part.encode())
                    if with_ids:
                        whole.append(part)
                back.append(seen.hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                    texts.append("".join(whole))
            columns = [b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, kinds)
    return out.withColumnRenamed("id", id_col)
