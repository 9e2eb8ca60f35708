"""Media columns, byte-level BPE and packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarrybed.llm import bpe, media, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
KIND = "doc_id long, text string, t int, id string"
CLASHES = ("start", "length", "offset", "lane", "ids_crc32", "media", "landmarks", "n_bytes", "ids", "decoded", "n_tokens", "sequence_id")
TEXTS = ["", None, "a", "x" * 576, "é" * 400, "The cat's 123 dogs,  \n\n and 'll <|endoftext|> ... --- ===", "日本語🙂" * 30, "İSTANBUL ΣΑΣ Straße", " " * 700 + "end", "a\x1cb\u2028c", "a long text, with words " * 20_000]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, 1, "z") for k, t in enumerate(texts)], KIND).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_media(spark):
    out = {r["doc_id"]: r for r in media.media_columns(frame(spark)).collect()}
    for k, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = out[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert media.from_wav(bytes(r["media"])) == payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    digests = {r["doc_id"]: r for r in media.media_digests(media.media_columns(frame(spark))).collect()}
    assert digests[0]["feature"] == digests[1]["feature"] and digests[4]["feature"] != digests[6]["feature"]
    assert digests[3]["media_sha256"] == hashlib.sha256(bytes(out[3]["media"])).hexdigest()
    assert media.media_columns(frame(spark, [])).count() == 0


def test_landmarks_follow_a_tone():
    t = np.arange(576 * 4)
    wave = np.round(128 + 100 * np.sin(2 * np.pi * 40 * t / 576)).astype(np.uint8)
    marks = media.landmarks(wave)
    assert {(m >> 20) & 0xFFF for m in marks.tolist()} >= {40} and (marks >> 32).max() in (5, 6)
    assert len(media.landmarks(np.full(576 * 3, 255, np.uint8))) == 0


def brute_landmarks(samples):
    """Peaks and pairs by a plain discrete Fourier transform."""
    n, marks, tops = 576, set(), []
    k, t = np.arange(n // 2 + 1)[:, None], np.arange(n)[None, :]
    wave = np.exp(-2j * np.pi * k * t / n)
    for at in range(0, len(samples) - n + 1, 288):
        power = abs(wave @ ((samples[at : at + n].astype(float) - 128) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))))
        found = [b for b in range(1, n // 2) if power[b] > power[b - 1] and power[b] >= power[b + 1] and power[b] >= 1e-3 * power.max()]
        tops.append(sorted(found, key=lambda b: -power[b])[:2])
    for i, a in enumerate(tops):
        if len(a) == 2:
            marks.add((i, a[0], a[1], 0))
        for gap in range(1, 5):
            for x in a:
                marks |= {(i, x, y, gap) for y in (tops[i + gap] if i + gap < len(tops) else [])}
    return marks


def test_features_of_the_query_are_those_of_a_plain_transform(spark):
    texts = [TEXTS[5] * 40, "the quick brown fox " * 90, "", "A" * 1000 + "b" * 777, "".join(map(chr, range(32, 900)))]
    for r in media.media_columns(frame(spark, texts)).collect():
        got = {(m >> 32, m >> 20 & 0xFFF, m >> 8 & 0xFFF, m & 0xFF) for m in r["landmarks"]}
        want = brute_landmarks(np.frombuffer(media.padded((texts[r["doc_id"]]).encode()), np.uint8))
        assert len(got & want) >= 0.98 * max(len(got), len(want)) and len(got) == len(r["landmarks"])


def test_bpe_matches_the_library(spark, tik):
    r = random.Random(5)
    more = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x500), r.randrange(0x4E00, 0x4F00)])) for _ in range(300)) for _ in range(15)]
    more += ["".join(r.choice("abcde ") for _ in range(400)) for _ in range(15)]
    texts = TEXTS + more
    out = {x["doc_id"]: x for x in bpe.encode_documents(frame(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(texts):
        want = tik.encode_ordinary(t or "")
        assert out[k]["ids"] == want and out[k]["n_tokens"] == len(want) and out[k]["decoded"] == (t or "")
        assert out[k]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert out[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_latin_pieces_are_the_patterns_own():
    e, r = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN), random.Random(9)
    assert public_tokenizers.PATTERN == bpe.USUAL and e.find_latin != e.find
    pool = "".join(map(chr, range(256))) + "'s 't re ve m ll d \n " * 8
    for _ in range(3000):
        text = "".join(r.choices(pool, k=r.randrange(30)))
        assert e.pieces(text) == e.find(text)


def test_transducer_with_few_states(tik):
    e = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, limit=8)
    e.fst.limit = 20
    for t in [x or "" for x in TEXTS] * 2 + ["ab" * 400, "=" * 1000, "queue queueing requeue"]:
        assert e.encode(t).tolist() == tik.encode_ordinary(t)


def test_utf8_stream_in_any_cuts():
    text = "aé日🙂\u07ff\uffff" * 5
    data = text.encode()
    for step in range(1, 9):
        s = bpe.Utf8Stream()
        assert "".join([s.feed(data[k : k + step]) for k in range(0, len(data), step)] + [s.end()]) == text
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xe6\x97") == "a" and s.end() == "\ufffd"


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    r = random.Random(6)
    texts = TEXTS + [" ".join(r.choice(["the", "Straße,", "don't", "x!?", "9", "zyq."]) for _ in range(r.randrange(0, 3000))) for _ in range(60)]
    rows = packing.pack_documents(frame(spark, texts), WORDS, window=512, lane=20).collect()
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted((x for x in rows if x["doc_id"] == k), key=lambda x: x["start"])
        assert [x["start"] for x in own] == list(np.cumsum([0] + [x["length"] for x in own[:-1]]))
        assert sum(x["length"] for x in own) == len(ids) == own[0]["doc_tokens"]
        for x in own:
            part = np.array(ids[x["start"] : x["start"] + x["length"]], "<u4")
            assert x["ids_crc32"] == zlib.crc32(part.tobytes())
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 512
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0


def test_sum_of_squares_rule_and_padding():
    p = packing.SumOfSquares(10)
    for size in (4, 3, 4, 6, 7, 3, 5, 5, 2):
        n = p.levels.copy()

        def cost(h, size=size, n=n):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 10:
                m[h + size] += 1
            return int((m[1:10] ** 2).sum())

        options = [h for h in range(0, 11 - size) if h == 0 or n[h]]
        _, at = p.place(size)
        assert cost(at) == min(map(cost, options))
    lengths = np.random.default_rng(7).integers(1, 1500, 3000)
    which, at = packing.pack_lane(lengths)
    assert lengths.sum() / (len(set(which)) * 4096) > 0.97


def test_letters_that_become_a_letter_and_a_mark():
    words = packing.WordMemo(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("\u0130. \u0130, a\u0130.", "\u0958. \u09dc,", "\u1e9e. \u03a3. \u01c4,", "e\u0301. \u0301, x"):
        assert words.encode(text) == words.pack(words.plain(text))
