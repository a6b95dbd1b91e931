import random
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from feedloom.llm import packing

PATH = P.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello, World! don't STOP", "été Ünï ÄÖÜ ß ÿ É", "é äb Å, x", "a\x1cb\x1fc\x85d\xa0e", "12345 a1b2 !!%% _x_", "İstanbul ΣΑΣ ς", "日本 テキスト", "a\tb\nc\r\nd  e", "x" * 5000, "It's we'll 'S 'T o'clock's", "<|endoftext|> <|startoftext|>", "end.' \"q\"", "é́, ñ̃."]


def reference():
    return Tokenizer.from_file(PATH)  # as it comes: strings of added tokens are tokens


def test_ids_are_the_tokenizers():
    rng = random.Random(3)
    alphabet = "aAbzéÉßŒ ,.!'-́̈\n\t\x0b\x0c\x1c\x85\xa01_ıİΣ日"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(400)]
    lib = reference().encode_batch(texts, add_special_tokens=False)
    enc = packing.WordEncoder(PATH)
    for column in (pa.array(texts), pa.array(["cut off", *texts, "too"]).slice(1, len(texts))):
        ids, ends = enc.encode(column)
        for text, part, want in zip(texts, np.split(ids, ends[:-1]), lib, strict=True):
            assert part.tolist() == want.ids, repr(text)
    assert enc.encode(pa.array([], pa.string()))[0].size == 0


def test_added_tokens_are_found_before_all_else():
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|ENDOFTEXT|> <|EndOfText|>", "don<|startoftext|>'t", "é<|endoftext|>́", "<|endoftext|><|endoftext|>", "<|endof text|>", "<|endoftext|", "\u3000<|startoftext|>\xa0", None]
    ids, ends = packing.WordEncoder(PATH).encode(pa.array(texts))
    lib = [reference().encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == lib and lib[0] == [320, 49407, 321]


def brute_minimum(lengths, capacity):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, bins + [lengths[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 17, 64])
        lengths = np.array(sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True))
        bins, offsets, fills = packing.best_fit_decreasing(lengths, capacity)
        assert packing.lower_bound(lengths, capacity) <= brute_minimum(lengths.tolist(), capacity) <= len(fills)
        assert (np.bincount(bins, lengths) == fills).all() and fills.max() <= capacity


def test_pack_whole(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma,", "d."]) for _ in range(rng.randrange(0, 120))), "s") for i in range(150)]
    rows += [(203, "a <|endoftext|> b<|startoftext|>", "s"), (200, None, "s"), (201, "", "s"), (None, "loose words", "s"), (3, rows[3][1], "s"), (202, "word " * 5000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs, PATH, capacity=64, part_rows=40).collect()
    want, t = [], reference()
    for i, text, _ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, a, len(ids[a : a + 64]), crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(seqs) <= packing.lower_bound(np.array([r.length for r in got]), 64) + 2
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_rounds_go_on_while_they_save(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(["alpha"] * rng.randrange(14, 31))) for i in range(600)], "doc_id long, text string")
    got = packing.pack(docs, PATH, capacity=64, part_rows=12).collect()
    assert len(got) == 600
    assert len({r.sequence_id for r in got}) <= 235  # four rounds leave 237
