import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from feedloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "a", "don't  stop\n\n now", "x" * 3000, " a\x1cb\x85c 　d", "été 12 %%% 🎉🎉 é", "\n", "a \t b ", "'s 's'S", "日本語のテキスト", "\x00\x1f\x7f"]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=300):
    rng = random.Random(1)
    alphabet = "ab cdeé'sнт \n\t 　\x1c12.%-🎉日"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_same_ids_as_the_library():
    lib, enc = library(), bpe.Encoder(PATH, P.PATTERN)
    for text in texts():
        ids = enc.encode(text)
        assert list(memoryview(ids).cast("I")) == lib.encode_ordinary(text), repr(text)
        assert enc.decode(ids) == text.encode()


def test_append_and_edit_are_exact():
    enc, rng = bpe.Encoder(PATH, P.PATTERN), random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"thenation ,.aa") for _ in range(rng.randrange(1, 80)))
        a = rng.randrange(len(data) + 1)
        p = bpe.Prefixes(enc.ranks, data[:a])
        p.append(data[a:])
        assert p.tokens() == [enc.ranks.rank[t] for t in enc.ranks.merged(data)]
        s = rng.randrange(len(data))
        e, new = rng.randrange(s, len(data) + 1), bytes(rng.choice(b"thenation") for _ in range(rng.randrange(4)))
        p.replace(s, e, new)
        edited = data[:s] + new + data[e:]
        assert p.tokens() == [enc.ranks.rank[t] for t in enc.ranks.merged(edited)] and len(p.last) == len(edited) + 1


def test_edit_stops_early():
    enc = bpe.Encoder(PATH, P.PATTERN)
    p = bpe.Prefixes(enc.ranks, b"the nation " * 500)
    assert p.replace(100, 101, b"x") < 600


def test_operator_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "hello world", "z")], "doc_id long, text string, n_tokens string")
    rows = bpe.bpe_roundtrip(docs, PATH, P.PATTERN, keep_ids=True).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 0, len(library().encode_ordinary('hello world'))]
    assert bpe.bpe_roundtrip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_operator_against_the_library(spark):
    """Every column of every document of a sample table, and ids that decode to the text."""
    lib, path = library(), "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path).unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(texts(50))], "doc_id long, text string"), allowMissingColumns=True)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode_ordinary(r.text or "")
        packed = np.array(ids, "<u4").tobytes()
        want[r.doc_id] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_roundtrip(docs, PATH, P.PATTERN).collect()}
    assert got == want
