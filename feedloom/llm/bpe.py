"""Byte-level BPE encoding by prefix dynamic programming, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points with the Unicode property White_Space. Fixed values.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts a text where the tokenizers' pattern cuts it anyway: a word with at most one space before it, and other white space.
CHUNKS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Most entries of each of a worker's caches.
CACHE = 800_000


class Ranks:
    """A vocabulary of byte strings with merge ranks (a .tiktoken file). Every single byte must have a rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.longest = max(map(len, self.rank))
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.known: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """BPE by its definition: merge the leftmost adjacent pair of least rank until none has a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether BPE leaves the bytes of token ``a`` and then ``b`` as just those two tokens (``a`` empty: as ``b``)."""
        if len(self.known) >= CACHE:
            self.known.clear()
        ok = self.known[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return ok


class Prefixes:
    """The state of the dynamic program over one piece of bytes: ``last[i]`` is the last token of the encoding of the first
    i bytes. An encoding is valid just when each adjacent pair of its tokens is, and each prefix has one valid
    encoding, so there is exactly one candidate that may stand last: a token ending at i that can follow the
    last token of the prefix before it."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [b""]
        self.append(data)

    def _extend(self, data: bytes, start: int, end: int) -> None:
        """Entries start + 1 to end. The valid last token is unique, and mostly short: short ones are tried first."""
        rank, last, known, follows, longest = self.ranks.rank, self.last, self.ranks.known.get, self.ranks.follows, self.ranks.longest
        for i in range(start + 1, end + 1):
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                token = data[j:i]
                if token in rank:
                    ok = known((last[j], token))
                    if ok or ok is None and follows(last[j], token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token can end at byte {i}: the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Exact append: no earlier entry changes."""
        data, start = self.data + more, len(self.data)
        self._extend(data, start, len(data))
        self.data = data

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start to end. Entries before the edit stay; entries behind it are computed anew until
        ``longest`` of them in a row agree with the old ones, from where all do. Returns how many were computed."""
        old, data = self.last, self.data[:start] + new + self.data[end:]
        self.last, shift, agree, i = old[: start + 1], len(new) - (end - start), 0, start
        while i < len(data) and agree < self.ranks.longest:
            self._extend(data, i, i + 1)
            i += 1
            agree = agree + 1 if i > start + len(new) and self.last[i] == old[i - shift] else 0
        self.last += old[i - shift + 1 :]
        self.data = data
        return i - start

    def tokens(self) -> list[int]:
        i, out = len(self.data), []
        while i:
            out.append(self.ranks.rank[self.last[i]])
            i -= len(self.last[i])
        return out[::-1]


class Encoder:
    """Encodes whole texts; pieces and chunks once encoded are kept in bounded caches of the worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"(?!\S)", f"(?![^{SPACES}])").replace(r"\s", f"[{SPACES}]"))
        self.pieces: dict[str, bytes] = {}
        encoder = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                got = self[chunk] = b"".join([encoder.piece(p) for p in encoder.pattern.findall(chunk)])
                return got

        self.chunks = Chunks()

    def piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as little-endian 32-bit integers."""
        got = self.pieces.get(piece)
        if got is None:
            data = piece.encode("utf-8", "replace")
            whole = self.ranks.rank.get(data)
            ids = [whole] if whole is not None else Prefixes(self.ranks, data).tokens()
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            got = np.array(ids, "<u4").tobytes()
            if len(piece) <= 64:
                self.pieces[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        get = self.chunks
        return b"".join([get[c] if len(c) <= 64 else b"".join([self.piece(p) for p in self.pattern.findall(c)]) for c in CHUNKS.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``path`` is a .tiktoken file that each executor can open, ``pattern`` the tokenizer's. Each text is encoded whole, by
    one task, in one narrow stage. Null and empty texts give no tokens and the hashes of no bytes; rows that repeat and null
    doc_ids go through as they are; other columns are ignored; an empty table gives an empty result.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, hashed, back, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = enc.encode(text or "")
                    n.append(len(ids) // 4)
                    hashed.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(np.frombuffer(ids, "<u4").tolist())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int64()))] * keep_ids, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids)
