"""Bound-certified best-fit packing of token sequences."""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left
from functools import lru_cache, reduce
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, stored

#: Most entries of a worker's cache of words.
CACHE = 800_000
#: Rows that are encoded at a time.
STEP = 1024
#: A word of Latin letters that have no decomposed form among them, and ASCII punctuation after it (no apostrophe): the
#: tokenizer cuts between the two and ignores case, so they are looked up apart.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of whole texts as the library gives them. The tokenizer drops white space and never looks across it, so each word between
    ASCII white space is coded once and kept in a bounded cache; a batch's words are split and numbered by Arrow and their ids
    gathered by numpy. The strings of added tokens are tokens wherever they stand: texts that hold one go whole to the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}
        self.clear()

    def clear(self) -> None:
        """The cache: a word's number, and of each number where its ids end in one flat array."""
        self.number: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("i")
        self._add("", [])

    def _add(self, word: str, ids) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        self.number[word] = k = len(self.number)
        return k

    def _letters(self, word: str) -> int:
        """A run of lower-case letters is one word to the tokenizer, so its model alone codes it."""
        coded = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return self._add(word, [t.id for t in self.tokenizer.model.tokenize(coded)])

    def _library(self, words: list[str]) -> None:
        coded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, of = np.array(coded.ids, np.uint32), np.array(coded.word_ids, np.int64)
        cuts = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        for w, x, z in zip(words, cuts, cuts[1:]):
            if w not in self.number:
                self._add(w, ids[x:z].tolist())

    def _learn(self, words: list[str]) -> None:
        number, match = self.number, PLAIN.fullmatch
        plain = [(w, m[1].lower(), m[2]) for w in words if (m := match(w))]
        found = {w for w, _, _ in plain}
        if odd := [w for w in {*(w for w in words if w not in found), *(tail for _, _, tail in plain)} if w not in number]:
            self._library(odd)
        flat, ends = self.flat, self.ends
        for word, base, tail in plain:
            k = number.get(base)
            if k is None:
                k = self._letters(base)
            if word not in number:
                ids, j = flat[ends[k - 1] : ends[k]], number[tail]
                if j:
                    ids += flat[ends[j - 1] : ends[j]]
                self._add(word, ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (strings, null: empty) one after another, and where each text's end."""
        texts = pc.fill_null(texts, "")
        own = reduce(pc.or_, [pc.match_substring(texts, t) for t in self.added], pa.array(np.zeros(len(texts), bool)))
        whole = np.flatnonzero(own.to_numpy(zero_copy_only=False)).tolist()
        split = pc.ascii_split_whitespace(pc.if_else(own, "", texts) if whole else texts)
        words = split.flatten().dictionary_encode()
        listed = words.dictionary.to_pylist()
        if len(self.number) > CACHE:
            self.clear()
        get = self.number.get
        known = [get(w) for w in listed]
        if new := [w for w, k in zip(listed, known) if k is None]:
            self._learn(new)
            known = [get(w) if k is None else k for w, k in zip(listed, known)]
        at, offsets = np.array(known, np.int32)[words.indices.to_numpy(zero_copy_only=False)], split.offsets.to_numpy()
        del words, listed, known, split
        flat, last = np.frombuffer(self.flat, "<u4"), np.frombuffer(self.ends, np.int32)
        starts = last[at - (at > 0)] * (at > 0)
        sizes = last[at] - starts
        ends = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
        where = np.repeat(starts - ends[:-1], sizes)
        where += np.arange(ends[-1], dtype=np.int32)
        ids = flat[where]
        del flat, last  # arrays cannot grow while they are looked at
        ends = ends[offsets - offsets[0]]
        if not whole:
            return ids, ends[1:]
        parts = [ids[a:z] for a, z in zip(ends, ends[1:])]
        for k in whole:
            parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids, then ``end``, cut only where over ``capacity``."""

    def run(batches):
        enc, tail = encoder(path), np.array([end], "<u4").tobytes()
        for part in batched(batches, STEP, enc):
            rows = []
            ids, ends = enc.encode(part.column(1))
            data = ids.tobytes()
            for doc_id, z, a in zip(part.column(0).to_pylist(), ends.tolist(), [0, *ends.tolist()]):
                own = data[4 * a : 4 * z] + tail
                for k, x in enumerate(range(0, len(own), 4 * capacity)):
                    cut = own[x : x + 4 * capacity]
                    rows.append((doc_id, k, x // 4, len(cut) // 4, crc32(cut)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of many bounds from dual-feasible functions: each maps lengths so that no set that fits sums to over 1;
    the sum over all lengths, rounded up, bounds the number of bins from below. All sums are exact integers."""
    n = np.bincount(lengths, minlength=capacity + 1).astype(object)
    x = np.arange(capacity + 1).astype(object)
    best = -(-int((n * x).sum()) // capacity)
    # lengths over capacity - e count whole, those under e not at all
    below, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    for e in range(1, capacity // 2 + 1):
        whole = int(below[-1] - below[capacity - e + 1])
        best = max(best, whole + -(-int(mass[capacity - e + 1] - mass[e]) // capacity))
    # steps of 1 / k, exact multiples of 1 / (k + 1) kept
    for k in range(1, 33):
        exact = (k + 1) * x % capacity == 0
        value = np.where(exact, k * x, (k + 1) * x // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    # rounding to multiples of e: up for those over half, down for those under half
    for e in range(2, capacity // 2, max(1, capacity // 64)):
        top = capacity // e
        value = np.where(2 * x > capacity, 2 * (top - (capacity - x) // e), np.where(2 * x == capacity, top, 2 * (x // e)))  # in units of 1 / (2 * top)
        best = max(best, -(-int((n * value).sum()) // (2 * top)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (longest first, each into the fullest bin that has room), and the bins' fills.
    Rooms are whole numbers, so open bins are kept in one stack per room and a sorted list of rooms in use."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k == len(rooms):
            b, room = len(fills), capacity
            fills.append(0)
        else:
            room = rooms[k]
            b = stacks[room].pop()
            if not stacks[room]:
                del rooms[k]
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            if not stacks[left]:
                rooms.insert(bisect_left(rooms, left), left)
            stacks[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _packer(capacity: int, base: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths, part = table.column("length").to_numpy(), table.column("part")[0].as_py()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        # certified: only the emptiest bin may go on, as a part's bound rounds up; else each bin with room
        loose = fills < capacity if len(fills) > bound else np.arange(len(fills)) == fills.argmin()
        loose &= fills < capacity
        more = {"bin": base + (part << 24) + bins, "offset": offsets, "bins": np.full(len(bins), len(fills)), "bound": np.full(len(bins), bound), "loose": loose[bins]}
        for k, v in more.items():
            table = table.append_column(k, pa.array(v))
        return table

    return pack


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, part_rows: int = 20_000) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and for the part that packed the piece last its number of sequences (part_bins) and the
    certified lower bound (part_bound).

    Pieces are dealt into parts of about ``part_rows`` by hash, each part packed best-fit decreasing and certified by
    dual-feasible bounds. Sequences with room in parts with a gap, and the emptiest of each certified part,
    give their pieces back; these are dealt anew, by another hash, so that parts exchange documents, and packed again, for as
    long as that saves sequences. Null and empty texts are the end id alone; a null doc_id and
    repeated rows are packed like any others; other columns are ignored; an empty table gives an empty result.
    """
    cut = stored(pieces(docs, path, capacity, end), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") == capacity).withColumns({"bin": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bins": F.lit(1).cast("long"), "bound": F.lit(1).cast("long")})
    schema = f"{PIECE}, part long, bin long, offset long, bins long, bound long, loose boolean"
    columns = [*names, "bin", "offset", "bins", "bound"]
    pool, settled, before = cut.where(F.col("length") < capacity), [full.select(columns)], None
    for k in count():
        n = pool.count()
        if not n:
            break
        parts = -(-n // part_rows)
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(k)), F.lit(parts)))
        new = stored(dealt.groupBy("part").applyInArrow(_packer(capacity, k << 48), schema), "packed")
        if before is not None and new.select("bin").distinct().count() >= before[1]:
            settled.append(before[0])
            break
        settled.append(new.where("not loose").select(columns))
        loose = new.where("loose")
        bins = loose.select("bin").distinct().count()
        if bins <= 1:
            settled.append(loose.select(columns))
            break
        before, pool = (loose.select(columns), bins), loose.select(names)
    out = settled[0]
    for df in settled[1:]:
        out = out.unionByName(df)
    return out.select(*names, F.col("bin").alias("sequence_id"), "offset", F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound"))
