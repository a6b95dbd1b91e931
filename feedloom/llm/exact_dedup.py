"""Exact deduplication by mergeable counting quotient filters, with byte verification."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, stored


class CountingQuotientFilter:
    """A static counting quotient filter over 64-bit fingerprints.

    A fingerprint's high ``q`` bits are its quotient, the rest its remainder. ``occupieds`` marks quotients that have a
    run, ``runends`` the last slot of each run, ``remainders`` holds the runs in quotient order, each sorted; counters
    are kept only for slots that occur more than once. Quotient and remainder together are the whole fingerprint, so
    a merge loses nothing. ``first`` is the quotient that the bitmap begins with and ``span`` the quotients it covers.
    """

    def __init__(self, q: int, first: int, span: int, occupieds, runends, remainders, counted, counts):
        self.q, self.first, self.span = q, first, span
        self.occupieds, self.runends, self.remainders, self.counted, self.counts = occupieds, runends, remainders, counted, counts

    @classmethod
    def build(cls, fps: np.ndarray, counts: np.ndarray, q: int, first: int, span: int) -> CountingQuotientFilter:
        """From ascending distinct uint64 fingerprints and how often each occurs."""
        quotient = (fps >> np.uint64(64 - q)).astype(np.int64) - first
        occupied = np.zeros(span, bool)
        occupied[quotient] = True
        ends = np.ones(len(fps), bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        many = np.flatnonzero(counts > 1)
        return cls(q, first, span, np.packbits(occupied), np.packbits(ends), fps & np.uint64((1 << (64 - q)) - 1), many.astype(np.int32), counts[many].astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending fingerprints and their counts."""
        n = len(self.remainders)
        runs = np.flatnonzero(np.unpackbits(self.runends, count=n))
        quotients = np.flatnonzero(np.unpackbits(self.occupieds, count=self.span)) + self.first
        fps = (np.repeat(quotients, np.diff(runs, prepend=-1)).astype(np.uint64) << np.uint64(64 - self.q)) | self.remainders
        counts = np.ones(n, np.int64)
        counts[self.counted] = self.counts
        return fps, counts

    @staticmethod
    def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all their rows: the sorted runs are merged and the counters of equal remainders added."""
        parts = [f.items() for f in filters]
        fps, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(fps, kind="stable")
        fps, counts = fps[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]])) if len(fps) else np.zeros(0, int)
        f = filters[0]
        return CountingQuotientFilter.build(fps[starts], np.add.reduceat(counts, starts) if len(fps) else counts, f.q, f.first, f.span)

    def to_bytes(self) -> bytes:
        head = np.array([self.q, self.first, self.span, len(self.remainders), len(self.counted)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.remainders, self.counts, self.counted, self.occupieds, self.runends))

    @classmethod
    def from_bytes(cls, b: bytes) -> CountingQuotientFilter:
        q, first, span, n, m = (int(x) for x in np.frombuffer(b, np.int64, 5))
        at, out = 40, []
        for kind, k in ((np.uint64, n), (np.int64, m), (np.int32, m), (np.uint8, (span + 7) // 8), (np.uint8, (n + 7) // 8)):
            out.append(np.frombuffer(b, kind, k, at))
            at += out[-1].nbytes
        return cls(q, first, span, out[3], out[4], out[0], out[2], out[1])


def _partial(ranges: int):
    """A task's fingerprints as one filter, cut by quotient into ``ranges`` (a power of two) slices."""
    bits = ranges.bit_length() - 1

    def build(batches):
        fps, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            new, n = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            both = np.concatenate([fps, new])
            fps, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(fps)).astype(np.int64)
        q = min(40, bits + max(4, int(len(fps)).bit_length() - bits))
        span = 1 << (q - bits)
        cuts = np.searchsorted(fps, np.arange(ranges, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, int)
        ids, blobs = [], []
        for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(fps)])):
            if z > a:
                ids.append(k)
                blobs.append(CountingQuotientFilter.build(fps[a:z], counts[a:z], q, k * span, span).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "filter"])

    return build


def _repeated(table: pa.Table) -> pa.Table:
    fps, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(b) for b in table.column("filter").to_pylist()]).items()
    many = counts > 1
    return pa.table({"fp": pa.array(fps[many].view(np.int64)), "n": pa.array(counts[many])})


def repeated_fingerprints(fps: DataFrame, ranges: int) -> DataFrame:
    """Rows (fp, n) for each fingerprint (one long column) that occurs more than once, by merged quotient filters.
    ``ranges`` slices of the fingerprint space are merged apart; a slice gets one blob from each map task, whose size
    follows the distinct fingerprints and not the rows, so hot fingerprints cost no more than others."""
    return fps.mapInArrow(_partial(ranges), "slice int, filter binary").groupBy("slice").applyInArrow(_repeated, "fp long, n long")


def exact_dedup(docs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id stays. A counting
    quotient filter per partition, merged, finds the fingerprints that occur more than once; only their rows go to byte
    verification, a grouping by the text's own bytes; a key filter of bounded size splits them off, so the other texts are never shuffled.
    A fingerprint that two different texts share, or that the filter lets through, costs time, never a wrong group. Null text is empty text; empty texts are equal. A null doc_id never beats another; if all are
    null, keep_id is null. Rows repeated with the doc_id that stays are that document and all have kept true. An empty
    table gives an empty result; other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase).alias("norm"))
    rows = rows.withColumn("fp", F.xxhash64("norm"))
    ranges = 1 << max(5, (docs.count() // rows_per_range).bit_length())
    many = KeyFilter(stored(repeated_fingerprints(rows.select("fp"), ranges), "repeated"), "fp")
    routed = many.mark(rows, F.col("fp"))
    routed = routed.select("doc_id", F.sha2("norm", 256).alias("sha"), F.when(F.col("__maybe"), F.col("norm")).alias("norm"))
    routed = stored(routed, "routed")
    alone, shared = routed.where("norm is null"), routed.where("norm is not null")
    # byte verification: the grouping key is the text itself
    classes = stored(shared.groupBy("sha", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("key", F.xxhash64("norm", F.length("norm"))).drop("norm"), "classes")
    checked = shared.select("doc_id", "sha", F.xxhash64("norm", F.length("norm")).alias("key")).join(classes, ["sha", "key"])
    out = checked.select("doc_id", "keep_id", "group_size", "sha").unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
