import collections
import os
import re
from zlib import crc32

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from feedloom.llm import common, quality, secrets
from feedloom.llm.common import stored

DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "secrets", "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == counts[4]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIR), name)
    assert docs.count() == 0


def plain_lines(rows, least=10):
    sites, first = collections.defaultdict(set), {}
    for r in rows:
        for k, line in enumerate((r["text"] or "").split("\n")):
            if r["text"] is not None and (x := line.strip(" ")):
                sites[x].add(r["source"] or "")
                first[x] = min(first.get(x, (r["doc_id"], k)), (r["doc_id"], k))
    out = []
    for r in rows:
        lines = r["text"].split("\n") if r["text"] is not None else []
        kept = [x for k, x in enumerate(lines) if len(sites.get(x.strip(" "), ())) < least or first[x.strip(" ")] == (r["doc_id"], k)]
        out.append(r if len(kept) == len(lines) else r | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))})
    return out


def plain_copies(rows):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= 0.8 * (len(a) + len(sets[j]) - shared):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] == min(least[root(i)])]


def plain_redaction(r):
    text = r["text"]
    for rule in secrets.RULES if text is not None else ():
        text = re.sub(rule.pattern, lambda m, rule=rule: "[REDACTED]" if len(m.group(rule.group)) >= rule.least else m.group(), text)
    return r | {"text": text}


def test_chain_against_plain_python(spark):
    """All stages in turn, each over what the one before kept, against the same in plain Python."""
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    lean, bias = quality.fit(docs, labels).lean()

    def good(text):
        ids, n = quality.counted(text)
        x = bias + (float(lean[ids] @ n) / n.sum() if len(ids) else 0.0)
        return 1 / (1 + np.exp(-x)) >= 0.3

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain = {"quality": lambda rows: [r for r in rows if good(r["text"])], "lines": plain_lines, "near_copies": plain_copies, "secrets": lambda rows: [plain_redaction(r) for r in rows]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, before, rows = stored(stage(spark, docs, path), name), len(rows), plain[name](rows)
        assert sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"]) == rows, name
        assert name not in ("quality", "near_copies") or len(rows) < before
    want = []
    for r in rows:
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r["doc_id"], k, len(ids[a : a + 2048]), crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.pack_sequences(spark, docs, path).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_odd_rows_go_through(spark):
    """Nulls everywhere, repeats, ties, long and empty texts and clashing columns: every stage runs and keeps what is not its own."""
    rows = [(1, None, None, 5, "a"), (1, None, None, 5, "a"), (None, "x y", None, None, "b"), (2, "", "s", 0, None), (3, "line\n" * 30_000, "t", 150_000, "c"), (4, "token = abcdef123", "s", 17, "d"), (5, "one two three four five six", "u", 27, "e"), (6, "ONE two three four five six", "v", 27, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int, n_lines string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DIR), name) if name != "quality" else docs
        assert docs.columns == ["doc_id", "text", "source", "n_removed", "n_lines"], name
    got = sorted(map(tuple, docs.collect()), key=str)
    assert got == sorted([(1, None, None, 5, "a")] * 2 + [(None, "x y", None, None, "b"), (3, rows[4][1], "t", 150_000, "c"), (4, "[REDACTED]", "s", 17, "d"), (5, rows[6][1], "u", 27, "e")], key=str)
    assert corpus_pipeline.pack_sequences(spark, docs, DIR).count() >= 6


def test_tables_are_released(spark):
    """The stages' tables go with the stage, the rest with ``cleanup``; results are read before that."""
    common.cleanup(spark)
    packed = corpus_pipeline.run(spark, DIR)
    n, left = packed.count(), common.written(spark)
    names = [p.rpartition("/")[2].partition("-")[0] for p in common._written[spark.sparkContext.applicationId]]
    assert n and names.count("secrets") == 1 and not {"quality", "lines", "near_copies", "anchors", "shingles", "hits"} & set(names)
    assert all(os.path.isdir(p) for p in common._written[spark.sparkContext.applicationId]) and left == len(names)
    common.cleanup(spark)
    assert common.written(spark) == 0 and not os.path.exists(common.scratch(spark))
