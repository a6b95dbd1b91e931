"""SimHash near-deduplication by anchor-point covering."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import KeyFilter, batched, checked_broadcast, components, stored, tasks


def hashes_of(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of the text's word shingles, repeats included, as rows of eight bytes; none without words."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z, and ASCII white space
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)] * bool(w)
    return np.frombuffer(b"".join([xxh64_digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 without any."""
    if not len(hashes):
        return 0
    votes = sum(np.unpackbits(hashes[i : i + 65536], axis=1).sum(0, dtype=np.int64) for i in range(0, len(hashes), 65536))
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    return majority(hashes_of(text, words, seed))


#: Odd multipliers that stand for eight orders of the hashes. Fixed values.
ORDERS = (np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C14)) | np.uint64(1)


def minima(hashes: np.ndarray) -> int:
    """Eight bytes, each of the least hash under another order: two sets agree in each with their Jaccard similarity."""
    if not len(hashes):
        return 0
    h = np.ascontiguousarray(hashes).view(">u8").ravel().astype(np.uint64)
    return int.from_bytes(bytes(int((h * k).min() >> np.uint64(8)) & 255 for k in ORDERS), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed long."""

    def run(batches):
        for b in batched(batches, 1024):
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class CoveringCode:
    """A perfect binary linear code, given by the columns of its parity check, with covering radius ``radius``, and ``free`` more
    bits of which every word is a code word. Each word is within ``radius`` of exactly one code word, its home. A word
    within ``reach`` of x is within radius plus reach of the home of x, and within reach of it in the free bits alone: the
    anchors of x are x xor e for each such e with the syndrome of x."""

    def __init__(self, columns: list[int], radius: int, reach: int, free: int = 0):
        self.radius, self.columns = radius, np.array(columns, np.int64)
        self.bits = max(columns, default=0).bit_length()
        n, found = len(columns), [[] for _ in range(1 << self.bits)]
        for beyond in range(reach + 1):
            for outer in combinations(range(n, n + free), beyond):
                for weight in range(radius + reach - beyond + 1):
                    for at in combinations(range(n), weight):
                        syndrome = 0
                        for i in at:
                            syndrome ^= columns[i]
                        found[syndrome].append((weight if not beyond else n + free, sum(1 << i for i in at + outer)))
        self.weights = [np.array([w for w, _ in f]) for f in found]
        self.errors = [np.array([e for _, e in f], np.int64) for f in found]

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i, c in enumerate(self.columns):
            out ^= ((words >> i) & 1) * c
        return out


def golay(reach: int) -> CoveringCode:
    """Length 23, 2^12 code words, covering radius 3: columns are x^i modulo the generator x^11+x^9+x^7+x^6+x^5+x+1."""
    columns, c = [], 1
    for _ in range(23):
        columns.append(c)
        c <<= 1
        if c >> 11:
            c ^= 0b101011100011
    return CoveringCode(columns, 3, reach)


def hamming(reach: int) -> CoveringCode:
    """15 bits with covering radius 1 and seven free bits, 2^18 code words."""
    return CoveringCode(list(range(1, 16)), 1, reach, 7)


def words_alone(reach: int) -> CoveringCode:
    """22 free bits: covering radius 0, 2^22 code words."""
    return CoveringCode([], 0, reach, 22)


#: The codes from the fewest anchors to the most, and the most fingerprints that each is taken for at a reach of one.
CODES = ((golay, 4_000_000), (hamming, 1_000_000_000), (words_alone, None))
#: A fingerprint's three blocks, as shift and width; fingerprints within a threshold are within a third of it in some block.
BLOCKS = ((0, 22), (22, 21), (43, 21))


@lru_cache(maxsize=4)
def covering(level: int, threshold: int) -> CoveringCode:
    return CODES[level][0](threshold // len(BLOCKS))


def level_for(n: int, threshold: int) -> int:
    """The code for ``n`` fingerprints. Finer codes compare less and replicate more, which stays below 75 rows a fingerprint
    up to a threshold of five; beyond that only the first code stays below that (68 rows)."""
    if threshold // len(BLOCKS) > 1:
        return 0
    return next(k for k, (_, most) in enumerate(CODES) if most is None or n <= most)


def _replicate(level: int, threshold: int):
    """Rows (anchor, id, fp, home): each fingerprint at every anchor within covering radius plus threshold of a block, and at
    its home anchor once more with home set."""

    def run(batches):
        code = covering(level, threshold)
        for b in batches:
            ids, fps, *more = (b.column(c).to_numpy(zero_copy_only=False) for c in range(b.num_columns))
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                for k, (shift, width) in enumerate(BLOCKS):
                    words = (part.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
                    syndrome = code.syndromes(words)
                    order = np.argsort(syndrome, kind="stable")
                    edges = np.searchsorted(syndrome[order], np.arange((1 << code.bits) + 1))
                    anchors, rows, homes = [], [], []
                    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                        own = order[edges[s] : edges[s + 1]]
                        near = words[own][:, None] ^ code.errors[s][None, :]
                        home = np.flatnonzero(code.weights[s] <= code.radius)[:1]
                        anchors += [near.ravel(), near[:, home].ravel()]
                        rows += [np.repeat(own, near.shape[1]), own]
                        homes += [np.zeros(near.size, bool), np.ones(len(own), bool)]
                    if rows:
                        anchor, row = (np.concatenate(anchors) << 2) | k, np.concatenate(rows) + at
                        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[row]), pa.array(fps[row]), pa.array(np.concatenate(homes)), *[pa.array(m[row]) for m in more]], ["anchor", "id", "fp", "home", "sketch"][: 4 + len(more)])

    return run


def spanning(ids: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int, sketches: np.ndarray | None = None, alike: int = 3, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges, with the bits that their ends differ in, that connect whatever the links between the rows with ``home`` and the others connect; with sketches, a link needs
    ``alike`` equal bytes of them too. Every link is looked
    at, but a row leaves an edge only to the nearest member of each component it joins, so a group of copies never
    gives all its pairs."""
    nodes, at = np.unique(ids, return_inverse=True)
    own, rows = np.flatnonzero(home), np.flatnonzero(~home)
    label, us, vs, ds = np.arange(len(nodes)), [], [], []
    itself = np.isin(at[own], at[rows])  # in a cell of a hot anchor a row's other copy may be elsewhere
    step = max(1, block // max(1, len(rows)))
    for a in range(0, len(own), step):
        part = own[a : a + step]
        apart = np.bitwise_count(fps[part][:, None] ^ fps[rows][None, :])
        hit = apart <= threshold
        if sketches is not None:
            row, col = np.nonzero(hit)
            unlike = ((sketches[part[row]] ^ sketches[rows[col]]).view(np.uint8).reshape(-1, 8) == 0).sum(1) < alike
            hit[row[unlike], col[unlike]] = False
        for i in np.flatnonzero(hit.sum(1) > itself[a : a + step]).tolist():
            near, far = rows[hit[i]], apart[i][hit[i]]
            order = np.argsort(far, kind="stable")
            near, far = near[order], far[order]
            me = at[part[i]]
            found, first = np.unique(label[at[near]], return_index=True)
            new = found != label[me]
            if new.any():
                us.append(np.full(int(new.sum()), nodes[me]))
                vs.append(ids[near[first[new]]])
                ds.append(far[first[new]].astype(np.int32))
                label[np.isin(label, found)] = label[me]
    return (np.concatenate(us), np.concatenate(vs), np.concatenate(ds)) if us else (nodes[:0], nodes[:0], np.zeros(0, np.int32))


def _compare(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        anchor, i, j, ids, home = (table.column(c).to_numpy() for c in ("anchor", "i", "j", "id", "home"))
        fp = table.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((j, i, anchor))
        anchor, i, j, ids, fp, home = (x[order] for x in (anchor, i, j, ids, fp, home))
        sketch = table.column("sketch").to_numpy()[order] if "sketch" in table.column_names else None
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0))
        found = [(ids[:0], ids[:0], np.zeros(0, np.int32))]
        for a, z in zip(new.tolist(), [*new[1:].tolist(), len(fp)]):
            if home[a:z].any():
                found.append(spanning(ids[a:z], fp[a:z], home[a:z], threshold, sketch if sketch is None else sketch[a:z]))
        return pa.table({k: pa.array(np.concatenate(x)) for k, x in zip(("u", "v", "apart"), zip(*found))})

    return run


def links(nodes: DataFrame, threshold: int, within: int | None = None, most: int = 200_000, level: int | None = None, sketch_from: int = 16_000_000) -> DataFrame:
    """Edges (u, v, apart: differing bits) over ``nodes`` (a stored table with long columns id and fp, ids unique) that connect all pairs whose
    fingerprints differ in at most ``threshold`` bits. With ``within`` above that, pairs that meet at an anchor link up to
    ``within`` bits; ``threshold`` is then what is certain to meet. A column sketch of ``nodes`` (see ``minima``) must agree in
    three of its eight bytes as well.

    Anchors are the words of a covering code over each of three blocks; the code follows the number of nodes (``level_for``)
    and each finds every link. From ``sketch_from`` nodes on, anchors are split by six of the sketch's bytes: pairs that
    agree in three of eight agree in one of six, so none is lost. Anchors with over ``most`` rows are cut into cells,
    each with a part of the homes and a part of the rows, so no task gathers a hot anchor.
    """
    n, parts = nodes.count(), tasks(nodes.sparkSession)
    level = level_for(n, threshold) if level is None else level
    more = ["sketch"] * ("sketch" in nodes.columns)
    placed = nodes.select("id", "fp", *more).repartition(parts).mapInArrow(_replicate(level, threshold), "anchor long, id long, fp long, home boolean" + ", sketch long" * len(more))
    if more and n >= sketch_from:
        byte = F.expr("shiftright(sketch, 8 * part) & 255")
        placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("anchor", F.xxhash64("anchor", "part", byte)).drop("part")
    placed = stored(placed, "anchors")
    hot = checked_broadcast(stored(placed.groupBy("anchor").count().where(F.col("count") > most).select("anchor", F.ceil(F.col("count") / most).cast("int").alias("cuts")), "hot"))
    cuts = F.coalesce("cuts", F.lit(1))
    placed = placed.join(hot, "anchor", "left").withColumns({"cuts": cuts, "own": F.pmod(F.hash("id"), cuts)})
    placed = placed.select("anchor", "id", "fp", "home", *more, "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    cell = {"i": F.when(F.col("home"), F.col("own")).otherwise(F.col("other")), "j": F.when(F.col("home"), F.col("other")).otherwise(F.col("own"))}
    placed = placed.withColumns(cell).withColumn("cell", F.pmod(F.hash("anchor", "i", "j"), F.lit(max(4 * parts, n // 2_000))))
    return placed.select("cell", "anchor", "i", "j", "id", "fp", "home", *more).groupBy("cell").applyInArrow(_compare(within or threshold), "u long, v long, apart int")


def simhash_groups(docs: DataFrame, words: int = 4, threshold: int = 4) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    A text is lower-cased (A-Z) and read whole, as words between ASCII white space; fewer than ``words`` words make one
    shingle, none (null and empty texts) the fingerprint zero, linked like any other. Fingerprints link at ``threshold``
    or fewer differing bits; component_id is the smallest doc_id that links reach (null if all there are null). Equal
    fingerprints are compared once. Rows that repeat get equal rows; other columns are ignored; an empty
    table gives an empty result.
    """
    docs = stored(fingerprints(docs, words), "fingerprints")
    fps = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(links(fps.select(F.col("fp").alias("id"), "fp"), threshold))
    label = F.coalesce("label", "fp")
    labelled = stored(fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", label.alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    known = stored(labelled.select("fp", "label").join(least, "label").select("fp", "component_id"), "components")
    return docs.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingles(words: int):
    def run(batches):
        for b in batched(batches, 1024):
            sets = []
            for text in b.column(1):
                w = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                grams = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
                sets.append(np.unique(np.frombuffer(b"".join({xxh64_digest(s, 0) for s in grams}), np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def joined(ids: np.ndarray, labels: np.ndarray, sketches: np.ndarray, tokens: np.ndarray, ends: np.ndarray, left: int, similarity: float, alike: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever pairs of rows of unlike labels at a Jaccard similarity of at least ``similarity`` connect:
    between the first ``left`` rows and the others, or among all rows if ``left`` is 0. ``tokens`` holds the rows' sets one
    after another, up to ``ends``. Labels merge on such pairs only; pairs need ``alike`` equal bytes of their sketches."""
    values, tokens = np.unique(tokens, return_inverse=True)
    tokens = tokens.astype(np.int32)
    label, starts = np.unique(labels, return_inverse=True)[1], np.append(0, ends[:-1])
    sizes, marked, us, vs = ends - starts, np.zeros(len(values), bool), [], []
    for x in range(left or len(ids)):
        first = left or x + 1
        near = first + np.flatnonzero(label[first:] != label[x])
        least, most = np.minimum(sizes[near], sizes[x]), np.maximum(sizes[near], sizes[x])
        near = near[least >= similarity * most]
        near = near[((sketches[near] ^ sketches[x]).view(np.uint8).reshape(-1, 8) == 0).sum(1) >= alike]
        if not len(near):
            continue
        mine = tokens[starts[x] : ends[x]]
        marked[mine] = True
        for a in range(0, len(near), 256):
            part = near[a : a + 256]
            hits = marked[np.concatenate([tokens[starts[y] : ends[y]] for y in part.tolist()])]
            shared = np.add.reduceat(hits, np.append(0, np.cumsum(sizes[part])[:-1]), dtype=np.int64)
            part = part[shared >= similarity * (sizes[part] + sizes[x] - shared)]
            found, one = np.unique(label[part], return_index=True)
            new = found != label[x]
            us.append(np.full(int(new.sum()), ids[x]))
            vs.append(ids[part[one[new]]])
            label[np.isin(label, found)] = label[x]
        marked[mine] = False
    return (np.concatenate(us), np.concatenate(vs)) if us else (ids[:0], ids[:0])


def _settle(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        family, i, j, own = (table.column(c).to_numpy() for c in ("family", "i", "j", "own"))
        order = np.lexsort((own, j, i, family))
        family, i, j, own = (x[order] for x in (family, i, j, own))
        ids, labels, sketches = (table.column(c).to_numpy()[order] for c in ("id", "label", "sketch"))
        sets = table.column("shingles").combine_chunks()
        sizes, flat = sets.value_lengths().to_numpy(), sets.flatten().to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        new = np.flatnonzero((np.diff(family, prepend=family[0]) != 0) | (np.diff(i, prepend=i[0]) != 0) | (np.diff(j, prepend=j[0]) != 0))
        us, vs = [ids[:0]], [ids[:0]]
        for a, z in zip([0, *new.tolist()], [*new.tolist(), len(ids)]):
            rows = order[a:z]
            tokens = np.concatenate([flat[ends[r] - sizes[r] : ends[r]] for r in rows.tolist()])
            left = 0 if i[a] == j[a] else int((own[a:z] == i[a]).sum())
            if left < z - a and (left or i[a] == j[a]):
                u, v = joined(ids[a:z], labels[a:z], sketches[a:z], tokens, np.cumsum(sizes[rows], dtype=np.int64), left, similarity)
                us.append(u)
                vs.append(v)
        return pa.table({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})

    return run


def settle(sets: DataFrame, nodes: DataFrame, families: DataFrame, groups: DataFrame, similarity: float, most: int = 500_000) -> DataFrame:
    """Edges (u, v) that connect what the links at ``similarity`` within families (node, label) connect beyond groups (node,
    label), whose links are verified. ``sets`` (id, shingles) and ``nodes`` (id, sketch) are stored tables.

    Families that are one group already are left out. Families with over ``most`` shingles are cut into cells, each with two
    parts of the rows, so no task gathers a large family.
    """
    members = sets.select("id", F.size("shingles").cast("long").alias("size")).join(families.select(F.col("node").alias("id"), F.col("label").alias("family")), "id")
    members = members.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    members = stored(members, "members")
    parted = members.groupBy("family").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.sum("size").alias("size")).where("a < b")
    parted = checked_broadcast(stored(parted.select("family", F.ceil(F.col("size") / most).cast("int").alias("cuts")), "parted"))
    rows = stored(members.select("id", "family", "label", "size").join(parted, "family"), "apart")
    total, parts = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], tasks(sets.sparkSession)
    rows = rows.drop("size")
    rows = rows.join(sets, "id").join(nodes.select("id", "sketch"), "id").withColumn("own", F.pmod(F.hash("id"), F.col("cuts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    # small families share a cell of about as many shingles; each pair of parts of a large one has a cell of its own
    shared = max(4 * parts, total // most)
    rows = rows.withColumn("cell", F.when(F.col("cuts") > 1, F.xxhash64("family", "i", "j")).otherwise(F.pmod(F.xxhash64("family"), F.lit(shared))))
    return rows.select("cell", "family", "i", "j", "own", "id", "label", "sketch", "shingles").groupBy("cell").applyInArrow(_settle(similarity), "u long, v long")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, certain: int = 8, within: int = 16) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with one row of each group of near duplicates: that of the least doc_id.

    SimHash fingerprints over ``words``-word shingles meet at anchors, surely up to ``certain`` differing bits, nine pairs of ten
    at 14; texts at a similarity of 0.8 mostly differ in 6 to 14. Candidates are pairs within ``within`` bits whose eight minima agree
    in three, as 998 of 1,000 do at a similarity of 0.8 and 3 in a million unlike texts. Each text's nearest candidate is verified:
    their sets of shingles, of whole texts, must have a Jaccard similarity of at least ``similarity``. Then all pairs of a family
    (whatever candidates connect) that verified links leave apart are compared, at any distance in bits, if their minima agree
    in three. Groups are the components of verified links; equal texts are one node.

    Null text counts as empty text, and empty texts are equal. Texts are known by 128 bits; should two texts share the first
    64, one of them is left alone. Texts are shuffled only if a bounded filter says that they may be candidates or drops. Rows with a
    null doc_id stay and count for no group unless all there are null; rows that repeat the doc_id that stays, with a text of
    the group, stay too. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("id"), F.xxhash64(F.lit(1), text).alias("id2"))

    def run(batches):
        for b in batched(batches, 1024):
            hashes = (hashes_of(t.as_py(), words) for t in b.column(1))
            both = np.array([(majority(h), minima(h)) for h in hashes], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "id", "id2", "fp", "sketch"])

    rows = stored(keyed.mapInArrow(run, "doc_id long, id long, id2 long, fp long, sketch long"), "fingerprints")
    each = rows.groupBy("id", "id2").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    nodes = stored(each.groupBy("id").agg(F.min(F.struct("id2", "fp", "sketch", "least", "n")).alias("s")).select("id", "s.*"), "nodes")
    edges = stored(links(nodes, certain, within).groupBy("u", "v").agg(F.min("apart").alias("apart")), "candidates")
    ends = stored(edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct(), "ends")
    texts = KeyFilter(ends, "id").mark(keyed, F.col("id")).where("__maybe").groupBy("id").agg(F.min_by("text", "id2").alias("text"))
    sets = stored(texts.mapInArrow(_shingles(words), "id long, shingles array<long>"), "shingles")
    # each text's nearest candidate; what that leaves apart within a family is settled there, so a large group gives no more edges than texts
    nearest = edges.union(edges.select("v", "u", "apart")).groupBy("u").agg(F.min(F.struct("apart", "v")).alias("n")).select("u", F.col("n.v").alias("v"))
    nearest = stored(nearest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "nearest")
    both = nearest.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    verified = stored(both.where(shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)).select("u", "v"), "verified")
    labels = components(verified.unionByName(settle(sets, nodes, components(edges), components(verified), similarity)))
    known = nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "id2", "least", "n", F.coalesce("label", "id").alias("label"))
    keep = known.groupBy("label").agg(F.min("least").alias("keep"), F.sum("n").alias("rows"))
    keep = stored(known.select("id", "id2", "label").join(keep.where("rows > 1"), "label").select("id", "id2", "keep"), "keep")
    gone = rows.join(keep, ["id", "id2"]).where("doc_id <> keep").select(F.col("doc_id").alias("__doc_id"), F.col("id").alias("__id"), F.col("id2").alias("__id2")).distinct()
    gone = stored(gone.withColumn("__key", F.xxhash64("__doc_id", "__id")), "drops")
    marked = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__t": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)})
    marked = KeyFilter(gone, "__key").mark(marked, F.xxhash64("__d", "__t"))
    same = (F.col("__d") == F.col("__doc_id")) & (F.col("__t") == F.col("__id")) & (F.col("__t2") == F.col("__id2"))
    out = marked.where("not __maybe").unionByName(marked.where("__maybe").join(gone.drop("__key"), same, "left_anti"))
    return out.select(*docs.columns)
