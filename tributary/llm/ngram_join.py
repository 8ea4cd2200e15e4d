"""Similarity join of word n-gram sets with Bayesian pruning of candidates.

1. Every text gets its set of hashed five-word shingles and 128 MinHash values. Texts with the same set are one class
   of copies, which one representative stands for.
2. Representatives that agree in one of 32 bands of four values are candidates (a pair of similarity 0.8 shares no band
   with probability 5e-8). Within a band's bucket, MinHash values are compared sixteen at a time; a pair is dropped as
   soon as the posterior probability, under a uniform prior, that it reaches the threshold falls below the tolerance.
   Of the pairs that are never dropped a bucket passes on a spanning forest only, each tree hung on its smallest member,
   so a bucket of n makes n - 1 edges however many of its pairs agree, many of them the same in several bands. Where two
   blocks of a bucket meet, only the edges that join their trees are added.
3. Candidates that hang together form a component. Block by block, the pairs of a component are pruned again in the same
   way, and those that are never dropped, and no others, are verified exactly on the shingle sets. Only sums (links of a
   text) and spanning forests leave a block.
4. Components of verified links are the classes.

Buckets and components beyond BLOCK members are dealt out as pairs of blocks, so no task gets an unbounded group, and no
pair is skipped.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

WIDTH, VALUES, BANDS, STEP = 5, 128, 32, 16
THRESHOLD, TOLERANCE = Fraction(4, 5), 1e-6

#: Most members of a bucket or component that one task compares with each other or with as many others.
BLOCK, SET_BLOCK = 1024, 128

_rng = np.random.default_rng(20260517)
SEEDS = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)
ODDS = _rng.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a shorter text is one run, one without words none."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = len(w) - width + 1
    h = w[:m].copy()
    for k in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += w[k : k + m]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def minhash(found: np.ndarray) -> np.ndarray:
    """VALUES minima of the set under as many hash functions; all ones for the empty set."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    for a in range(0, len(x), 2048):
        part = (x[None, a : a + 2048] ^ SEEDS[:, None]) * ODDS[:, None]
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def sign_kernel(texts: list) -> dict:
    """Hash and size of the set, band keys (four 16-bit values each) and the low bytes of the MinHash values."""
    nids, sizes, keys, low = [], [], [], []
    for t in texts:
        s = shingles(t)
        v = minhash(s)
        nids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        sizes.append(len(s))
        keys.append(np.ascontiguousarray(v.astype(np.uint16).reshape(BANDS, -1)).view(np.int64).ravel())
        low.append(v.astype(np.uint8).tobytes())
    return {"nid": nids, "n": sizes, "keys": keys, "low": low}


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For each number of compared values, how many must agree so that P(similarity >= threshold) is not below tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail at t is the
    probability of at most m successes among n + 1 trials with success t.
    """
    out = np.zeros(VALUES + 1, np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        logs = np.cumsum(np.log(np.arange(1, n + 2)))
        fact = np.concatenate([[0.0], logs])
        k = np.arange(n + 2)
        pmf = np.exp(fact[n + 1] - fact[k] - fact[n + 1 - k] + k * np.log(threshold) + (n + 1 - k) * np.log1p(-threshold))
        out[n] = int(np.searchsorted(np.cumsum(pmf), tolerance))
    return out


LEAST = least_matches(float(THRESHOLD), TOLERANCE)


def survivors(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows of ``others`` are never dropped when compared with ``one`` (a row, or a row for each)."""
    at = np.arange(len(others))
    agree = np.zeros(len(others), np.int64)
    rows = one.ndim == 2
    for a in range(0, VALUES, STEP):
        left = one[at, a : a + STEP] if rows else one[None, a : a + STEP]
        agree[at] += (others[at, a : a + STEP] == left).sum(axis=1)
        at = at[agree[at] >= LEAST[a + STEP]]
        if not len(at):
            break
    return at


def trees(low: np.ndarray) -> np.ndarray:
    """For each row of a group the first row that surviving pairs connect it with."""
    root = np.arange(len(low))
    rest = np.arange(len(low))
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        reach = [first]
        while reach and len(rest):
            hit = survivors(low[reach.pop()], low[rest])
            if len(hit):
                found = rest[hit]
                root[found] = first
                reach += found.tolist()
                rest = np.delete(rest, hit)
    return root


def forest(low: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from rows to the first row of their tree. Where two blocks meet, only the first rows of the trees that each
    of them has by itself: what hangs on these is told where the block meets itself."""
    root, heads = trees(low), np.arange(len(low))
    if (own != own[0]).any():
        parts = [np.flatnonzero(own == x) for x in np.unique(own)]
        heads = np.concatenate([at[trees(low[at]) == np.arange(len(at))] for at in parts])
    heads = heads[root[heads] != heads]
    return heads, root[heads]


def bucket_kernel(batches):
    """Edges from buckets; columns band, key, one block, other block, rid, own block, low."""
    for table, starts in common.runs(batches, 4):
        ids, own = table.column(4).to_numpy(), table.column(5).to_numpy()
        low = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(-1, VALUES)
        ends = np.append(starts[1:], len(ids))
        sizes = ends - starts
        a: list[int] = []
        b: list[int] = []
        two = starts[sizes == 2]
        hit = survivors(low[two], low[two + 1])
        a += ids[two[hit]].tolist()
        b += ids[two[hit] + 1].tolist()
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            x, y = forest(low[s:e], own[s:e])
            a += ids[s:e][x].tolist()
            b += ids[s:e][y].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    common.give_back()


def linked(sets: list[np.ndarray], threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Which pairs of sets reach the threshold, from exact intersections by matrix products."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    kinds, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    inter = np.zeros((n, n))
    width = 4096
    cuts = np.searchsorted(place, np.arange(0, len(kinds) + width, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a == b:
            continue
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], place[a:b] - k * width] = 1.0
        inter += m @ m.T
    inter = np.rint(inter).astype(np.int64)
    p, q = threshold.numerator, threshold.denominator
    return q * inter >= p * (sizes[:, None] + sizes[None, :] - inter)


def undropped(low: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows that are never dropped; where ``own`` is given, only pairs of rows that differ in it."""
    agree = (low[:, None, :STEP] == low[None, :, :STEP]).sum(axis=2)
    i, j = np.nonzero(np.triu(agree >= LEAST[STEP], 1))
    if own is not None:
        apart = own[i] != own[j]
        i, j = i[apart], j[apart]
    agree = agree[i, j]
    for a in range(STEP, VALUES, STEP):
        agree = agree + (low[i, a : a + STEP] == low[j, a : a + STEP]).sum(axis=1)
        stay = agree >= LEAST[a + STEP]
        i, j, agree = i[stay], j[stay], agree[stay]
    return i, j


def agreeing(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Which of the pairs of sets reach the threshold: each by itself, or by matrix products where a set has many pairs."""
    rows = np.unique(np.concatenate([i, j]))
    if len(i) > 4 * len(rows):
        link = linked([sets[r] for r in rows], threshold)
        return link[np.searchsorted(rows, i), np.searchsorted(rows, j)]
    p, q = threshold.numerator, threshold.denominator
    out = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = len(sets[x]), len(sets[y])
        if q * min(a, b) >= p * max(a, b):
            inter = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            out[k] = q * inter >= p * (a + b - inter)
    return out


def verify_kernel(batches):
    """Links and local roots from components; columns component, block, other block, own block, rid, documents, low, set."""
    for table, starts in common.runs(batches, 3):
        one, two, own = (table.column(i).to_numpy() for i in (1, 2, 3))
        rid, docs = table.column(4).to_numpy(), table.column(5).to_numpy()
        low = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(-1, VALUES)
        sets = [np.frombuffer(s, np.uint64) for s in table.column(7).to_pylist()]
        out: tuple[list, list, list, list] = ([], [], [], [])
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(rid)).tolist()):
            # pairs inside a block are counted where the block meets itself
            i, j = undropped(low[s:e], own[s:e] if one[s] != two[s] else None)
            hit = agreeing(sets[s:e], i, j) if len(i) else np.zeros(0, bool)
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            root = np.arange(e - s)
            while True:  # smallest row that a row is connected with
                m, new = np.minimum(root[i], root[j]), root.copy()
                np.minimum.at(new, i, m)
                np.minimum.at(new, j, m)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            both, other = np.concatenate([i, j]), np.concatenate([j, i])
            some = np.unique(both)
            out[0].extend(rid[s:e][some].tolist())
            out[1].extend(rid[s:e][root[some]].tolist())
            out[2].extend(np.bincount(both, minlength=e - s)[some].tolist())
            weight = np.zeros(e - s, np.int64)
            np.add.at(weight, both, docs[s:e][other])
            out[3].extend(weight[some].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["rid", "local", "texts", "documents"])
    common.give_back()


def set_kernel(texts: list) -> dict:
    return {"found": [shingles(t).tobytes() for t in texts]}


def grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys next to each other in one partition, by rid: trees of several groups then hang on the same row."""
    return df.repartition(*keys).sortWithinPartitions(*keys, "rid")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document rows, classes of the representatives of copies).

    Document rows: doc_id, key (a hash of the text), nid (of its shingle set). Classes: nid, class_id (the smallest
    doc_id of the class), links (other documents of similarity 0.8 or more), linked_texts (other shingle sets so).
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    made = common.text_kernel(sign_kernel, "nid binary, n int, keys array<bigint>, low binary")(F.col("text"))
    base = common.materialized(docs.select(F.col("doc_id"), F.xxhash64("text").alias("key"), made.alias("m")).select("doc_id", "key", "m.*"))
    me = F.struct(F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    reps = base.groupBy("nid").agg(F.min(me).alias("me"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("low").alias("low"))
    reps = common.materialized(reps.select(F.monotonically_increasing_id().alias("rid"), "nid", F.col("me.doc_id").alias("doc_id"), F.col("me.key").alias("key"), "docs", "n", "keys", "low"))
    # bands whose bucket has company
    bands = reps.where("n > 0").select("rid", F.posexplode("keys").alias("band", "bucket"))
    full = bands.groupBy("band", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    company = bands.join(full, ["band", "bucket"])
    mine = company.groupBy("rid").agg(F.collect_list(F.struct("band", "bucket", "members")).alias("where"))
    members = reps.select("rid", "low").join(mine, "rid").select("rid", "low", F.explode("where").alias("w")).select("w.*", "rid", "low")
    dealt = blocks(members, "members", BLOCK)
    edges = grouped(dealt.select("band", "bucket", "one", "two", "rid", "own", "low"), ["band", "bucket", "one", "two"]).mapInArrow(bucket_kernel, "a bigint, b bigint")
    near = common.materialized(graph.components(edges))
    sizes = near.groupBy("root").agg(F.count("*").alias("members"))
    # texts of the representatives in components of two or more
    wanted = common.salted(near, sizes.hint("merge"), "root").withColumnRenamed("node", "rid").join(reps.select("rid", "doc_id", "key", "docs", "low"), "rid")
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    found = common.text_kernel(set_kernel, "found binary")(F.col("text")).getField("found")
    sets = wanted.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(texts, ["doc_id", "key"]).dropDuplicates(["rid"]).select("root", "members", "rid", "docs", "low", found.alias("found"))
    dealt = blocks(sets, "members", SET_BLOCK).select("root", "one", "two", "own", "rid", "docs", "low", "found")
    checked = grouped(dealt, ["root", "one", "two"]).mapInArrow(verify_kernel, "rid bigint, local bigint, texts bigint, documents bigint")
    checked = common.materialized(checked)
    links = checked.groupBy("rid").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    roots = common.materialized(graph.components(checked.select(F.col("rid").alias("a"), F.col("local").alias("b"))))
    members = reps.select("rid", "doc_id").join(roots.withColumnRenamed("node", "rid"), "rid")
    named = common.salted(members.select("rid", "root"), members.groupBy("root").agg(F.min("doc_id").alias("class_id")).hint("merge"), "root")
    named = reps.select("rid", "nid", "doc_id", "docs").join(links, "rid", "left").join(named, "rid", "left")
    classes = named.select("nid", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("root", "rid").alias("root"), (F.coalesce("documents", F.lit(0)) + F.col("docs") - 1).alias("links"), F.coalesce("texts", F.lit(0)).alias("linked_texts"))
    return base.select("doc_id", "key", "nid"), classes


#: Stands for a null id where rows are joined by id and text.
NO_ID = -(2**63)


def blocks(rows: DataFrame, members: str, size: int) -> DataFrame:
    """``rows`` with their own block and each pair of blocks (one <= two) that they take part in."""
    n = F.ceil(F.col(members) / size).cast("int")
    own = rows.withColumn("__n", n).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("__n")).cast("int"))
    return own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).select(*rows.columns, "own", F.least("own", "__other").alias("one"), F.greatest("own", "__other").alias("two"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, links, linked_texts.

    Null, empty and blank texts have the empty set and are copies of each other; texts of one to four words are one
    shingle. Repeated rows count as copies. A class made of rows without ids only has a null class_id; of equal ids the
    first is taken by text hash. Texts of any length are whole sets. An empty table gives an empty result; other columns
    than doc_id and text, whatever their names, are not looked at.
    """
    rows, named = join(docs)
    return common.salted(rows.select("nid", "doc_id", "key"), named.hint("merge"), "nid", 8).select("doc_id", "class_id", "links", "linked_texts")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, that come first (by doc_id, then text hash) in their class.

    Null ids come before all others. Of rows that agree in doc_id and text one stays. All null, empty and blank texts are
    one class, so one of them stays. An empty table gives an empty result.
    """
    rows, named = join(docs)
    me = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("key").alias("key"))
    # the first row of each set of shingles, summed up before the shuffle, meets its class
    rows = rows.groupBy("nid").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "key")).alias("me")).select("nid", "me.*")
    stay = rows.join(named, "nid").groupBy("root").agg(F.min(me).alias("m")).select(F.col("m.id").alias("__id"), F.col("m.key").alias("__key"))
    names = docs.columns
    row = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.xxhash64("text").alias("__key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    kept = row.join(stay, ["__id", "__key"]).dropDuplicates(["__id", "__key"])
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in names])
