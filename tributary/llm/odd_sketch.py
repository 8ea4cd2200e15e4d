"""Near-duplicate components by odd sketches of MinHash samples.

1. Every text gets its set of hashed four-word shingles, 128 MinHash samples in 32 bands, and an odd sketch: each sample
   flips one of 512 bits, so samples that two sets share cancel out in the XOR of their sketches, whose population count
   tells how many they do not share. Texts of one set are copies, which one representative stands for.
2. Representatives that agree in a band are candidates (a pair of similarity 0.8 shares no band with probability 5e-8).
   Within a bucket sketches are compared. Pairs that a similarity of 0.8 could still bring forth (but for a probability
   of 1e-6) leave it as one spanning forest, pairs whose estimate reaches 0.8 as another.
3. Each text is verified on the full sets against the smallest one that it has an edge of the second forest to; most
   near copies are united by that, one comparison each.
4. Where a component of the first forest still holds several united parts, members of different parts are compared in
   blocks by their sketches, likeliest first, and verified on the full sets until they are united or no pair is left. The
   largest part never meets itself, so a group of n near copies with m outsiders costs m x n sketches, not n x n.
5. Components of the verified links are the result. Buckets, stars and components beyond the size of a block are dealt
   out to many tasks; no pair is skipped that could unite two parts.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .ngram_join import BANDS, BLOCK, NO_ID, VALUES, blocks, grouped, minhash, shingles

WIDTH, BITS = 4, 512
THRESHOLD, TOLERANCE = Fraction(4, 5), 1e-6

#: Texts that one task compares with the middle of a star; texts, and shingles in them, of one block of step 4.
STAR, PART, PART_SHINGLES = 64, 128, 2 << 20

_rng = np.random.default_rng(20261127)
FOLDS = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)


def sketch(samples: np.ndarray) -> bytes:
    """Parities of the bits that the samples flip; the place of a bit hangs on the sample and its number."""
    x = (samples ^ FOLDS) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    flips = np.bincount(x >> np.uint32(32 - BITS.bit_length() + 1), minlength=BITS)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity of two sets whose sketches differ in so many bits."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(2 * differing < BITS, 1 + BITS / (4 * VALUES) * np.log1p(-2 * np.minimum(differing, BITS / 2) / BITS), -np.inf)


def most_bits(similarity: float, tolerance: float) -> int:
    """The number of differing bits that a pair of this similarity exceeds with a probability of ``tolerance`` at most.

    Of VALUES samples a binomial number differs; each of these flips one bit of either sketch, and the number of odd
    bits after t flips is a chain that steps down from k with probability k / BITS and up otherwise.
    """
    k = np.arange(VALUES + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, VALUES + 1)))])
    unlike = np.exp(logs[VALUES] - logs[k] - logs[VALUES - k] + k * np.log1p(-similarity) + (VALUES - k) * np.log(similarity))
    odd, total = np.zeros(BITS + 1), np.zeros(BITS + 1)
    odd[0] = 1.0
    n = np.arange(BITS + 1)
    for d in range(VALUES + 1):
        total += unlike[d] * odd
        for _ in range(2):
            step = np.zeros(BITS + 1)
            step[1:] += (odd * (1 - n / BITS))[:-1]
            step[:-1] += (odd * n / BITS)[1:]
            odd = step
    above = 1.0 - np.cumsum(total)
    return int(np.flatnonzero(above <= tolerance)[0])


#: Bits up to which a pair may reach the threshold, and up to which its estimate does.
LOOSE = most_bits(float(THRESHOLD), TOLERANCE)
TIGHT = int(np.flatnonzero(estimate(np.arange(BITS // 2)) >= float(THRESHOLD))[-1])


def sign_kernel(texts: list) -> dict:
    """Hash and size of the set, band keys (four 16-bit samples each) and the odd sketch; nothing but the size without words."""
    nids, sizes, keys, bits = [], [], [], []
    for t in texts:
        s = shingles(t.lower() if t else None, WIDTH)
        v = minhash(s)
        nids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        sizes.append(len(s))
        keys.append(np.ascontiguousarray(v.astype(np.uint16).reshape(BANDS, -1)).view(np.int64).ravel() if len(s) else None)
        bits.append(sketch(v) if len(s) else None)
    return {"nid": nids, "n": sizes, "keys": keys, "bits": bits}


def set_kernel(texts: list) -> dict:
    return {"found": [shingles(t.lower() if t else None, WIDTH).tobytes() for t in texts]}


def differing(bits: np.ndarray, sizes: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Bits in which the sketch of ``x`` differs from others; all of them where the sizes alone rule the threshold out."""
    out = np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1, dtype=np.int64)
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    out[q * np.minimum(sizes[others], sizes[x]) < p * np.maximum(sizes[others], sizes[x])] = BITS
    return out


def forest(bits: np.ndarray, sizes: np.ndarray, rows: np.ndarray, limit: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest of the pairs of ``rows`` that differ in ``limit`` bits at most, and the tree of each row."""
    edges: list[tuple[int, int]] = []
    tree = np.full(len(bits), -1)
    rest = rows
    while len(rest):
        first = int(rest[0])
        tree[first] = first
        reach, rest = [first], rest[1:]
        while reach and len(rest):
            x = reach.pop(0)
            near = differing(bits, sizes, x, rest) <= limit
            found = rest[near].tolist()
            tree[found] = first
            edges += [(x, y) for y in found]
            reach += found
            rest = rest[~near]
    return edges, tree


class Parts:
    """Disjoint sets of labels."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while (y := self.up.get(x, x)) != root:
            self.up[x] = root
            x = y
        return root

    def unite(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def across(bits: np.ndarray, sizes: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int, bool]]:
    """Edges between two blocks that unite trees of either: one for each pair of trees that is not yet united."""
    _, tree = forest(bits, sizes, one, LOOSE)
    _, more = forest(bits, sizes, two, LOOSE)
    parts, out = Parts(), []
    left = len(np.unique(tree[one])) + len(np.unique(more[two])) - 1
    for x in one.tolist():
        apart = differing(bits, sizes, x, two)
        order = np.argsort(apart, kind="stable")
        order = order[apart[order] <= LOOSE]
        trees, firsts = np.unique(more[two[order]], return_index=True)
        for t, at in zip(trees.tolist(), order[firsts].tolist()):
            if parts.unite((0, int(tree[x])), (1, t)):
                out.append((x, int(two[at]), bool(apart[at] <= TIGHT)))
                left -= 1
        if left <= 0:
            break
    return out


def bucket_kernel(batches):
    """Edges (a < b, tight) from buckets; columns band, key, one block, other block, own block, rid, n, bits, by rid."""
    for table, starts in common.runs(batches, 4):
        one, two, own, rid, n = (table.column(i).to_numpy() for i in (2, 3, 4, 5, 6))
        bits = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        out: tuple[list, list, list] = ([], [], [])
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(rid)).tolist()):
            b, sizes, rows = bits[s:e], n[s:e], np.arange(e - s)
            if one[s] == two[s]:
                made = [(x, y, False) for x, y in forest(b, sizes, rows, LOOSE)[0]] + [(x, y, True) for x, y in forest(b, sizes, rows, TIGHT)[0]]
            else:
                made = across(b, sizes, rows[own[s:e] == one[s]], rows[own[s:e] == two[s]])
            for x, y, tight in made:
                x, y = int(rid[s + x]), int(rid[s + y])
                out[0].append(min(x, y))
                out[1].append(max(x, y))
                out[2].append(tight)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["a", "b", "tight"])


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    a, b = len(one), len(two)
    p, q = THRESHOLD.numerator, THRESHOLD.denominator
    if q * min(a, b) < p * max(a, b):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return q * both >= p * (a + b - both)


def star_kernel(batches):
    """Verified edges of stars; columns middle, chunk, outer (false for the middle itself, which comes first), rid, found."""
    held, middle = None, np.zeros(0, np.uint64)
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for m, c, outer, rid, found in zip(*[batch.column(i) for i in range(5)]):
            m, c, rid, found = m.as_py(), c.as_py(), rid.as_py(), np.frombuffer(found.as_buffer(), np.uint64)
            if not outer.as_py():
                held, middle = (m, c), found.copy()
            elif held == (m, c) and linked(middle, found):
                a.append(m)
                b.append(rid)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def part_kernel(batches):
    """Verified edges between parts; columns root, one block, other block, own block, part, rid, n, bits, found."""
    for table, starts in common.runs(batches, 3):
        one, two, own, part, rid, n = (table.column(i).to_numpy() for i in range(1, 7))
        bits = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column(8).to_pylist()]
        a: list[int] = []
        b: list[int] = []
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(rid)).tolist()):
            pairs = []
            for x in range(s, e):
                ys = np.arange(x + 1, e)
                ys = ys[(part[ys] != part[x]) & ((own[ys] != own[x]) | (one[s] == two[s]))]
                apart = differing(bits, n, x, ys)
                pairs += [(d, x, y) for d, y in zip(apart.tolist(), ys.tolist()) if d <= LOOSE]
            united = Parts()
            for _, x, y in sorted(pairs):
                i, j = int(part[x]), int(part[y])
                if united.find(i) != united.find(j) and linked(sets[x], sets[y]):
                    united.unite(i, j)
                    a.append(int(rid[x]))
                    b.append(int(rid[y]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b, tight): edges of the forests of all buckets with company, each pair once."""
    bands = reps.select("rid", F.posexplode("keys").alias("band", "bucket"))
    full = bands.groupBy("band", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    mine = bands.join(full, ["band", "bucket"]).groupBy("rid").agg(F.collect_list(F.struct("band", "bucket", "members")).alias("where"))
    members = reps.select("rid", "n", "bits").join(mine, "rid").select("rid", "n", "bits", F.explode("where").alias("w")).select("w.*", "rid", "n", "bits")
    dealt = blocks(members, "members", BLOCK).select("band", "bucket", "one", "two", "own", "rid", "n", "bits")
    keys = ["band", "bucket", "one", "two"]
    edges = dealt.repartition(*keys).sortWithinPartitions(*keys, "rid").mapInArrow(bucket_kernel, "a bigint, b bigint, tight boolean")
    return edges.groupBy("a", "b").agg(F.max("tight").alias("tight"))


def candidate_sets(docs: DataFrame, reps: DataFrame, near: DataFrame, edges: DataFrame) -> DataFrame:
    """Full sets of all candidates, with the component of each and the star that it is verified in (or is the middle of)."""
    stars = edges.where("tight").groupBy(F.col("b").alias("rid")).agg(F.min("a").alias("middle"))
    ways = stars.groupBy("middle").agg(F.ceil(F.count("*") / STAR).cast("int").alias("ways")).hint("merge")
    stars = common.salted(stars, ways, "middle", 8)
    own = ways.select(F.col("middle").alias("rid"), F.col("ways").alias("own_ways"))
    wanted = near.withColumnRenamed("node", "rid").join(stars, "rid", "left").join(own, "rid", "left")
    wanted = reps.select("rid", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "key", "n", "bits").join(wanted, "rid")
    # the text of a row that is there often is sent once by each task
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    texts = texts.groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    found = common.text_kernel(set_kernel, "found binary")(F.col("text")).getField("found")
    return texts.join(wanted, ["doc_id", "key"]).select("rid", "root", "n", "bits", "middle", "ways", "own_ways", found.alias("found"))


def star_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) of texts with the middles of their stars, verified on the full sets."""
    chunk = F.pmod(F.xxhash64("rid"), F.col("ways")).cast("int")
    outer = F.when(F.col("middle").isNotNull(), F.array(F.struct(F.col("middle").alias("m"), chunk.alias("c")))).otherwise(F.expr("array()"))
    inner = F.when(F.col("own_ways").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("own_ways") - 1), lambda c: F.struct(F.col("rid").alias("m"), c.alias("c")))).otherwise(F.expr("array()"))
    dealt = sets.where("middle is not null or own_ways is not null").select("rid", "found", F.explode(F.concat(outer, inner)).alias("at"))
    dealt = dealt.select("at.m", "at.c", (F.col("at.m") != F.col("rid")).alias("outer"), "rid", "found")
    return dealt.repartition("m", "c").sortWithinPartitions("m", "c", "outer").mapInArrow(star_kernel, "a bigint, b bigint")


def part_links(sets: DataFrame, stars: DataFrame) -> DataFrame | None:
    """Links between different parts of one component; None where every component is one part.

    The part of a text is the middle that it is linked with, or that middle's own, four steps up at most: texts that the
    stars unite by longer ways are in different parts and may be compared once more.
    """
    up = stars.select(F.col("b").alias("rid"), F.col("a").alias("part"))
    for _ in range(2):
        up = up.join(up.select(F.col("rid").alias("part"), F.col("part").alias("above")), "part", "left").select("rid", F.coalesce("above", "part").alias("part"))
    rows = sets.select("rid", "root", "n").join(up, "rid", "left").withColumn("part", F.coalesce("part", "rid"))
    sizes = rows.groupBy("root", "part").agg(F.count("*").alias("m"), F.sum("n").alias("w")).groupBy("root")
    sizes = sizes.agg(F.count("*").alias("parts"), F.max(F.struct("m", "part", "w")).alias("most"), F.sum("m").alias("m"), F.sum("w").alias("w")).where("parts > 1")
    n = lambda m, w: F.ceil(F.greatest(m / PART, w / PART_SHINGLES)).cast("int")
    sizes = sizes.select("root", F.col("most.part").alias("main"), n(F.col("m") - F.col("most.m"), F.col("w") - F.col("most.w")).alias("others"), n(F.col("most.m"), F.col("most.w")).alias("mains"))
    todo = common.materialized(common.salted(rows.select("rid", "root", "part"), sizes.hint("merge"), "root"))
    if todo.isEmpty():
        return None
    deal, main = F.xxhash64("rid"), F.col("part") == F.col("main")
    own = F.when(main, F.col("others") + F.pmod(deal, F.col("mains"))).otherwise(F.pmod(deal, F.col("others"))).cast("int")
    last = F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    todo = todo.select("rid", "part", own.alias("own"), last.alias("last"))
    dealt = sets.select("rid", "root", "n", "bits", "found").join(todo, "rid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("root", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "part", "rid", "n", "bits", "found")
    return grouped(dealt, ["root", "one", "two"]).mapInArrow(part_kernel, "a bigint, b bigint")


def components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts without words, null and empty ones among them, have no shingles, are linked with nothing and are kept; a text
    of one to three words is one shingle. A component is named by its smallest doc_id, and its rows of that id are kept.
    Rows without id take part; they are kept where no row of their component has an id. Repeated rows are copies. Texts
    of any length are whole sets. An empty table gives an empty result; other columns than doc_id and text, whatever
    their names, are not looked at.
    """
    common.bound_batches(docs.sparkSession)
    made = common.text_kernel(sign_kernel, "nid binary, n int, keys array<bigint>, bits binary")(F.col("text"))
    base = common.materialized(docs.select("doc_id", F.xxhash64("text").alias("key"), made.alias("m")).select("doc_id", "key", "m.*"))
    me = F.struct(F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    reps = base.where("n > 0").groupBy("nid").agg(F.min(me).alias("me"), F.min("doc_id").alias("first"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    reps = common.materialized(reps.select(F.monotonically_increasing_id().alias("rid"), "nid", F.col("me.doc_id").alias("doc_id"), F.col("me.key").alias("key"), "first", "docs", "n", "keys", "bits"))
    edges = common.materialized(candidates(reps))
    near = graph.components(edges.select("a", "b"))
    sets = common.materialized(candidate_sets(docs, reps, near, edges))
    stars = common.materialized(star_links(sets))
    links = part_links(sets, stars)
    parts = graph.components(stars if links is None else stars.union(links))
    named = reps.select("rid", "nid", "docs", "first").join(parts.withColumnRenamed("node", "rid"), "rid", "left").where("docs > 1 or root is not null")
    named = named.select("nid", "first", F.coalesce("root", "rid").alias("root"))
    named = common.salted(named, named.groupBy("root").agg(F.min("first").alias("component_id")).hint("merge"), "root").select("nid", "component_id", F.lit(True).alias("named"))
    rows = common.salted(base.select("doc_id", "nid", "n"), named.hint("merge"), "nid", 8, "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
