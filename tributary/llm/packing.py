"""Best-fit packing of documents into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so an instance of any number of pieces is a histogram of at most
``capacity`` counts. ``solve`` works on that histogram: first the Martello-Toth dominance reduction fixes bins whose
contents provably dominate every alternative (a piece that fits with no other; a piece and the one that fills the bin;
a piece and the largest that fits beside it, where no two smaller ones could do better), then best-fit decreasing packs
the rest. All pieces of one length are alike, so bins are made in groups, and the plan is a table of intervals: the
pieces of length L and rank r to s go to bins b.. at an offset. Its size depends on the capacity, not on the input.

Every piece gets a rank among those of its length without a sort: its place within its input partition plus the number
of such pieces in the partitions before. A look-up in the plan then gives its sequence and offset.
"""

from __future__ import annotations

import bisect
import json
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import WORDS, ByteBpe, byte_letters

CAPACITY = 4096

#: Chunks of a generation of a worker's cache; a full one gives way to a new one, which takes over what it meets again.
CACHE_CHUNKS = 250_000

#: Longer chunks leave the cache after their texts, so that its bytes are bounded too.
LONG_CHUNK = 256

#: Bytes of text that are cut and merged at once: 155 MB beside the vocabulary for 4 MB, 69 MB for 1 MB.
SLICE_BYTES = 1 << 20

#: Marks that are tokens of their own behind a word.
MARKS = ".,;:!?"

#: White space to Python that is none to the tokenizer.
ODD = [chr(c) for c in range(0x1C, 0x20)]


#: Kinds of bytes: letters, digits and other signs of ASCII; the rest is left to the library, as are apostrophes (which
#: may begin a contraction) and bars (which may belong to a special token).
LETTERS, DIGITS, SIGNS, REST = range(4)
KINDS = np.array([REST if b > 127 or chr(b) in "'|" else LETTERS if chr(b).isalpha() else DIGITS if chr(b).isdigit() else SIGNS for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: Longer chunks are left to the library: a round of merges goes over the whole word.
PLAIN_CHUNK = 64


class WordBpe(ByteBpe):
    """The merges of a vocabulary file of the tokenizers format whose words end with a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model["continuing_subword_prefix"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path} is not a BPE file with a suffix of words")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.base, self.last = (np.array([vocab[c + end] for c in byte_letters()], np.int32) for end in ("", suffix))
        self.take_merges(vocab, model["merges"])

    def tokens(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words of bytes, one after the other, that begin at ``starts``."""
        flat, ends = self.base[data], np.append(starts[1:], len(data))
        flat[ends - 1] = self.last[data[ends - 1]]
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(starts), WORDS):
            s, e = starts[a : a + WORDS], ends[a : a + WORDS]
            i, n = self.merged(flat[s[0] : e[-1]], e - s)
            ids.append(i)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


class ChunkTokens:
    """Token ids of texts by a tokenizer that drops white space and lets no token cross it: different chunks only.

    Chunks of ASCII are cut into words and merged together as arrays of bytes; others go chunk by chunk and are cached.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = WordBpe(path)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []
        self.marks = {"": b""} | {m: self.fresh([m])[0] for m in MARKS}

    def fresh(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def fresh_words(self, words: list[str]) -> list[bytes]:
        """Ids of normalised words of letters only, each of which is one word to the tokenizer: its BPE model alone."""
        if not words:
            return []
        data = [w.encode() for w in words]
        size = np.array([len(d) for d in data], np.int64)
        ids, counts = self.words.tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size)
        joined, ends = ids.astype("<u4").tobytes(), np.cumsum(counts * 4).tolist()
        return [joined[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, chunks: set[str]) -> None:
        """Puts new chunks into the cache. A chunk of letters, with a mark behind it or not, is its word and its mark."""
        cache, normal = self.cache, self.tokenizer.normalizer.normalize_str
        split: list[tuple[str, str, str]] = []
        others: list[str] = []
        words: set[str] = set()
        for c in chunks:
            word, mark = (c, "") if c.isalpha() else (c[:-1], c[-1])
            if mark and not (mark in MARKS and word.isalpha()):
                others.append(c)
                continue
            if word.isascii():
                word = word.lower()
            elif word.lower() == word and is_normalized("NFC", word):
                pass
            elif not (word := normal(word)).isalpha():
                others.append(c)  # it gains a mark that would join the one behind it
                continue
            if len(word) > PLAIN_CHUNK:
                others.append(c)
                continue
            words.add(word)
            split.append((c, word, mark))
        todo = [*words.difference(cache)]
        cache.update(zip(todo, self.fresh_words(todo)))
        for a in range(0, len(others), 5_000):
            cache.update(zip(others[a : a + 5_000], self.fresh(others[a : a + 5_000])))
        for c, word, mark in split:
            cache[c] = cache[word] + self.marks[mark]
        self.long += [c for some in (chunks, words) for c in some if len(c) > LONG_CHUNK]

    def known(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks by way of the cache."""
        new = set(chunks).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.old, self.cache = self.cache, {}
            new = set(chunks)
        again = new & self.old.keys()
        self.cache.update((c, self.old[c]) for c in again)
        self.learn(new - again - {""})
        out = [self.cache[c] if c else b"" for c in chunks]
        for c in self.long:
            self.cache.pop(c, None)
        self.long.clear()
        return out

    def plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk) of chunks of ASCII letters, digits and signs, none of them empty."""
        at = np.frombuffer(chunks.buffers()[1], np.int64, len(chunks) + 1, 8 * chunks.offset)
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[at[0] : at[-1]]
        kind = KINDS[data]
        begins = np.append(True, kind[1:] != kind[:-1]) | (kind == DIGITS)
        begins[at[:-1] - at[0]] = True
        starts = np.flatnonzero(begins)
        ids, counts = self.words.tokens(LOWER[data], starts)
        return ids, np.add.reduceat(counts, np.searchsorted(starts, at[:-1] - at[0]))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd = {i: self.fresh([t])[0] for i, t in enumerate(texts) if any(o in t for o in ODD)}
        split = pc.utf8_split_whitespace(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        at = np.frombuffer(chunks.buffers()[1], np.int64, len(chunks) + 1, 8 * chunks.offset) if len(chunks) else np.zeros(1, np.int64)
        size = np.diff(at)
        rest = np.concatenate([[0], np.cumsum(KINDS[np.frombuffer(chunks.buffers()[2], np.uint8)[: at[-1]]] == REST)]) if at[-1] else np.zeros(1, np.int64)
        plain = (size > 0) & (size <= PLAIN_CHUNK) & (rest[at[1:]] == rest[at[:-1]])
        # the ids of plain chunks first, then those of the others; the empty chunk has none
        flat, counts = self.plain(chunks.filter(pa.array(plain))) if plain.any() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        others = self.known(chunks.filter(pa.array(~plain)).to_pylist())
        flat = np.concatenate([flat.astype("<u4"), np.frombuffer(b"".join(others), "<u4")])
        counts = np.concatenate([counts, np.array([len(o) // 4 for o in others], np.int64)])
        place = np.empty(len(chunks), np.int64)
        place[plain], place[~plain] = np.arange(plain.sum()), np.arange(plain.sum(), len(chunks))
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(flat))
        order = place[coded.indices.to_numpy()]
        made = np.ascontiguousarray(lists.take(pa.array(order)).flatten().to_numpy(), "<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(counts[order])])[split.offsets.to_numpy() - split.offsets[0].as_py()] * 4
        return [odd[i] if i in odd else made[a:b] for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]

    def forget(self) -> None:
        """Gives the memory of the cache back: a worker lives on after a task, and other operators need the room."""
        self.cache, self.old = {}, {}
        common.give_back()


_LOADED: dict[str, ChunkTokens] = {}


def loaded(path: str) -> ChunkTokens:
    if path not in _LOADED:
        _LOADED[path] = ChunkTokens(path)
    return _LOADED[path]


def piece_kernel(path: str, capacity: int, end_id: int):
    """Pieces of each text with their rank among the pieces of equal length that the task has seen before."""

    def run(batches):
        from pyspark import TaskContext

        os_threads()
        tokens = loaded(path)
        part = TaskContext.get().partitionId()
        before = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        try:
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for a, b in common.slices(texts, limit=SLICE_BYTES):
                    source, piece, start, length, crc = [], [], [], [], []
                    for i, ids in enumerate(tokens.ids([t or "" for t in texts[a:b]]), a):
                        ids += end
                        n = len(ids) // 4
                        for k, s in enumerate(range(0, n, capacity)):
                            m = min(capacity, n - s)
                            source.append(i)
                            piece.append(k)
                            start.append(s)
                            length.append(m)
                            crc.append(zlib.crc32(ids[4 * s : 4 * (s + m)]))
                    size = np.array(length, np.int64)
                    order = np.argsort(size, kind="stable")
                    rank = np.empty(len(size), np.int64)
                    first = np.searchsorted(size[order], size[order], side="left")
                    rank[order] = np.arange(len(size)) - first + before[size[order]]
                    before += np.bincount(size, minlength=capacity + 1)
                    kept = [batch.column(i).take(pa.array(source, pa.int64())) for i in range(1, batch.num_columns)]
                    made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(rank)]
                    yield pa.RecordBatch.from_arrays(kept + made, names=[f"keep{i}" for i in range(len(kept))] + ["piece", "start", "length", "ids_crc32", "part", "place"])
        finally:
            tokens.forget()

    return run


def os_threads() -> None:
    """One thread for each task: tasks already take all cores."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


class Bins:
    """Open bins in groups of equal contents, and the intervals of pieces that they have got."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left: (first bin, number of bins)
        self.rooms: list[int] = []
        self.used: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, rank from, rank to, first bin, a bin's pieces, offset

    def fresh(self, n: int) -> int:
        first, self.n = self.n, self.n + n
        return first

    def put(self, length: int, first: int, bins: int, each: int, offset: int) -> None:
        """``each`` pieces of a length go to each of some bins, side by side from an offset on."""
        r = self.used.get(length, 0)
        self.rows.append((length, r, r + bins * each, first, each, offset))
        self.used[length] = r + bins * each

    def keep_open(self, room: int, first: int, bins: int) -> None:
        if not bins or not room:
            return
        if room not in self.open:
            self.open[room] = []
            bisect.insort(self.rooms, room)
        self.open[room].append((first, bins))

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Some open bins with that room, ``most`` at most."""
        first, bins = self.open[room].pop()
        if bins > most:
            self.open[room].append((first + most, bins - most))
            bins = most
        if not self.open[room]:
            del self.open[room]
            self.rooms.remove(room)
        return first, bins


def reduce(left: dict[int, int], bins: Bins) -> None:
    """Fixes dominating sets, largest piece first, until none is found for any length.

    For the largest piece j let i be the largest other that fits beside it. {j} dominates if none fits; {j, i} dominates
    if it fills the bin, or if no two others fit beside j, or if no two others that fit are together longer than i.
    """
    capacity = bins.capacity
    sizes = sorted(left)
    skip: set[int] = set()
    for j in reversed(sizes):
        while left.get(j, 0) and j not in skip:
            room = capacity - j
            present = sorted(s for s, n in left.items() if n - (s == j) > 0)
            k = bisect.bisect_right(present, room)
            if not k:
                n = left.pop(j)
                bins.put(j, bins.fresh(n), n, 1, 0)
                continue
            i = present[k - 1]
            small = present[0]
            two = 2 * small if left[small] - (small == j) > 1 else small + (present[1] if len(present) > 1 else capacity + 1)
            if i < room and two <= room:
                # the longest two others beside j: more than i alone would leave the choice open
                best = longest_two(present[:k], left, j, room)
                three = 3 * small <= room
                if three or best > i:
                    skip.add(j)
                    continue
            n = left[j] // 2 if i == j else min(left[j], left[i])
            first = bins.fresh(n)
            bins.put(j, first, n, 1, 0)
            bins.put(i, first, n, 1, j)
            for s in (j, i):
                left[s] -= n
                if not left[s]:
                    del left[s]


def longest_two(present: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest total of two pieces (other than one j) that fit in ``room``; 0 if none."""
    best, a, b = 0, 0, len(present) - 1
    while a <= b:
        s = present[a] + present[b]
        if s > room or (a == b and left[present[a]] - (present[a] == j) < 2):
            b -= 1
        else:
            best = max(best, s)
            a += 1
    return best


def best_fit(left: dict[int, int], bins: Bins) -> None:
    """Best-fit decreasing: each piece goes where it leaves the least room; equal pieces go together."""
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(bins.rooms, length)
            if at < len(bins.rooms):
                room = bins.rooms[at]
                each = room // length
                if n < each:
                    first, b = bins.take(room, 1)
                    each = n
                else:
                    first, b = bins.take(room, n // each)
            else:
                room = bins.capacity
                each = min(n, room // length)
                b = n // each
                first = bins.fresh(b)
            bins.put(length, first, b, each, bins.capacity - room)
            bins.keep_open(room - each * length, first, b)
            n -= b * each
    left.clear()


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[int, np.ndarray]:
    """(number of bins, intervals sorted by length and rank) for the counts of each length."""
    bins = Bins(capacity)
    left = {int(s): int(n) for s, n in histogram.items() if n}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("lengths must be from 1 to the capacity")
    reduce(left, bins)
    best_fit(left, bins)
    return bins.n, np.array(sorted(bins.rows), np.int64).reshape(-1, 6)


def place(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces of given length and rank."""
    shift = np.int64(48)
    at = np.searchsorted(plan[:, 0] << shift | plan[:, 1], length << shift | rank, side="right") - 1
    row = plan[at]
    k = rank - row[:, 1]
    return row[:, 3] + k // row[:, 4], row[:, 5] + k % row[:, 4] * length


def pack(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Columns ``keep`` with piece, start, length, ids_crc32, sequence_id and offset of every piece of every text.

    A null or empty text is one piece with the end id alone. Each row is packed as it stands: repeated rows and null ids
    are pieces of their own, ties of length are told apart by place, and a text of any length is cut into pieces, none
    dropped. An empty table gives an empty result. Columns of ``keep`` are named before the new ones, which must differ.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    named = docs.select("text", *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)])
    schema = ", ".join([f"keep{i} {f.dataType.simpleString()}" for i, f in enumerate(named.schema.fields[1:])] + ["piece int", "start bigint", "length bigint", "ids_crc32 bigint", "part int", "place bigint"])
    pieces = common.materialized(named.mapInArrow(piece_kernel(path, capacity, end_id), schema))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    _, plan = solve(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)
    before = by_part.select("part", "length", (F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and current row)") - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))

    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        b, o = place(shared.value, length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(b, pa.int64()), pa.array(o, pa.int64())], names=["sequence_id", "offset"])

    run.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    put = F.arrow_udf(run, returnType="sequence_id bigint, offset bigint")(F.col("length"), F.col("rank"))
    names = [F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)]
    out = ranked.select(*names, "piece", "start", "length", "ids_crc32", put.alias("__at"))
    return out.select(*keep, "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset")
