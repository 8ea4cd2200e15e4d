"""Language-model scores by Brown class bigrams.

Counts of all words of all training texts are gathered by a map-side combined aggregation. All words that occur LEAST_COUNT
times, and more often where more than HEAD words do (by a histogram of counts), get classes by exchange clustering. First the
commonest words are exchanged on the driver: each in turn moves to the class that raises the likelihood of the class
bigrams most, until no word moves. Then come distributed rounds over all head words: what stands before and after each is
counted by class in Spark, each word moves to the class that raises the same likelihood most, and the class bigrams are
counted anew, until a round gains less than TOLERANCE. Rarer, very long and unknown words belong to classes by their
spelling. A text's probability is the product of class transitions (smoothed towards the class unigram) and word emissions
(add-alpha within the class, with one share in each spelling class for whatever training lacks), and sums to one.

The head words (a bounded number of bounded length) travel to the tasks; counts of all other words are joined by a
shuffle on the word, so nothing that is broadcast grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Most words whose counts and classes travel to the tasks, least count of such a word, and most bytes of it.
HEAD, LEAST_COUNT, WORD_BYTES = 150_000, 3, 64

#: Words that the driver exchanges first, classes that words form, and most sweeps over them.
CLUSTERED, CLASSES, SWEEPS = 1_500, 48, 8

#: Most rounds over all head words, and the gain of log-likelihood a token (in nats) that asks for another round.
ROUNDS, TOLERANCE = 2, 0.005

#: Smoothing of transitions (pseudo-count of the class unigram) and of emissions.
BETA, ALPHA = 20.0, 0.3

#: Word kinds x final mark x length make the spelling classes.
SHAPES = 4 * 2 * 4

#: Distinct words or pairs that a task holds before it passes them on; neighbour counts that it holds before it sums them.
HELD, PAIRS_HELD = 400_000, 1_500_000

#: Parts that head words are dealt to where their neighbours' counts are summed.
PARTS = 64

_DIGITS, _LETTERS = bytes(range(48, 58)), bytes([*range(97, 123), *range(65, 91)])
_FINAL = b".,;:!?"


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words; the end of the text is not among them."""
    return text.lower().split() if text else []


def shape(word: bytes) -> int:
    """The spelling class of a word, 0 to SHAPES - 1."""
    rest = word.translate(None, _LETTERS)
    final = word[-1] in _FINAL
    n = len(word)
    if len(rest) == final:
        kind = 0
    elif rest.translate(None, _DIGITS) != rest:
        kind = 2
    elif any(c >= 128 for c in rest):
        kind = 1
    else:
        kind = 3
    return (kind * 2 + final) * 4 + (0 if n <= 3 else 1 if n <= 6 else 2 if n <= 10 else 3)


def count_kernel(batches):
    """(word, count) of the texts of a task, passed on whenever HELD words are held."""
    held: dict[bytes, int] = {}

    def out():
        got = pa.RecordBatch.from_arrays([pa.array([*held], pa.binary()), pa.array([*held.values()], pa.int64())], names=["word", "c"])
        held.clear()
        return got

    from collections import Counter

    held = Counter()
    for batch in batches:
        for t in common.byte_lists(batch.column(0)):
            held.update(tokens(t))
            if len(held) > HELD:
                yield out()
    if held:
        yield out()


@dataclass
class Head:
    """The commonest words: number of each word and the counts by number, commonest first."""

    number: dict[bytes, int]
    counts: np.ndarray


#: Numbers of a pair's side: boundary, spelling classes, clustered words.
SIDE = 1 + SHAPES + CLUSTERED

#: Codes of tokens: the number of a head word, -1 for a boundary, -2 - shape for other words; this makes them indices.
SHIFT = SHAPES + 1


def look_up(of_head: np.ndarray) -> np.ndarray:
    """What a code plus SHIFT stands for: 0 for a boundary, 1 + shape for other words, ``of_head`` for head words."""
    return np.concatenate([np.arange(SHAPES, 0, -1), [0], of_head]).astype(np.int64)


def squeezed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=4 * n, codec="zstd"), np.uint32).astype(np.int64)


def code_kernel(shared):
    """(size, codes): the codes of the tokens of a slice of texts plus SHIFT, each text between boundaries, compressed."""

    def run(batches):
        get, shapes = shared.value.get, {}
        for batch in batches:
            texts = common.byte_lists(batch.column(0))
            out = []
            for a, b in common.slices(texts):
                codes = [-1]
                for t in texts[a:b]:
                    for w in tokens(t):
                        i = get(w)
                        if i is None:
                            i = shapes.get(w)
                            if i is None:
                                if len(shapes) > HELD:
                                    shapes.clear()
                                i = shapes[w] = -2 - shape(w)
                        codes.append(i)
                    codes.append(-1)
                out.append((len(codes), squeezed(np.array(codes, np.int64) + SHIFT)))
            if out:
                sizes, packed = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["size", "codes"])

    return run


def coded(batches):
    """The code arrays of batches, as indices into a look-up table."""
    for batch in batches:
        for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield unsqueezed(x, n)


def pair_kernel(shared):
    """(pair, n): neighbours by side number."""

    def run(batches):
        sides = shared.value
        seen = np.zeros(0, np.int64)
        times = np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times)], names=["pair", "n"])

        for codes in coded(batches):
            ids = sides[codes]
            key, n = np.unique(ids[:-1] * SIDE + ids[1:], return_counts=True)
            seen, back = np.unique(np.concatenate([seen, key]), return_inverse=True)
            times = np.bincount(back, weights=np.concatenate([times, n]), minlength=len(seen)).astype(np.int64)
            if len(seen) > HELD:
                yield out()
                seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(seen):
            yield out()

    return run


def xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1e-12))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each side number: boundary and spelling classes keep their own, clustered words get exchanged ones.

    ``left``, ``right``, ``n``: pairs of side numbers with their counts; clustered words are numbered by frequency.
    """
    fixed = 1 + SHAPES
    total = fixed + classes
    of = np.concatenate([np.arange(fixed), fixed + np.arange(words) % classes])
    table = np.zeros((total, total))
    np.add.at(table, (of[left], of[right]), n)
    by_left = np.argsort(left, kind="stable")
    by_right = np.argsort(right, kind="stable")
    cut_l = np.searchsorted(left[by_left], np.arange(fixed + words + 1))
    cut_r = np.searchsorted(right[by_right], np.arange(fixed + words + 1))
    for _ in range(sweeps):
        moved = 0
        for w in range(fixed, fixed + words):
            at_l, at_r = by_left[cut_l[w] : cut_l[w + 1]], by_right[cut_r[w] : cut_r[w + 1]]
            if not len(at_l) and not len(at_r):
                continue
            own_l, own_r = right[at_l] == w, left[at_r] == w
            same = n[at_l][own_l].sum()
            after = np.bincount(of[right[at_l][~own_l]], weights=n[at_l][~own_l], minlength=total)
            before = np.bincount(of[left[at_r][~own_r]], weights=n[at_r][~own_r], minlength=total)
            a = of[w]
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= same
            # what comes before or after the word counts in its neighbours' sums, whatever its class
            rows, cols = table.sum(axis=1) + before, table.sum(axis=0) + after
            out_n, in_n = after.sum() + same, before.sum() + same
            block = slice(fixed, total)
            gain = (xlogx(table[block] + after) - xlogx(table[block])).sum(axis=1) + (xlogx(table[:, block] + before[:, None]) - xlogx(table[:, block])).sum(axis=0)
            # the class paired with itself was taken once by row and once by column
            d = np.arange(fixed, total)
            diag = table[d, d]
            gain += xlogx(diag + after[d] + before[d] + same) - xlogx(diag + after[d]) - xlogx(diag + before[d]) + xlogx(diag)
            gain -= xlogx(rows[block] + out_n) - xlogx(rows[block]) + xlogx(cols[block] + in_n) - xlogx(cols[block])
            best = fixed + int(np.argmax(gain))
            if gain[best - fixed] <= gain[a - fixed] + 1e-9:
                best = a
            of[w] = best
            moved += best != a
            table[best] += after
            table[:, best] += before
            table[best, best] += same
        if not moved:
            break
    return of


@dataclass
class Model:
    """What tasks need: head words with counts and classes, log transitions, and log-emission denominators by class."""

    head: Head
    of: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    n: int
    v: int
    ends: int

    def base(self, c):
        return np.log10((c + 1.0) / (self.n + self.v + 1.0))

    def emit(self, c, kind):
        """log10 P(word | class) of words with count ``c``."""
        return np.log10((c + ALPHA) / self.emission[kind])


def finish(head: Head, of: np.ndarray, table: np.ndarray, mass: np.ndarray, kinds: np.ndarray, total: int, distinct: int, ends: int) -> Model:
    """Smoothed probabilities; ``mass`` and ``kinds`` are words and distinct words of each spelling class, less those of the head.

    ``of`` holds the class of each head word, ``table`` the counts of class bigrams.
    """
    size = 1 + SHAPES + CLASSES
    arrive = table.sum(axis=0)
    there = np.arange(size) <= SHAPES
    there[of] = True  # a class without words gets nothing
    unigram = (arrive + there) / (arrive.sum() + there.sum())
    with np.errstate(divide="ignore"):
        transition = np.log10((table + BETA * unigram) / (table.sum(axis=1, keepdims=True) + BETA))
    words, types = np.zeros(size), np.zeros(size)
    words[1 : 1 + SHAPES], types[1 : 1 + SHAPES] = mass, kinds
    np.add.at(words, of, head.counts)
    np.add.at(types, of, 1)
    # each class of spelling keeps one share for what training lacks
    emission = words + ALPHA * (types + (np.arange(size) <= SHAPES))
    emission[0] = 1.0
    return Model(head, of, transition, emission, total, distinct, ends)


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums of their counts)."""
    if len(held) == 1:
        return held[0]
    key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate([n for _, n in held]), minlength=len(key)).astype(np.int64)


def neighbour_kernel(shared):
    """(part, size, keys, n): counts of what stands after a head word (class), before it (size + class), or both (itself).

    Words are dealt to PARTS parts. The counts of some slices leave a task as one row for each part: differences of the
    sorted keys (word, code), and the counts, both compressed. So rows and bytes of the shuffle stay few.
    """

    def run(batches):
        kinds = shared.value
        size = 1 + SHAPES + CLASSES
        wide = 2 * size + 1
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            key, n = summed(held)
            held.clear()
            part = key // wide % PARTS
            rows = []
            for p in np.unique(part).tolist():
                mine = part == p
                rows.append((p, int(mine.sum()), squeezed(np.diff(key[mine], prepend=0)), squeezed(n[mine])))
            kinds_of = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds_of)], names=["part", "size", "keys", "n"])

        for codes in coded(batches):
            kind = kinds[codes]
            at = np.flatnonzero(codes >= SHIFT)  # texts begin and end with boundaries, so both neighbours are there
            word = codes[at] - SHIFT
            after = np.where(codes[at + 1] == codes[at], 2 * size, kind[at + 1])
            apart = codes[at - 1] != codes[at]
            held.append(np.unique(np.concatenate([word * wide + after, word[apart] * wide + size + kind[at[apart] - 1]]), return_counts=True))
            if sum(len(k) for k, _ in held) > PAIRS_HELD:
                yield out()
        if sum(len(k) for k, _ in held):
            yield out()

    return run


def bigram_kernel(shared):
    """(pair, n): class bigrams of the texts of a task."""

    def run(batches):
        kinds = shared.value
        size = 1 + SHAPES + CLASSES
        total = np.zeros(size * size, np.int64)
        for codes in coded(batches):
            kind = kinds[codes]
            total += np.bincount(kind[:-1] * size + kind[1:], minlength=size * size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["pair", "n"])

    return run


def best_class(table: np.ndarray, rows: np.ndarray, cols: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, same: float) -> int:
    """The learned class in which a word raises the likelihood of the class bigrams most.

    ``after`` and ``before`` count its neighbours by class, ``same`` how often it follows itself; ``rows`` and ``cols`` are
    the table's sums. The word is taken out of its class first, while its neighbours' sums keep it: it is to come back.
    """
    first = 1 + SHAPES
    block, mine = slice(first, len(table)), own - first
    out_n, in_n = after.sum() + same, before.sum() + same
    i, j = np.flatnonzero(after), np.flatnonzero(before)
    right, left = table[block, i], table[j, block]
    right[:, i == own] -= before[block, None]
    left[j == own] -= after[block]
    diag = table.diagonal()[block].copy()
    row, col = rows[block].copy(), cols[block].copy()
    if mine >= 0:
        right[mine] -= after[i]
        left[:, mine] -= before[j]
        right[mine, i == own] -= same
        left[j == own, mine] -= same
        diag[mine] -= after[own] + before[own] + same
        row[mine] -= out_n
        col[mine] -= in_n
    gain = (xlogx(right + after[i]) - xlogx(right)).sum(axis=1) + (xlogx(left + before[j, None]) - xlogx(left)).sum(axis=0)
    # the class paired with itself: taken by row where it is in i, by column where it is in j, instead of once with both
    x, y = after[block], before[block]
    gain += xlogx(diag + x + y + same) - xlogx(diag + x) - xlogx(diag + y) + xlogx(diag)
    gain -= xlogx(row + out_n) - xlogx(row) + xlogx(col + in_n) - xlogx(col)
    best = int(np.argmax(gain))
    return own if mine >= 0 and gain[best] <= gain[mine] + 1e-9 else first + best


def place_kernel(shared):
    """(word, class) from the neighbour counts of whole parts; all words are placed against the same counts, so their
    order is free. What is held of a part is summed as it comes, so it has no more keys than its words have codes."""

    def run(batches):
        table, kinds = shared.value
        size = len(table)
        wide = 2 * size + 1
        rows, cols = table.sum(axis=1), table.sum(axis=0)
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        fresh = 0
        for batch in batches:
            for p, m, keys, n in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                parts.setdefault(p, []).append((np.cumsum(unsqueezed(keys, m)), unsqueezed(n, m)))
                fresh += m
                if fresh > PAIRS_HELD:
                    parts, fresh = {q: [summed(held)] for q, held in parts.items()}, 0
        for held in parts.values():
            key, n = summed(held)
            word, code = key // wide, key % wide
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.zeros(len(starts), np.int32)
            for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(word)])):
                m = np.bincount(code[a:b], weights=n[a:b], minlength=wide)
                best[k] = best_class(table, rows, cols, int(kinds[SHIFT + word[a]]), m[:size], m[size : 2 * size], m[2 * size])
            yield pa.RecordBatch.from_arrays([pa.array(word[starts].astype(np.int32)), pa.array(best)], names=["word", "kind"])

    return run


def bigrams(codes: DataFrame, kinds: np.ndarray) -> np.ndarray:
    """Counts of class bigrams of all coded texts."""
    size = 1 + SHAPES + CLASSES
    pairs = codes.mapInArrow(bigram_kernel(codes.sparkSession.sparkContext.broadcast(kinds)), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    return table.reshape(size, size)


def likelihood(table: np.ndarray) -> float:
    """What depends on the classes in the log-likelihood a token."""
    return float((xlogx(table).sum() - xlogx(table.sum(axis=1)).sum() - xlogx(table.sum(axis=0)).sum()) / max(1.0, table.sum()))


def place(codes: DataFrame, head: Head, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each head word, counts of class bigrams) with all head words in learned classes.

    ``of`` holds the classes of the side numbers. The first round gives classes to all words that have none; later ones
    move any word, and count if they gain.
    """
    context = codes.sparkSession.sparkContext
    fixed = 1 + SHAPES
    few = min(CLUSTERED, len(head.counts))
    now = np.zeros(len(head.counts), np.int64)
    for w, i in head.number.items():
        now[i] = of[fixed + i] if i < few else 1 + shape(w)
    table = bigrams(codes, look_up(now))
    for _ in range(ROUNDS):
        if not len(now):
            break
        kinds = look_up(now)
        near = codes.mapInArrow(neighbour_kernel(context.broadcast(kinds)), "part int, size int, keys binary, n binary")
        placed = near.repartition("part").mapInArrow(place_kernel(context.broadcast((table, kinds))), "word int, kind int").toArrow()
        new = now.copy()
        new[placed.column("word").to_numpy()] = placed.column("kind").to_numpy()
        counted = bigrams(codes, look_up(new))
        gain = likelihood(counted) - likelihood(table)
        all_placed = (now > SHAPES).all()
        if gain > 0 or not all_placed:
            now, table = new, counted
        if all_placed and gain < TOLERANCE:
            break
    return now, table


def shape_kernel(batches):
    """Mass and number of the words of each spelling class."""
    for batch in batches:
        kind = np.array([shape(w) for w in batch.column(0).to_pylist()], np.int64)
        c = batch.column(1).to_numpy()
        mass, types = np.bincount(kind, weights=c, minlength=SHAPES), np.bincount(kind, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES, dtype=np.int32)), pa.array(mass.astype(np.int64)), pa.array(types.astype(np.int64))], names=["shape", "mass", "types"])


def threshold(counts: DataFrame, most: int) -> int:
    """The least count of which, and above which, there are ``most`` words at most, from a histogram of counts.

    Counts from 1024 on go to bins of a 64th of an octave each, so the histogram is small however large counts are.
    """
    octave = F.floor(F.log2(F.col("c") / 1024.0) * 64).cast("bigint")
    bins = counts.groupBy(F.when(F.col("c") < 1024, F.col("c")).otherwise(octave + 1024).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).collect()
    total, least = 0, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["n"]
        if total > most:
            return least if least is not None else r["most"] + 1
        least = r["least"]
    return 1


def in_head(least: int):
    return (F.col("c") >= least) & (F.length("word") <= WORD_BYTES)


def train(docs: DataFrame, allowed=None) -> tuple[Model, DataFrame]:
    """(model, table of the words that are not in the head, with their counts) of the texts of the rows that ``allowed``
    admits; null texts count as empty, repeated rows as often as they are there, and words of equal count are numbered in
    the order of their bytes."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    texts = (docs if allowed is None else docs.where(allowed)).select("text")
    counts = common.materialized(texts.mapInArrow(count_kernel, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")))
    ends = texts.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = max(LEAST_COUNT, threshold(counts.where(F.length("word") <= WORD_BYTES), HEAD))
    top = counts.where(in_head(least)).toArrow()
    by_count = sorted(zip(top.column("word").to_pylist(), top.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    head = Head({w: i for i, (w, _) in enumerate(by_count)}, np.array([c for _, c in by_count], np.int64))
    codes = common.materialized(texts.mapInArrow(code_kernel(spark.sparkContext.broadcast(head.number)), "size int, codes binary"))
    few = min(CLUSTERED, len(by_count))
    side = np.array([1 + SHAPES + i if i < few else 1 + shape(w) for i, (w, _) in enumerate(by_count)], np.int64)
    pairs = codes.mapInArrow(pair_kernel(spark.sparkContext.broadcast(look_up(side))), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    key, n = pairs.column("pair").to_numpy(), pairs.column("n").to_numpy().astype(float)
    order = np.argsort(key)
    key, n = key[order], n[order]
    of = exchange(key // SIDE, key % SIDE, n, few)
    kinds_of, table = place(codes, head, of)
    shapes = counts.where(~in_head(least)).mapInArrow(shape_kernel, "shape int, mass bigint, types bigint").groupBy("shape").agg(F.sum("mass").alias("mass"), F.sum("types").alias("types")).collect()
    mass, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in shapes:
        mass[r["shape"]], kinds[r["shape"]] = r["mass"], r["types"]
    model = finish(head, kinds_of, table, mass, kinds, int(sums["n"]) + ends, int(sums["v"]) + (ends > 0), ends)
    return model, counts.where(~in_head(least))


ROW_NAMES = ["rid", "word", "times", "kind", "n_tokens", "n_known", "base_score", "score"]
ROW_DDL = "rid bigint, word binary, times bigint, kind int, n_tokens bigint, n_known bigint, base_score double, score double"


def score_kernel(shared):
    """Rows of each text: one with the sums over its common words, and one for each of its other words.

    The first has a key that no word has (it holds a blank), so that both kinds go through one join and one sum.
    """

    def run(batches):
        model = shared.value
        number, counts, of = model.head.number, model.head.counts, model.of
        shapes: dict[bytes, int] = {}
        base_of = model.base(counts.astype(float)) if len(counts) else np.zeros(0)
        head_class = of
        emit_of = model.emit(counts.astype(float), head_class) if len(counts) else np.zeros(0)
        end_base = float(model.base(model.ends))
        for batch in batches:
            rids, texts = batch.column(0).to_pylist(), common.byte_lists(batch.column(1))
            for a, b in common.slices(texts):
                cols: list[list] = [[] for _ in range(8)]
                source: list[int | None] = []
                for place, (rid, t) in enumerate(zip(rids[a:b], texts[a:b]), a):
                    ws = tokens(t)
                    ids = np.fromiter((number.get(w, -1) for w in ws), np.int64, len(ws))
                    kind = np.zeros(len(ws) + 2, np.int64)
                    there = ids >= 0
                    seen = ids[there]
                    kind[1:-1][there] = head_class[seen]
                    other: dict[bytes, int] = {}
                    for i in np.flatnonzero(~there).tolist():
                        w = ws[i]
                        s = shapes.get(w)
                        if s is None:
                            if len(shapes) > HELD:
                                shapes.clear()
                            s = shapes[w] = 1 + shape(w)
                        kind[i + 1] = s
                        other[w] = other.get(w, 0) + 1
                    log_p = model.transition[kind[:-1], kind[1:]].sum() + emit_of[seen].sum()
                    row = (rid, b" %d" % rid, 0, 0, len(ws) + 1, len(seen) + (model.ends > 0), float(base_of[seen].sum()) + end_base, float(log_p))
                    for c, x in zip(cols, row):
                        c.append(x)
                    source.append(place)
                    source += [None] * len(other)
                    for w, times in other.items():
                        for c, x in zip(cols, (rid, w, times, shapes[w] if w in shapes else 1 + shape(w), 0, 0, 0.0, 0.0)):
                            c.append(x)
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                made = [pa.array(c, k) for c, k in zip(cols, kinds)]
                kept = [batch.column(i).take(pa.array(source, pa.int64())) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(made + kept, names=ROW_NAMES + [f"keep{i}" for i in range(len(kept))])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score of every whole text.

    A null or empty text has one token, its end. Rows are told apart by their place in the input, so repeated rows and
    null ids each get their own result. Without training texts all counts are 0. ``counts`` are the words that are not in
    the model's head. A text of any length is scored whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    named = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "text", *named)
    denominators = F.array(*[F.lit(float(x)) for x in model.emission])
    schema = T.StructType.fromDDL(ROW_DDL)
    for f in numbered.schema.fields[2:]:
        schema.add(f.name, f.dataType)
    rows = numbered.mapInArrow(score_kernel(shared), schema)
    joined = rows.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    t = F.col("times")
    sums = joined.groupBy("rid").agg(
        *[F.first(F.when(t == 0, F.col(f"keep{i}")), ignorenulls=True).alias(f"keep{i}") for i in range(len(keep))],
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, t).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + F.when(t > 0, t * F.log10((F.col("c") + 1.0) / float(model.n + model.v + 1))).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(t > 0, t * F.log10((F.col("c") + ALPHA) / F.element_at(denominators, F.col("kind") + 1))).otherwise(0.0)).alias("score"),
    )
    kept = [F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)]
    return sums.select(*kept, "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
