"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give each word a probability after the word before it, learned from a bounded
sample of labelled texts. The highest order counts word pairs in the class; it backs off to the pairs of both classes,
pooled, and these to the word's spelling: an interpolated Kneser-Ney n-gram over the bytes of the word, order 6, whose
highest order counts bytes in the class, whose lower orders count continuations in the class, and whose two lowest orders
are shared. So a rare inflection of a toxic expression is judged by the parts it has in common with others, an expression
of several ordinary words by its pairs, and what neither class knows has nearly the same probability in both.

A text's evidence is the difference of its two log-likelihoods over its length in words, of the words' spelling alone
and of whole pairs: over the whole text and over its most telling stretch of 24 words; and the root-normalised number of
words whose spelling is strong evidence. A logistic regression on labelled texts that the counts have not seen turns
these into a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled texts of each class that a fit takes; a quarter of them only calibrates.
TEXTS = 2_500

#: Bytes of an n-gram; n-grams up to SHARED bytes are pooled over the classes.
ORDER, SHARED = 6, 2

#: Word pairs that the sample has less often are left to the orders below.
LEAST_PAIRS = 2

#: Words of a stretch, and the log-likelihood difference of strong evidence.
STRETCH, STRONG = 24, 3.0

#: Figures of evidence: whole text, best stretch and strong words by spelling; whole text and best stretch by pairs.
EVIDENCE = 5
UNFITTED = np.array([0.0] * EVIDENCE + [-2.0])

#: Words kept in a worker's cache; it is emptied when full, which costs time only.
CACHE_WORDS = 400_000

#: ASCII marks and control characters end words; capitals become small.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c == 39 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def ngrams(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, word number) of the n-gram of ORDER bytes that ends at each byte of each word and at its end.

    A word has ORDER - 1 blanks before it and one behind it; the bytes of an n-gram are the low bytes of its key.
    """
    sizes = np.array([len(w) + 1 for w in some], np.int64)
    b = np.frombuffer(b" " * (ORDER - 1) + (b" " * ORDER).join(some) + b" ", np.uint8).astype(np.uint64)
    keys = np.zeros(len(b) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        keys |= b[k : len(b) - ORDER + 1 + k] << np.uint64(8 * (ORDER - 1 - k))
    owner = np.repeat(np.arange(len(some)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return keys[np.arange(len(owner)) - first[owner] + starts[owner]], owner


@dataclass
class Level:
    """One order: sorted n-grams with their probabilities in both classes, sorted contexts with their backoff weights."""

    keys: np.ndarray
    prob: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def discount(n: np.ndarray) -> float:
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(keys, return_inverse=True)
    return u, np.stack([np.bincount(back, weights=n[:, c], minlength=len(u)) for c in range(n.shape[1])], axis=1)


@dataclass
class Pairs:
    """The orders of word pairs: of the classes and, below, of both together.

    ``number`` numbers words from 1. Of each kept pair (key: number of the first word, then of the second) there is its
    discounted share after the first word in each class and in the pool; of each first word (0: unknown) what the class
    hands to the pool and what the pool hands to the spelling.
    """

    number: dict[bytes, int] = field(default_factory=dict)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    own: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    pooled: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: np.ndarray = field(default_factory=lambda: np.ones((1, 2)))
    pooled_rest: np.ndarray = field(default_factory=lambda: np.ones(1))

    def evidence(self, before: np.ndarray, word: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of words after others, given the log-likelihoods of their spelling."""
        out = spelled[:, 0] - spelled[:, 1] + np.log(self.rest[before, 0]) - np.log(self.rest[before, 1])
        there = np.flatnonzero((before > 0) & (word > 0))
        at, hit = find(self.keys, before[there].astype(np.uint64) << np.uint64(32) | word[there].astype(np.uint64))
        at, there = at[hit], there[hit]
        p = self.probability(at, before[there], spelled[there])
        out[there] = np.log(p[:, 0]) - np.log(p[:, 1])
        return out

    def probability(self, at: np.ndarray, before: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Probabilities of kept pairs in both classes."""
        pool = self.pooled[at, None] + self.pooled_rest[before, None] * np.exp(spelled)
        return self.own[at] + self.rest[before] * pool


def pair_model(pairs: list[tuple[bytes, bytes, int, int]], contexts: dict[bytes, tuple[int, int]], once_twice: list[tuple[int, int]]) -> Pairs:
    """Pairs from (first, second, times in toxic, in ordinary texts), times of first words, and for toxic, ordinary and
    both together the numbers of pairs that occur once and twice."""
    if not pairs:
        return Pairs()
    number = {w: i for i, w in enumerate(sorted({w for p in pairs for w in p[:2]} | set(contexts)), 1)}
    a, b = (np.array([number[p[k]] for p in pairs], np.int64) for k in (0, 1))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    n = np.array([p[2:] for p in pairs], float)[order]
    total = np.zeros((len(number) + 1, 2))
    for w, c in contexts.items():
        total[number[w]] = c
    d = [min(0.95, max(0.1, x / (x + 2 * y))) if x + y else 0.5 for x, y in once_twice]
    of_class = np.maximum(n - np.array(d[:2]), 0) / np.maximum(total[a], 1)
    of_pool = np.maximum(n.sum(axis=1) - d[2], 0) / np.maximum(total[a].sum(axis=1), 1)
    rest, pooled_rest = np.ones_like(total), np.ones(len(total))
    for c in (0, 1):
        rest[:, c] -= np.bincount(a, weights=of_class[:, c], minlength=len(total))
    pooled_rest -= np.bincount(a, weights=of_pool, minlength=len(total))
    return Pairs(number, a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), of_class, of_pool, rest, pooled_rest)


class Models:
    """Both models and the logistic regression; ``cache`` keeps words that were spelled, by their place in two arrays."""

    def __init__(self, levels: list[Level], logistic: np.ndarray, pairs: Pairs | None = None):
        self.levels, self.logistic, self.pairs = levels, logistic, pairs or Pairs()
        self.forget()

    def forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.logs, self.numbers = np.zeros((0, 2)), np.zeros(0, np.int64)

    def __getstate__(self):
        return {"levels": self.levels, "logistic": self.logistic, "pairs": self.pairs}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def probability(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Probability in (toxic, ordinary) of the last byte of each n-gram of k + 1 bytes after the others."""
        if k < 0:
            return np.full((len(keys), 2), 1 / 256)
        level = self.levels[k]
        at, hit = find(level.keys, keys)
        out = np.empty((len(keys), 2))
        out[hit] = level.prob[at[hit]]
        if not hit.all():
            rest = keys[~hit]
            c, known = find(level.contexts, rest >> np.uint64(8))
            weight = np.where(known[:, None], level.weight[c] if len(level.contexts) else 1.0, 1.0)
            out[~hit] = weight * self.probability(k - 1, rest & np.uint64((1 << (8 * k)) - 1))
        return out

    def spelled(self, some: list[bytes]) -> np.ndarray:
        """log P(toxic) and log P(ordinary) of each word by its spelling."""
        keys, owner = ngrams(some)
        p = np.log(self.probability(ORDER - 1, keys))
        return np.stack([np.bincount(owner, weights=p[:, c], minlength=len(some)) for c in (0, 1)], axis=1)

    def learn(self, new: set[bytes]) -> None:
        todo = sorted(new)
        made = [self.spelled(todo[a:b]) for a, b in common.slices(todo, limit=1 << 18)]
        self.cache.update(zip(todo, range(len(self.logs), len(self.logs) + len(todo))))
        self.logs = np.concatenate([self.logs, *made])
        self.numbers = np.concatenate([self.numbers, np.array([self.pairs.number.get(w, 0) for w in todo], np.int64)])

    def evidence(self, texts: list[bytes | None]) -> np.ndarray:
        each = [words(t) for t in texts]
        if not each:
            return np.zeros((0, EVIDENCE))
        new = {w for ws in each for w in ws}.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.forget()
            new = {w for ws in each for w in ws}
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        sizes = np.array([len(ws) + 1 for ws in each], np.int64)  # one 0 stands for the start of each text
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        d = np.zeros(int(sizes.sum()))
        body = np.ones(len(d), bool)
        body[starts] = False
        pair = np.zeros(len(d))
        at = np.fromiter((x for ws in each for x in map(get, ws)), np.int64, int(body.sum()))
        if len(at):
            number = np.zeros(len(d), np.int64)
            number[body] = self.numbers[at]
            spelled = self.logs[at]
            d[body] = spelled[:, 0] - spelled[:, 1]
            pair[body] = self.pairs.evidence(number[np.flatnonzero(body) - 1], number[body], spelled)
        n = np.maximum(1, sizes - 1)
        i = np.arange(len(d))
        begin = np.maximum(np.repeat(starts, sizes), i - STRETCH + 1)
        # sums of short stretches are taken by difference; rounding keeps them the same whatever stands before the text
        best = [np.maximum.reduceat(np.round((x[i + 1] - x[begin]) / STRETCH, 6), starts) for x in (np.append(0.0, np.cumsum(d)), np.append(0.0, np.cumsum(pair)))]
        strong = np.add.reduceat((d > STRONG).astype(float), starts)
        return np.stack([np.add.reduceat(d, starts) / n, best[0], strong / np.sqrt(n), np.add.reduceat(pair, starts) / n, best[1]], axis=1)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        x = self.evidence(texts)
        return common.sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ self.logistic)


def build(some: list[bytes], counts: np.ndarray) -> Models:
    """Models of spelling from words and how often each occurs in (toxic, ordinary) texts."""
    if not some:
        return Models([Level(np.zeros(0, np.uint64), np.zeros((0, 2)), np.zeros(0, np.uint64), np.zeros((0, 2))) for _ in range(ORDER)], UNFITTED)
    keys, owner = ngrams(some)
    grams = [summed(keys, counts[owner].astype(float))]  # of ORDER bytes; then of one byte less each time
    for k in range(ORDER - 1, 0, -1):
        longer, n = grams[-1]
        grams.append(summed(longer & np.uint64((1 << (8 * k)) - 1), (n > 0).astype(float)))
    models = Models([], UNFITTED)
    for k, (u, n) in enumerate(reversed(grams)):
        if k < SHARED:
            n = np.repeat(n.sum(axis=1, keepdims=True), 2, axis=1)
        contexts, back = np.unique(u >> np.uint64(8), return_inverse=True)
        prob, weight = np.zeros((len(u), 2)), np.ones((len(contexts), 2))
        shorter = models.probability(k - 1, u & np.uint64((1 << (8 * k)) - 1))
        for c in (0, 1):
            d = discount(n[:, c])
            total = np.bincount(back, weights=n[:, c], minlength=len(contexts))
            kinds = np.bincount(back, weights=n[:, c] > 0, minlength=len(contexts))
            seen = total > 0
            weight[seen, c] = d * kinds[seen] / total[seen]
            own = np.where(seen[back], np.maximum(n[:, c] - d, 0) / np.maximum(total[back], 1e-300), 0.0)
            prob[:, c] = own + weight[back, c] * shorter[:, c]
        models.levels.append(Level(u, prob, contexts, weight))
    return models


def counted(texts, labels) -> dict[tuple[bytes | None, bytes], list[int]]:
    """(toxic, ordinary) times of each word, with None before it, and of each pair of words."""
    seen: dict[tuple[bytes | None, bytes], list[int]] = {}
    for y, t in zip(labels, texts):
        ws = words(t)
        for key in (*((None, w) for w in ws), *zip(ws, ws[1:])):
            n = seen.get(key)
            if n is None:
                n = seen[key] = [0, 0]
            n[0 if y else 1] += 1
    return seen


def word_kernel(batches):
    for batch in batches:
        seen = counted(common.byte_lists(batch.column(1)), batch.column(0).to_pylist())
        cols = [pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.binary()), pa.array([n[0] for n in seen.values()], pa.int64()), pa.array([n[1] for n in seen.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["first", "word", "toxic", "ordinary"])


def rows_of(df: DataFrame) -> list[tuple]:
    table = df.toArrow()
    return [*zip(*[table.column(i).to_pylist() for i in range(table.num_columns)])]


def fit(docs: DataFrame, labels: DataFrame, allowed=None, bound: int = TEXTS) -> Models:
    """Models from at most ``bound`` labelled texts of each class among the labels that ``allowed`` admits."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    labels = labels.where(allowed) if allowed is not None else labels
    worst: dict = {}
    for k, y in common.labelled_sample(labels, "toxic", bound):
        worst[k] = max(int(y), worst.get(k, 0))  # of two labels of a document the worse counts
    if not worst:
        return build([], np.zeros((0, 2)))
    wanted = F.broadcast(spark.createDataFrame([*worst.items()], "doc_id bigint, __y int"))
    sample = docs.select("doc_id", "text").join(wanted, "doc_id").withColumn("__part", F.abs(F.hash("doc_id", F.lit(11))) % 4)
    counts = sample.where("__part > 0").select("__y", "text").mapInArrow(word_kernel, "first binary, word binary, toxic bigint, ordinary bigint")
    counts = common.materialized(counts.groupBy("first", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    alone, pairs = counts.where("first is null"), counts.where("first is not null")
    got = rows_of(alone.select("word", "toxic", "ordinary"))
    models = build([w for w, *_ in got], np.array([n for _, *n in got]).reshape(-1, 2))
    kinds = ("toxic", "ordinary", "toxic + ordinary")
    o = pairs.agg(*[F.count_if(F.expr(f"{k} = {n}")).alias(f"n{i}{n}") for i, k in enumerate(kinds) for n in (1, 2)]).first()
    kept = pairs.where(F.expr("toxic + ordinary") >= LEAST_PAIRS)
    contexts = pairs.groupBy("first").agg(F.sum("toxic"), F.sum("ordinary"), F.max(F.expr("toxic + ordinary")).alias("most")).where(F.col("most") >= LEAST_PAIRS).drop("most")
    models.pairs = pair_model(rows_of(kept), {w: n for w, *n in rows_of(contexts)}, [(o[f"n{i}1"], o[f"n{i}2"]) for i in range(3)])
    shared = spark.sparkContext.broadcast(models)

    def evidence(texts):
        x = shared.value.evidence(texts)
        return {f"x{i}": x[:, i] for i in range(EVIDENCE)}

    names = [f"x{i}" for i in range(EVIDENCE)]
    rest = common.with_struct(sample.where("__part = 0"), common.text_kernel(evidence, ", ".join(f"{n} double" for n in names))(F.col("text")), names, ["doc_id", "__y"]).toPandas().sort_values(["doc_id", "__y", *names])
    if not len(rest):
        return models
    y = rest["__y"].to_numpy()
    models.logistic = common.fit_logistic(rest[names].to_numpy(float), y, balance=False)
    # the sample takes as many texts of each class; the bias is moved to the classes' shares among all labels
    shares = {int(r["toxic"]): r["n"] for r in labels.where("toxic is not null").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if 0 < y.mean() < 1 and shares.get(0) and shares.get(1):
        models.logistic[-1] += np.log(shares[1] / shares[0]) - np.log(y.mean() / (1 - y.mean()))
    return models


def score(docs: DataFrame, models: Models, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or columns ``keep``) with score (0 to 1) and predicted.

    Null and empty texts have no evidence and get the score of none. Each row is scored by itself, so repeated rows
    agree; a text of any length is scored whole. A score of 0.5 counts as toxic. Columns named, in whatever case, like the
    two new ones are replaced. An empty table gives an empty result; without labels no text is toxic.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(models)

    def kernel(texts):
        s = np.round(shared.value.score(texts), 9)
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return common.with_struct(docs, common.text_kernel(kernel, "score double, predicted int")(F.col("text")), ["score", "predicted"], keep)
