"""Quality classification of lines by a linear-chain conditional random field.

A text is the chain of its lines; each line is good or bad. The potential of a line is linear in features of the line
and of its neighbours, that of two lines in a row depends on their labels. A text's quality is the mean of its lines'
forward-backward marginals, weighted by length.

Only texts bear labels, so those of lines are learned. A bounded sample of labelled texts is strung together to chains of
one to three, in which good and bad meet. At first each line bears its text's label. Then rounds of expectation and
maximisation: the posterior of the lines under the field found so far, held to what is known (SHARE of a text's length
at least bears the text's label), takes the place of the labels. Every chain has the same weight, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled texts of each class that a fit takes, and most lines of such a text: of a longer one so many that stand
#: together, from a place that hangs on its id.
TEXTS, FIT_LINES = 1_500, 500

#: Least share of a text's length that bears the text's label, and rounds in which the labels of lines are learned anew.
SHARE, ROUNDS = 0.75, 2

OWN = ["bias", "empty", "log_words", "word_length", "symbols", "capitals", "digits", "marks", "bars", "letters", "stop_at_end", "small_words", "new_words", "seen_before"]
SIZE = len(OWN)

_UPPER, _DIGIT, _SYMBOLS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>@{}[]=_\\^~", b"!?;:,\"'()"
_ASCII_OTHER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, weight of each line); a null text is one empty line."""
    lines = (text or b"").split(b"\n")
    out = np.zeros((len(lines), SIZE), np.float32)
    weight = np.zeros(len(lines))
    seen_lines: set[bytes] = set()
    seen_words: set[bytes] = set()
    for i, line in enumerate(lines):
        ws = line.split()
        row = out[i]
        row[0] = 1.0
        if not ws:
            row[1] = 1.0
            continue
        n = sum(map(len, ws))
        k = len(ws)
        size = len(line)
        kinds = set(ws)
        weight[i] = n
        row[2] = np.log1p(k) / 5
        row[3] = min(3.0, n / k / 6)
        row[4] = min(2.0, (size - len(line.translate(None, _SYMBOLS))) / k)
        row[5] = (size - len(line.translate(None, _UPPER))) / n
        row[6] = (size - len(line.translate(None, _DIGIT))) / n
        row[7] = min(2.0, (size - len(line.translate(None, _MARKS))) / k)
        row[8] = line.count(b"|") / k
        row[9] = len(line.translate(None, _ASCII_OTHER)) / n
        row[10] = ws[-1][-1] in b".!?"
        row[11] = sum(1 for w in ws if len(w) <= 3) / k
        row[12] = len(kinds - seen_words) / k
        row[13] = line in seen_lines
        seen_lines.add(line)
        seen_words |= kinds
    return out, weight


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and those of the line after (zeros at the ends of a text)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts] = 0
    after[np.append(starts[1:], len(x)) - 1] = 0
    return np.hstack([x, before, after])


class Chains:
    """Texts of one batch, arranged so that a step along all chains is one vector operation."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.starts = starts
        by = starts[self.order]
        longest = int(sizes.max()) if len(sizes) else 0
        live = np.searchsorted(-sizes[self.order], -np.arange(longest), side="left")  # chains longer than t
        self.steps = [by[: live[t]] + t for t in range(longest)]

    def messages(self, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log messages of each line and the log partition function of each chain."""
        fwd, bwd = np.array(node), np.zeros_like(node)
        for before, now in zip(self.steps, self.steps[1:]):
            prev = fwd[before[: len(now)]]
            fwd[now, 0] += np.logaddexp(prev[:, 0] + edge[0, 0], prev[:, 1] + edge[1, 0])
            fwd[now, 1] += np.logaddexp(prev[:, 0] + edge[0, 1], prev[:, 1] + edge[1, 1])
        for now, after in zip(self.steps[-2::-1], self.steps[:0:-1]):
            nxt = bwd[after] + node[after]
            at = now[: len(after)]
            bwd[at, 0] = np.logaddexp(nxt[:, 0] + edge[0, 0], nxt[:, 1] + edge[0, 1])
            bwd[at, 1] = np.logaddexp(nxt[:, 0] + edge[1, 0], nxt[:, 1] + edge[1, 1])
        last = self.starts + self.sizes - 1
        return fwd, bwd, np.logaddexp(fwd[last, 0], fwd[last, 1])


@dataclass
class Field:
    """Weights of a good line's features (a bad line has none) and potentials of label pairs."""

    weights: np.ndarray
    edge: np.ndarray

    def marginals(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of good for each line."""
        chains = Chains(sizes)
        full = with_neighbours(x, chains.starts)
        node = np.stack([np.zeros(len(x)), full @ self.weights], axis=1)
        fwd, bwd, _ = chains.messages(node, self.edge)
        both = fwd + bwd
        return common.sigmoid(both[:, 1] - both[:, 0])

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        each = [line_features(t) for t in texts]
        sizes = np.array([len(w) for _, w in each])
        p = self.marginals(np.vstack([x for x, _ in each]).astype(float), sizes)
        weight = np.concatenate([w if w.any() else np.ones(len(w)) for _, w in each])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)


def strung(n: int, seed: int = 11) -> list[list[int]]:
    """Texts 0 to n - 1 in a fixed random order, as chains of one, two and three by turns."""
    order = np.random.default_rng(seed).permutation(n).tolist()
    out, k = [], 0
    while order:
        k = k % 3 + 1
        out.append(order[:k])
        order = order[k:]
    return out


def pairs(chains: Chains, node: np.ndarray, edge: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of good of each line, of each label pair of lines and those before them, log partition functions)."""
    fwd, bwd, log_z = chains.messages(node, edge)
    p = common.sigmoid((fwd + bwd)[:, 1] - (fwd + bwd)[:, 0])
    joint = fwd[inner - 1][:, :, None] + edge[None] + (node[inner] + bwd[inner])[:, None, :]
    if len(inner):
        joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(inner), 4), axis=1)[:, None, None])
    return p, joint, log_z


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], l2: float = 1e-4, most: int = 120, rounds: int = ROUNDS) -> Field:
    """A field from (features of lines, weights of lines, label) of each text."""
    if not texts or len({y for *_, y in texts}) < 2:
        y = texts[0][2] if texts else 1
        return Field(np.concatenate([[2.0 if y else -2.0], np.zeros(3 * SIZE - 1)]), np.zeros((2, 2)))
    groups = strung(len(texts))
    order = [i for g in groups for i in g]
    sizes = np.array([len(texts[i][0]) for i in order])
    x = np.vstack([texts[i][0] for i in order]).astype(float)
    label = np.repeat([float(texts[i][2]) for i in order], sizes)
    length = np.concatenate([w if (w := texts[i][1]).any() else np.ones(len(w)) for i in order])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    length = length / np.repeat(np.add.reduceat(length, begin), sizes)
    at = np.concatenate([[0], np.cumsum([len(g) for g in groups])[:-1]])
    chains = Chains(np.add.reduceat(sizes, at))
    full = with_neighbours(x, chains.starts)
    weight = 1.0 / (chains.sizes * len(groups))
    each = np.repeat(weight, chains.sizes)
    is_first = np.zeros(len(x), bool)
    is_first[chains.starts] = True
    inner = np.flatnonzero(~is_first)

    def potentials(theta):
        return np.stack([np.zeros(len(x)), full @ theta[:-4]], axis=1), theta[-4:].reshape(2, 2)

    def fitted(theta, good, both):
        """Parameters that maximise the expected likelihood under probabilities of lines and of pairs of lines."""
        want_w, want_e = full.T @ (each * good), (each[inner][:, None, None] * both).sum(axis=0)

        def loss(theta):
            node, edge = potentials(theta)
            p, joint, log_z = pairs(chains, node, edge, inner)
            gain = theta[:-4] @ want_w + (want_e * edge).sum() - weight @ log_z
            g_w = full.T @ (each * p) - want_w
            g_e = (each[inner][:, None, None] * joint).sum(axis=0) - want_e
            return -gain + l2 * (theta @ theta), np.concatenate([g_w, g_e.ravel()]) + 2 * l2 * theta

        return lbfgs(loss, theta, most)

    def expected(theta):
        """The posterior closest to the field in which SHARE of each text's length bears the text's label."""
        node, edge = potentials(theta)
        sign = 2 * label - 1
        low, high = np.zeros(len(sizes)), np.full(len(sizes), 40.0)
        for step in range(14):
            push = np.zeros(len(sizes)) if step == 0 else (low + high) / 2
            p, joint, _ = pairs(chains, node + np.stack([np.zeros(len(x)), sign * np.repeat(push, sizes)], axis=1), edge, inner)
            enough = np.add.reduceat(length * np.where(label == 1, p, 1 - p), begin) >= SHARE
            high = np.where(enough, push, high)
            low = np.where(enough, low, push)
        push = high
        p, joint, _ = pairs(chains, node + np.stack([np.zeros(len(x)), sign * np.repeat(push, sizes)], axis=1), edge, inner)
        return p, joint

    both = np.zeros((len(inner), 2, 2))
    both[np.arange(len(inner)), label[inner - 1].astype(int), label[inner].astype(int)] = 1.0
    theta = fitted(np.zeros(3 * SIZE + 4), label, both)
    for _ in range(rounds):
        theta = fitted(theta, *expected(theta))
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def lbfgs(loss, theta: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    value, grad = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, d in reversed(past):
            a = (s @ q) / (s @ d)
            alphas.append(a)
            q -= a * d
        if past:
            s, d = past[-1]
            q *= (s @ d) / (d @ d)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, d), a in zip(past, reversed(alphas)):
            q += s * (a - (d @ q) / (s @ d))
        step, slope = 1.0, grad @ q
        while step > 1e-6:
            nxt = theta - step * q
            v, g = loss(nxt)
            if v <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = nxt - theta, g - grad
        if s @ d > 1e-12:
            past = [*past[-(memory - 1) :], (s, d)]
        done = value - v < 1e-7
        theta, value, grad = nxt, v, g
        if done:
            break
    return theta


def feature_kernel(texts: list) -> dict:
    each = [line_features(t) for t in texts]
    return {"x": [x.ravel() for x, _ in each], "w": [w for _, w in each]}


def fit(docs: DataFrame, labels: DataFrame, allowed=None, bound: int = TEXTS) -> Field:
    """A field from at most ``bound`` labelled texts of each quality among the labels that ``allowed`` admits.

    Texts of any length are fitted to, by FIT_LINES neighbouring lines at most, which bounds what the driver gets.
    Null and empty texts are one empty line. Rows that agree in id and text count as often as they are there; ties in the
    order of the sample are broken by the features, so the fit does not hang on the order of rows. Without labels, or
    without labelled texts, the field is constant.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    labels = labels.where(allowed) if allowed is not None else labels
    worst: dict = {}
    for k, y in common.labelled_sample(labels, "quality", bound):
        worst[k] = min(int(y), worst.get(k, 1))  # of two labels of a document the worse counts
    if not worst:
        return train([])
    wanted = F.broadcast(spark.createDataFrame([*worst.items()], "doc_id bigint, __y int"))
    made = common.text_kernel(feature_kernel, "x array<float>, w array<double>")(F.col("text"))
    rows = common.with_struct(docs.select("doc_id", "text").join(wanted, "doc_id"), made, ["x", "w"], ["doc_id", "__y"])
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.size("w") - FIT_LINES + 1, F.lit(1))).cast("int")
    rows = rows.select("doc_id", "__y", F.slice("x", start * SIZE + 1, F.lit(FIT_LINES * SIZE)).alias("x"), F.slice("w", start + 1, F.lit(FIT_LINES)).alias("w")).toArrow()
    xs, ws = rows.column("x").combine_chunks(), rows.column("w").combine_chunks()
    found = [(d, y, np.asarray(xs[i].values).reshape(-1, SIZE), np.asarray(ws[i].values)) for i, (d, y) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("__y").to_pylist()))]
    found.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    return train([(x, w, y) for _, y, x, w in found])


def score(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or columns ``keep``) with score (0 to 1) and predicted.

    A null or empty text is one empty line and gets that line's marginal. Each row is scored by itself, so repeated rows
    agree; a text of any length is one chain. A score of 0.5 counts as good. Columns of ``docs`` that are named, in
    whatever case, like the two new ones are replaced. An empty table gives an empty result; without labels of both
    qualities all texts get one score.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(field)

    def kernel(texts):
        s = np.clip(shared.value.score(texts), 0.0, 1.0)
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return common.with_struct(docs, common.text_kernel(kernel, "score double, predicted int")(F.col("text")), ["score", "predicted"], keep)
