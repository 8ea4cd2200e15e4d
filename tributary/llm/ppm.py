"""Language identification by prediction by partial matching.

Each language has a context tree over bytes up to order 3, learned from a bounded sample of labelled texts and frozen.
A byte costs -log2 c/(n+d) bits where its context has seen it c times among n bytes of d kinds; else the escape
-log2 d/(n+d) is paid and the next shorter context asked, down to 8 bits for any byte (escape method C, no
exclusion). A language's code length of a text is the sum over its bytes, exact under these statistics; the shortest
code wins and the score is its posterior under equal priors.

The trees of all languages lie in one table per order, keyed by the bytes of context and symbol, so that a text is
scored for all languages by a few vectorised look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 3

#: Most labelled texts of each language that training takes.
TEXTS = 600

#: Bytes of text that are scored at once: each takes some 40 bytes of keys, slots and bits.
SLICE_BYTES = 1 << 20

#: What stands before the first byte of a text.
START = b"\n" * ORDER

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def grams(data: bytes) -> np.ndarray:
    """The keys of context and symbol, four bytes each, of all bytes of ``data`` after the first three."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


@dataclass
class Level:
    """The contexts of one order: sorted keys with the bits of each language, and the escape bits of contexts."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class Trees:
    """Frozen context trees of several languages."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """``counts``: for each language the sorted four-byte keys and how often each occurred."""
        self.languages = languages
        n_lang = len(languages)
        self.levels: list[Level] = []
        for k in range(ORDER + 1):
            mask = np.uint32(0xFFFFFFFF >> (8 * (ORDER - k)))
            each = []
            for keys, n in counts:
                u, back = np.unique(keys & mask, return_inverse=True)
                each.append((u, np.bincount(back, weights=n, minlength=len(u))))
            union = np.unique(np.concatenate([u for u, _ in each] + [np.zeros(0, np.uint32)])) if k else np.arange(256, dtype=np.uint32)
            contexts = np.unique(union >> np.uint32(8))
            escapes = np.zeros((len(contexts), n_lang))
            known = np.full((len(union), n_lang), np.nan)
            for i, (u, n) in enumerate(each):
                ctx, back = np.unique(u >> np.uint32(8), return_inverse=True)
                total, kinds = np.bincount(back, weights=n, minlength=len(ctx)), np.bincount(back, minlength=len(ctx))
                known[np.searchsorted(union, u), i] = -np.log2(n / (total + kinds)[back])
                escapes[np.searchsorted(contexts, ctx), i] = -np.log2(kinds / (total + kinds))
            level = Level(union, known, contexts, escapes)
            shorter = self.longer_code(k, union, level)
            level.bits = np.where(np.isnan(known), shorter, known)
            self.levels.append(level)
        top = self.levels[ORDER]
        weight = np.zeros(len(top.keys))
        for keys, n in counts:
            weight[np.searchsorted(top.keys, keys)] += n
        self.slot_bits = max(12, int(np.ceil(np.log2(2 * max(1, len(top.keys))))))
        self.slot_key = np.zeros(1 << self.slot_bits, np.uint32)
        self.slot_row = np.full(1 << self.slot_bits, -1, np.int32)
        order = np.argsort(weight, kind="stable")  # of keys that share a slot the commonest stays
        slots = self.slot(top.keys[order])
        self.slot_key[slots], self.slot_row[slots] = top.keys[order], order
        self.slot_cost = np.ascontiguousarray(np.where(self.slot_row[:, None] >= 0, top.bits[self.slot_row] if len(top.keys) else 0.0, 0.0).T)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.slot_bits)

    def longer_code(self, k: int, keys: np.ndarray, level: Level | None = None) -> np.ndarray:
        """Bits where order ``k`` lacks the symbol: its escape, if it knows the context, and the code of order k - 1."""
        level = level or self.levels[k]
        at, hit = find(level.contexts, keys >> np.uint32(8))
        escape = np.where(hit[:, None], level.escapes[at] if len(level.contexts) else 0.0, 0.0)
        if k == 0:
            return escape + 8.0
        return escape + self.code(k - 1, keys & np.uint32(0xFFFFFFFF >> (8 * (ORDER - k + 1))))

    def code(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Bits of each key of order ``k`` in each language."""
        level = self.levels[k]
        at, hit = find(level.keys, keys)
        out = np.empty((len(keys), len(self.languages)))
        out[hit] = level.bits[at[hit]]
        if not hit.all():
            out[~hit] = self.longer_code(k, keys[~hit])
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        sizes = np.array([len(texts[i]) for i in full])
        keys = grams(b"".join([START + texts[i] for i in full]))
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
        real = np.ones(len(keys), bool)
        for k in range(ORDER):  # keys of what stands before the next text
            real[starts[1:] - 1 - k] = False
        keys = keys[real]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        slot = self.slot(keys)
        other = np.flatnonzero((self.slot_key[slot] != keys) | (self.slot_row[slot] < 0))
        rest = self.code(ORDER, keys[other]) if len(other) else None
        for i in range(len(self.languages)):
            bits = self.slot_cost[i][slot]
            if rest is not None:
                bits[other] = rest[:, i]
            out[full, i] = np.add.reduceat(bits, first)
        return out

    def predict(self, texts: list[bytes | None]) -> dict:
        bits = self.lengths([t or b"" for t in texts])
        langs, scores, per = [], [], []
        for t, row in zip(texts, bits):
            if not t or not self.languages or not LETTER.search(t.decode("utf-8", "replace")):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                per.append(None)
                continue
            best = int(np.argmin(row))
            langs.append(self.languages[best])
            scores.append(float(1.0 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
            per.append(float(row[best] / len(t)))
        return {"lang_pred": langs, "score": scores, "bits_per_byte": per}


def count_kernel(batches):
    """(language, key, count) of the four-byte keys of the texts in each batch."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), common.byte_lists(batch.column(1))):
            if text:
                by.setdefault(lang, []).append(grams(START + text))
        for lang, parts in by.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])
    common.give_back()


def train(docs: DataFrame, allowed: Column | None = None, bound: int = TEXTS) -> Trees:
    """Trees from at most ``bound`` texts of each language among the rows that ``allowed`` admits."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    source = docs if allowed is None else docs.where(allowed)
    source = source.where("text is not null and length(text) > 0")
    picked = common.labelled_sample(docs.where(allowed) if allowed is not None else docs, "lang", bound)
    if not picked:
        return Trees([], [])
    wanted = F.broadcast(common.local_table(spark, picked, "doc_id bigint, lang string"))
    rows = source.select("doc_id", "lang", "text").join(wanted, ["doc_id", "lang"], "left_semi").select("lang", "text")
    got = rows.mapInArrow(count_kernel, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(got.column("lang").to_pylist(), object)
    keys, n = got.column("key").to_numpy().astype(np.uint32), got.column("n").to_numpy()
    names = sorted(set(langs.tolist()))
    counts = []
    for name in names:
        k, c = keys[langs == name], n[langs == name]
        order = np.argsort(k)
        counts.append((k[order], c[order]))
    return Trees(names, counts)


def predictor(spark, trees: Trees):
    shared = spark.sparkContext.broadcast(trees)
    return common.text_kernel(lambda texts: shared.value.predict(texts), "lang_pred string, score double, bits_per_byte double", limit=SLICE_BYTES)


def identify(docs: DataFrame, trees: Trees, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or columns ``keep``) with lang_pred, score and bits_per_byte.

    ``und`` and score 0 where the text is null, empty or without a letter, or where nothing was learned. Of equally short
    codes the first language in alphabetical order wins. Each row is scored by itself, so repeated rows agree, and a text
    of any length whole. Columns named, in whatever case, like a new one are replaced; an empty table gives an empty result.
    """
    common.bound_batches(docs.sparkSession)
    return common.with_struct(docs, predictor(docs.sparkSession, trees)(F.col("text")), ["lang_pred", "score", "bits_per_byte"], keep)


def keep_identified(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose language is determined with a posterior of ``least`` or more.

    Null, empty and letterless texts go; null ids and repeated rows are treated like others.
    """
    common.bound_batches(docs.sparkSession)
    made = predictor(docs.sparkSession, trees)(F.col("text"))
    names = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), made.alias("__p"))
    return tagged.where((F.col("__p.lang_pred") != UNDETERMINED) & (F.col("__p.score") >= least)).select(*[F.col("__row").getField(c).alias(c) for c in names])
