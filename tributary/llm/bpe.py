"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In every round each unfinished word finds its lowest-ranked adjacent
pair (binary search of all adjacent pairs over the sorted pair keys of the merge table) and merges all occurrences of
that pair, left to right, at once; words without a mergeable pair leave the array. This is the order in which a
priority queue merges, because a merge can only create pairs of a higher rank than the one that made their symbol.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Units kept in a worker's cache; it is emptied when full, which costs time only.
CACHE_UNITS = 600_000

#: Longer units leave the cache after their texts, so that its bytes are bounded too.
LONG_UNIT = 256

#: Words whose merge rounds run together.
WORDS = 8_000

#: No merge: larger than any rank.
NONE = np.int32(2**31 - 1)

#: The printable stand-ins of the 256 bytes in byte-level vocabularies.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Fixed value: the split pattern of byte-level BPE files that ask for their own regex.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of other characters with the space before them, and white space less the character that a run takes.
UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")

#: White space to the module re only; texts with it are split by the full pattern at once.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next code point from 256 on."""
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in set(PRINTABLE):
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class ByteBpe:
    """A byte-level BPE vocabulary file of the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.size = size
        self.pieces = [b""] * size
        for word, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in word)
        for word, i in self.specials.items():
            self.pieces[i] = word.encode()
        self.base = np.array([vocab.get(c, -1) for c in letters], np.int32)
        if (self.base < 0).any():
            raise ValueError(f"{path} lacks a byte")
        self.take_merges(vocab, model["merges"])
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.split = regex.compile(SPLIT)
        self.cache: dict[str, bytes] = {}
        self.long: list[str] = []
        self.decimal = [b"%d" % i for i in range(size)]
        self.piece_of = dict(zip(self.decimal, self.pieces))

    def take_merges(self, vocab: dict[str, int], merges: list) -> None:
        """Sorted pair keys with their ranks and merged symbols."""
        size = self.size
        pairs, ranks, made = [], [], []
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            if a in vocab and b in vocab and a + b in vocab:
                pairs.append(vocab[a] * size + vocab[b])
                ranks.append(rank)
                made.append(vocab[a + b])
        keys = np.array(pairs, np.int64)
        order = np.argsort(keys, kind="stable")
        # a pair that is listed twice has its last rank, as in a map that is filled in order
        keys, ranks, made = keys[order], np.array(ranks, np.int64)[order], np.array(made, np.int64)[order]
        last = np.append(keys[1:] != keys[:-1], True) if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks, self.made = keys[last], ranks[last].astype(np.int32), made[last].astype(np.int32)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, NONE where there is no merge; merged symbol) of adjacent pairs, by binary search over the pair keys."""
        key = left.astype(np.int64) * self.size + right
        if not len(self.keys):
            return np.full(len(key), NONE), left
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words one after the other, number of tokens of each word)."""
        return self.merged(self.base[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words], np.int64))

    def merged(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are given by their first symbols, one word after the other, and their lengths."""
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank, new = np.full(len(flat), NONE), np.zeros(len(flat), np.int32)
        if len(flat) > 1:
            rank[:-1], new[:-1] = self.ranked(flat[:-1], flat[1:])
            rank[:-1][owner[1:] != owner[:-1]] = NONE
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(flat):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            top = np.repeat(best, np.diff(np.append(starts, len(flat))))
            going = top != NONE
            if not going.all():
                over = ~going
                ended.append((owner[over], flat[over]))
                flat, owner, rank, new, top = flat[going], owner[going], rank[going], new[going], top[going]
                if not len(flat):
                    break
            idx = np.flatnonzero(rank == top)
            # in a run of overlapping equal pairs (x x x) every second one is taken, from the left
            gap = np.diff(idx) != 1
            if not gap.all():
                fresh = np.append(True, gap)
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(idx)), 0))
                idx = idx[(np.arange(len(idx)) - run) % 2 == 0]
            flat[idx] = new[idx]
            keep = np.ones(len(flat), bool)
            keep[idx + 1] = False
            flat, owner, rank, new = flat[keep], owner[keep], rank[keep], new[keep]
            # only pairs beside a new symbol have another rank than before; each merge before it took one place
            at = idx - np.arange(len(idx))
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at] = NONE
            at = at[at + 1 < len(flat)]
            at = at[owner[at] == owner[at + 1]]
            rank[at], new[at] = self.ranked(flat[at], flat[at + 1])
        if not ended:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        owner = np.concatenate([o for o, _ in ended])
        flat = np.concatenate([f for _, f in ended])
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))

    def learn(self, units: set[str]) -> None:
        """Puts the tokens of new units into the cache, as decimal ids joined by commas; their words become units too."""
        cache, find = self.cache, self.split.findall
        split: list[tuple[str, list[str]]] = []
        words: set[str] = set()
        for u in units:
            core = u[1:] if u[0] == " " else u
            if core.isalpha():
                words.add(u)
                continue
            ws = [u[:-1], u[-1]] if core[:-1].isalpha() and core[-1] in ".,;:!?" else find(u)
            words.update(ws)
            if len(ws) > 1:
                split.append((u, ws))
        todo = list(words.difference(cache))
        for part in range(0, len(todo), WORDS):
            some = todo[part : part + WORDS]
            flat, counts = self.merge([w.encode() for w in some])
            text = [*map(self.decimal.__getitem__, flat.tolist())]
            a = 0
            for w, n in zip(some, counts.tolist()):
                cache[w] = text[a] if n == 1 else b",".join(text[a : a + n])
                a += n
        for u, ws in split:
            cache[u] = b",".join([cache[w] for w in ws])
        self.long += [u for some in (units, words) for u in some if len(u) > LONG_UNIT]

    def units(self, text: str) -> list[str]:
        """Parts of a text that are encoded by themselves: runs without white space, each with a space before it, and
        the white space between. The words that BPE sees are parts of such units, as no word crosses their borders."""
        if ODD_SPACE.search(text):
            return self.split.findall(text)
        return UNITS.findall(text)

    def pieces_of(self, text: str) -> list[str]:
        if self.special_split is not None and any(s in text for s in self.specials):
            out: list[str] = []
            for i, part in enumerate(self.special_split.split(text)):
                out += [part] if i % 2 else self.units(part)
            return out
        return self.units(text)

    def encode_lists(self, texts: list[str]) -> list[bytes]:
        """For each text its decimal ids joined by commas."""
        split = [self.pieces_of(t) for t in texts]
        seen: set[str] = set()
        for us in split:
            seen.update(us)
        new = seen.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_UNITS or not self.cache:
            self.cache.clear()
            self.cache.update({s: self.decimal[i] for s, i in self.specials.items()})
            new = seen.difference(self.cache)
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        out = [b",".join(map(get, us)) for us in split]
        for u in self.long:
            self.cache.pop(u, None)
        self.long.clear()
        return out

    def encode(self, text: str) -> list[int]:
        joined = self.encode_lists([text])[0]
        return [int(x) for x in joined.split(b",")] if joined else []

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def digest_kernel(path: str):
    """Kernel: encode each text, decode what was encoded, and digest both."""

    def kernel(texts: list) -> dict:
        bpe = loaded(path)
        piece = bpe.piece_of.__getitem__
        n, ids, decoded = [], [], []
        for joined in bpe.encode_lists([t or "" for t in texts]):
            n.append(joined.count(b",") + 1 if joined else 0)
            ids.append(hashlib.sha256(joined).hexdigest())
            raw = b"".join(map(piece, joined.split(b","))) if joined else b""
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            decoded.append(hashlib.sha256(raw).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return kernel


def encode_kernel(path: str):
    def kernel(texts: list) -> dict:
        bpe = loaded(path)
        return {"ids": [[int(x) for x in j.split(b",")] if j else [] for j in bpe.encode_lists([t or "" for t in texts])]}

    return kernel


def decode_kernel(path: str):
    def run(col):
        import pyarrow as pa

        bpe = loaded(path)
        return pa.array([None if ids is None else bpe.decode(ids) for ids in col.to_pylist()], pa.string())

    return run


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` (array of int); null and empty texts have no tokens.

    Texts are split and cached word by word, so a repeated or very long text costs no more than its words; ties cannot
    occur, since ranks are distinct. Other columns pass through; a column named ``out`` is replaced.
    """
    common.bound_batches(docs.sparkSession)
    made = common.text_kernel(encode_kernel(path), "ids array<int>", raw=False)(F.col(text))
    return docs.select(*[F.col(f"`{c}`") for c in common.without(docs.columns, [out])], made.getField("ids").alias(out))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the id array ``ids``; null gives null, an empty array gives an empty text."""
    import pyarrow as pa

    run = decode_kernel(path)
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(run, returnType="string")(F.col(ids)))


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256 of every whole text, in one pass without a shuffle.

    A null text counts as empty (0 tokens, digests of nothing). One row comes out for each row in, repeated rows and
    null ids included; an empty table gives an empty result.
    """
    common.bound_batches(docs.sparkSession)
    made = common.text_kernel(digest_kernel(path), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", raw=False)(F.col(text))
    return common.with_struct(docs, made, ["n_tokens", "ids_sha256", "decoded_sha256"], keep)
