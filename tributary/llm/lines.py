"""Line deduplication by pairwise alignment.

Passages are known by 128-bit hashes of windows: from each line on, and up to each line, the fewest lines that have
enough words. A block that two documents share, contiguous in both and of enough words, is the union of such windows,
so the first holders of its windows lead to all of it, however many documents hold single lines of it. The windows that
a later document shares with a first holder are aligned by patience diff (windows unique to both sides, longest
increasing run, then the same between its anchors), and the lines of aligned windows are deleted from the later
document, with all their other copies there. What is left, for it stands in another order, is aligned with the first
holder again, until nothing that the two share is left. The first holder's copy of a window is never what makes it
repeated there.
"""

from __future__ import annotations

import bisect
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A block is deleted if it has this many words at least.
BLOCK_WORDS = 10

#: Rounds in which what is left of two documents is aligned together; after them each window is aligned by itself, which
#: deletes the same lines.
ROUNDS = 8

#: Bytes of text whose windows are made at once: they take a multiple of the text.
SLICE_BYTES = 1 << 20

SPACE = b" \t\n\x0b\x0c\r"


def windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) line of the shortest runs of at least ``least`` words from each line on and up to each line."""
    out = set()
    total = end = 0
    for start, n in enumerate(words):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        out.add((start, end - 1))
        total -= n
    total = start = 0
    for end, n in enumerate(words):
        total += n
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            out.add((start, end))
    return sorted(out)


def window_kernel(least: int):
    """The distinct windows of each document with their places among its lines that are not blank.

    ``at`` packs places as int32, ``words`` the words of each line, 255 at most, as uint8.
    """

    def run(batches):
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), common.byte_lists(batch.column(2))
            for a, b in common.slices(texts, limit=SLICE_BYTES):
                source, h, at, words = [], [], [], []
                for i, t in enumerate(texts[a:b], a):
                    if not t:
                        continue
                    solid = [x for x in t.split(b"\n") if x.strip(SPACE)]
                    count = [len(x.split()) for x in solid]
                    seen: dict[bytes, list[tuple[int, int]]] = {}
                    for x, y in windows(count, least):
                        seen.setdefault(solid[x] if x == y else b"\n".join(solid[x : y + 1]), []).append((x, y))
                    for text, where in seen.items():
                        x, y = where[0]
                        source.append(i)
                        h.append(hashlib.blake2b(text, digest_size=16).digest())
                        at.append(struct.pack(f"<{len(where)}i", *[p for p, _ in where]))
                        words.append(bytes([min(n, 255) for n in count[x : y + 1]]))
                take = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(h, pa.binary()), pa.array(at, pa.binary()), pa.array(words, pa.binary())], names=["doc", "key", "h", "at", "words"])
            del texts
            common.give_back()

    return run


def longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first part, a longest sequence whose second parts increase (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect.bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            last.append(i)
        else:
            tops[k], last[k] = y, i
        back.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(later: list[tuple[int, int]], first: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned places (later, first) of two sequences of (place, line), both in order of place."""
    done: list[tuple[int, int]] = []
    todo = [(later, first)]
    while todo:
        a, b = todo.pop()
        i = 0
        while i < len(a) and i < len(b) and a[i][1] == b[i][1]:
            done.append((a[i][0], b[i][0]))
            i += 1
        j = 0
        while j < len(a) - i and j < len(b) - i and a[-1 - j][1] == b[-1 - j][1]:
            done.append((a[-1 - j][0], b[-1 - j][0]))
            j += 1
        a, b = a[i : len(a) - j], b[i : len(b) - j]
        if not a or not b:
            continue
        once_a, once_b = single(a), single(b)
        common_lines = sorted((i, once_b[line]) for line, i in once_a.items() if line in once_b)
        run = longest_run(common_lines)
        if not run:
            continue
        done += [(a[x][0], b[y][0]) for x, y in run]
        for (x, y), (x2, y2) in zip([(-1, -1), *run], [*run, (len(a), len(b))]):
            if x + 1 < x2 and y + 1 < y2:
                todo.append((a[x + 1 : x2], b[y + 1 : y2]))
    return sorted(done)


def single(seq: list[tuple[int, int]]) -> dict[int, int]:
    """Index of each line that occurs once."""
    seen: dict[int, int] = {}
    for i, (_, line) in enumerate(seq):
        seen[line] = -1 if line in seen else i
    return {line: i for line, i in seen.items() if i >= 0}


def deleted(shared: list[tuple[list[int], list[int], bytes]]) -> list[int]:
    """Places in the later document that go, given each shared window's places in it, in the first one, and its words."""
    later = sorted((p, k) for k, (at, _, _) in enumerate(shared) for p in at)
    first = sorted((p, k) for k, (_, at, _) in enumerate(shared) for p in at)
    begin: dict[int, list[int]] = {}
    for p, k in later:
        begin.setdefault(p, []).append(k)
    there = set(first)
    out: set[int] = set()
    for x, y in patience(later, first):
        for k in begin[x]:
            if (y, k) in there:
                out.update(p + i for p in shared[k][0] for i in range(len(shared[k][2])))
    return sorted(out)


def gone(shared: dict[tuple, list[tuple[list[int], list[int], bytes]]]) -> tuple[list[int], list[int]]:
    """(places that go, first holders that have some of them) of a later document, given its shared windows by holder."""
    out: set[int] = set()
    sources: set[int] = set()
    for first, left in shared.items():
        for _ in range(ROUNDS):
            cut = set(deleted(left))
            out |= cut
            left = [(rest, held, words) for at, held, words in left if (rest := [p for p in at if not cut.issuperset(range(p, p + len(words)))])]
            if not cut or not left:
                break
        for window in left:
            out.update(deleted([window]))
        sources.add(first[0])
    return sorted(out), sorted(sources)


def places(packed: bytes) -> list[int]:
    return [*struct.unpack(f"<{len(packed) // 4}i", packed)]


def once(kernel):
    """The kernel, run once for each row: otherwise Spark moves a filter on its result below it and runs it there as well,
    in further workers of the same task."""
    return kernel.asNondeterministic()


def align_udf():
    def run(col: pa.Array) -> pa.Array:
        removed, sources = [], []
        for rows in col.to_pylist():
            by: dict[tuple, list] = {}
            for x in rows:
                by.setdefault((x["first"]["doc"], x["first"]["key"]), []).append((places(x["at"]), places(x["first_at"]), x["words"]))
            cut, holders = gone(by)
            removed.append(cut)
            sources.append(holders)
        common.give_back()
        return pa.StructArray.from_arrays([pa.array(removed, pa.list_(pa.int32())), pa.array(sources, pa.list_(pa.int64()))], names=["removed", "sources"])

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return once(F.arrow_udf(run, returnType="removed array<int>, sources array<bigint>"))


def without(text: bytes, places: list[int]) -> bytes:
    """The text less the lines at these places among those that are not blank."""
    gone = set(places)
    out, n = [], 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            n += 1
            if n - 1 in gone:
                continue
        out.append(line)
    return b"\n".join(out)


def cut_udf():
    def run(text: pa.Array, places: pa.Array) -> pa.Array:
        raw, cut = common.byte_lists(text), places.to_pylist()
        made, lines = [], []
        for t, p in zip(raw, cut):
            lines.append(0 if not t else sum(1 for x in t.split(b"\n") if x.strip(SPACE)))
            made.append(t if t is None or not p else without(t, p))
        del raw, cut
        common.give_back()
        return pa.StructArray.from_arrays([pa.array(made, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64())], names=["text", "n_lines"])

    run.__annotations__ = {"text": pa.Array, "places": pa.Array, "return": pa.Array}
    return once(F.arrow_udf(run, returnType="text string, n_lines bigint"))


def removals(docs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """(doc, key, removed, sources): the places that go from each document and the earlier documents that hold them.

    A document is its id with a hash of its text; earlier means a smaller id, then a smaller hash.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("key"), "text")
    lines = common.materialized(texts.mapInArrow(window_kernel(least), "doc bigint, key bigint, h binary, at binary, words binary"))
    me = F.struct("doc", "key")
    # kept apart, so that both sides of the join are plain shuffles and a very common passage is split over tasks
    firsts = lines.groupBy("h").agg(F.min(me).alias("first"), F.max(me).alias("last"), F.min_by("at", me).alias("first_at")).where("first != last").select("h", "first", "first_at")
    later = lines.join(common.materialized(firsts), "h").where(me != F.col("first"))
    shared = later.groupBy("doc", "key").agg(F.collect_set(F.struct("first", "h", "at", "first_at", "words")).alias("shared"))
    return shared.select("doc", "key", align_udf()(F.col("shared")).alias("cut")).select("doc", "key", "cut.removed", "cut.sources").where(F.size("removed") > 0)


def dedupe(docs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated blocks, and n_lines, removed_lines and sources.

    n_lines counts lines that are not blank, before removal; removed_lines are places among them. A null or empty text
    and a row without doc_id stay as they are. Rows that agree in doc_id and text are one document and are cut alike.
    Columns named, in whatever case, like the three new ones are replaced. Lines that repeat only inside one document stay.
    Of holders with equal ids the one of the smaller text hash is the first. Texts of any length are aligned whole; an empty
    table gives an empty result.
    """
    common.bound_batches(docs.sparkSession)
    names = common.without(docs.columns, ["n_lines", "removed_lines", "sources"])
    # places are found before texts are cut: a stage with both kernels takes two workers for each of its tasks, which live on
    gone = common.materialized(removals(docs, least)).withColumnRenamed("key", "__key").withColumnRenamed("doc", "__doc").withColumnRenamed("sources", "__sources")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.xxhash64("text").alias("__k"))
    joined = row.join(gone, (F.col("__row.doc_id") == F.col("__doc")) & (F.col("__k") == F.col("__key")), "left")
    cut = joined.withColumn("__cut", cut_udf()(F.col("__row.text"), F.col("removed")))
    none = F.array().cast(T.ArrayType(T.IntegerType()))
    kept = [F.col("__cut.text").alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in names]
    return cut.select(*kept, F.col("__cut.n_lines").alias("n_lines"), F.coalesce("removed", none).alias("removed_lines"), F.coalesce("__sources", F.array().cast(T.ArrayType(T.LongType()))).alias("sources"))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, less repeated blocks and less texts of which nothing remains.

    n_chars, where there is such a column, is counted anew for texts that were cut; all other columns keep their values,
    whatever their names. Nulls, empty texts, ties and repeated rows are treated as in ``dedupe``.
    """
    other = [c for c in docs.columns if c != "text"]
    out = dedupe(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in other]).alias("row")))
    cut = F.size("removed_lines") > 0
    out = out.where(~cut | (F.length(F.trim(F.regexp_replace("text", r"[\s]+", " "))) > 0))
    value = {c: F.col("row").getField(c) for c in other} | {"text": F.col("text")}
    if "n_chars" in value:
        value["n_chars"] = F.when(cut, F.length("text")).otherwise(value["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[value[c].alias(c) for c in docs.columns])
