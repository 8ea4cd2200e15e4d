"""The operators' methods against plain versions: brute force, libraries, round trips, held-out accuracy."""

import collections
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tributary.llm import bpe, brown, common, crf, graph, kneser_ney, lines, matroska, ngram_join, packing, ppm, queries, rules
from tributary.llm.queries import vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
BYTE_LIB, WORD_LIB = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
ODD = st.text(alphabet=st.sampled_from(list("abcXYZ ñéßİΣकक़़你好😀0²Ⅷ.,'!<|\n\t\x1c\x85\xa0​")), max_size=40)


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang").toPandas()


# BPE


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_bpe_equals_the_library(text):
    t, b = BYTE_LIB, bpe.loaded(BYTE)
    ids = t.encode(text + "<|endoftext|>" + text, add_special_tokens=False).ids
    assert b.encode(text + "<|endoftext|>" + text) == ids
    assert b.decode(ids[: len(ids) // 2]) == t.decode(ids[: len(ids) // 2], skip_special_tokens=False)


def test_bpe_long_word_and_overlaps():
    t, b = BYTE_LIB, bpe.loaded(BYTE)
    for text in ("a" * 5001, "ab" * 3000, "x" * 7 + " " * 9 + "y", "   "):
        assert b.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, rows):
    t = BYTE_LIB
    got = queries.op3_bpe(spark, SF).toPandas().set_index("doc_id")
    for d, text in zip(rows.doc_id, rows.text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got.loc[d]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# packing


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_chunk_tokens_equal_the_library(text):
    t = WORD_LIB
    assert np.frombuffer(packing.loaded(WORD).ids([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 60), st.lists(st.integers(1, 60), max_size=40))
def test_packing_is_sound_and_near_best(capacity, sizes):
    h = collections.Counter(min(s, capacity) for s in sizes)
    n, plan = packing.solve(h, capacity)
    bins = collections.defaultdict(list)
    for size, c in h.items():
        for b, o in zip(*(x.tolist() for x in packing.place(plan, np.full(c, size), np.arange(c)))):
            bins[b].append((o, size))
    assert len(bins) == n
    for parts in bins.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= capacity
    assert n <= plain_first_fit_decreasing(h, capacity)


def plain_first_fit_decreasing(h, capacity):
    room = []
    for s in sorted(h.elements(), reverse=True):
        for i, r in enumerate(room):
            if r >= s:
                room[i] -= s
                break
        else:
            room.append(capacity - s)
    return len(room)


def test_dominance_fixes_perfect_pairs():
    bins = packing.Bins(10)
    left = {7: 2, 3: 3, 10: 1, 6: 1, 5: 1}
    packing.reduce(left, bins)
    assert left.get(10) is None and left.get(7) is None and bins.n >= 3


def test_packing_query(spark, rows):
    t = WORD_LIB
    got = queries.op4_best_fit_packing(spark, SF).toPandas()
    by = {d: g.sort_values("piece") for d, g in got.groupby("doc_id")}
    for d, text in zip(rows.doc_id, rows.text):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        g = by[d]
        assert g.length.sum() == len(ids) and (g.length[:-1] == 4096).all()
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) * 1.02 + 1


# media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=12_000), st.sampled_from(["xiph", "fixed", "ebml"]))
def test_matroska_round_trip(data, lacing):
    payload = matroska.padded(data)
    found = matroska.parse(matroska.store(payload, lacing))
    assert matroska.read_back(matroska.store(payload, lacing), found) == payload
    assert len(found["packets"]) == len(payload) // 576 and found["tracks"][0]["codec"] == "A_PCM/INT/LIT"
    data = matroska.store(payload, lacing)
    for _, when, place in found["cues"]:
        kind, _, _ = matroska.element_head(data, place, len(data))
        assert kind == matroska.CLUSTER and any(p[1] == when for p in found["packets"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=2, max_size=9), st.sampled_from(["xiph", "ebml"]))
def test_uneven_lacing(frames, lacing):
    cluster = matroska.element(matroska.TIMESTAMP, b"\x05") + matroska.block(1, -2, frames, lacing)
    head = matroska.element(matroska.EBML, b"")
    for segment in (matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, cluster)), b"\x18\x53\x80\x67\xff\x1f\x43\xb6\x75\xff" + cluster):
        data = head + segment  # the second has unknown sizes
        found = matroska.parse(data)
        assert [data[p[3] : p[3] + p[4]] for p in found["packets"]] == frames and found["packets"][0][1] == 3_000_000


def test_bytes_written_by_hand_are_parsed():
    """A file spelled out byte by byte after the specification, whose examples of lacing (800, 500, 1000 bytes) it holds."""
    a, b, c = b"a" * 800, b"b" * 500, b"c" * 1000
    xiph = bytes.fromhex("81 0000 02 02 ffffff23 fff5") + a + b + c  # track 1, at 0, Xiph lacing, three frames
    ebml = bytes.fromhex("4002 0010 06 02 4320 5ed3") + a + b + c  # track 2 in two bytes, at 16, not a key frame
    fixed = bytes.fromhex("81 fffe 84 01") + b"xy" + b"zw"  # two ticks before the cluster's time
    track = lambda n: bytes.fromhex(f"ae 86 d7 81 0{n} 83 81 02")
    size = lambda n: (0x10000000 | n).to_bytes(4, "big")
    info = bytes.fromhex("1549a966 87 2ad7b1 83 0f4240")  # a tick is a millisecond
    tracks = bytes.fromhex("1654ae6b 90") + track(1) + track(2)
    first = bytes.fromhex("e7 81 64") + bytes.fromhex("a3") + size(len(xiph)) + xiph + bytes.fromhex("ec 83 000000") + bytes.fromhex("a0") + size(5 + len(ebml)) + bytes.fromhex("a1") + size(len(ebml)) + ebml
    second = bytes.fromhex("e7 82 0200") + bytes.fromhex("a3 89") + fixed
    # a segment and a first cluster of unknown size; the second cluster ends the first
    data = bytes.fromhex("1a45dfa3 8b 4282 88") + b"matroska" + bytes.fromhex("18538067 01ffffffffffffff") + info + tracks + bytes.fromhex("1f43b675 ff") + first + bytes.fromhex("1f43b675") + size(len(second)) + second
    got = matroska.parse(data)
    packets = [(t, when, key, data[p : p + n], cluster, lace) for t, when, key, p, n, cluster, lace, _ in got["packets"]]
    ms = 1_000_000
    assert packets[:3] == [(1, 100 * ms, False, a, 0, 0), (1, 100 * ms, False, b, 0, 1), (1, 100 * ms, False, c, 0, 2)]
    # a group that refers to no other block is a key frame
    assert packets[3:6] == [(2, 116 * ms, True, a, 0, 0), (2, 116 * ms, True, b, 0, 1), (2, 116 * ms, True, c, 0, 2)]
    assert packets[6:] == [(1, 510 * ms, True, b"xy", 1, 0), (1, 510 * ms, True, b"zw", 1, 1)]
    assert matroska.vint(800, 2) == bytes.fromhex("4320") and matroska.read_vint(bytes.fromhex("10000001"), 0, 4) == (1, 4)


def test_times_of_laced_frames_key_frames_and_cues_written_by_hand():
    """Durations by track and by group, the three lacings, references, two tracks in one cue point, a track's scale."""
    xiph = bytes.fromhex("81 0000 82 02 0102") + b"abbccc"  # three frames of 1, 2 and 3 bytes, at 0
    fixed = bytes.fromhex("81 000a 84 01") + b"xyzw"  # two frames, at 10
    ebml = bytes.fromhex("82 0014 06 02 81 c0") + b"abbccc"  # track 2 at 20: 1, 2 (one more) and 3 bytes
    assert [n for _, n in matroska.laced(ebml, 4, len(ebml), 3)] == [1, 2, 3]
    info = bytes.fromhex("1549a966 87 2ad7b1 83 0f4240")
    one = bytes.fromhex("ae 8d d7 81 01 83 81 02 23e383 83 4c4b40")  # track 1: 5 ms a frame
    two = bytes.fromhex("ae 8e d7 81 02 83 81 01 23314f 84 40000000")  # track 2: its times count twice
    tracks = bytes.fromhex("1654ae6b") + bytes([0x80 | len(one + two)]) + one + two
    el = lambda kind, body: bytes.fromhex(kind) + bytes([0x80 | len(body)]) + body
    groups = el("a0", el("a1", ebml) + el("9b", b"\x1e") + el("fb", b"\xff")) + el("a0", el("a1", bytes.fromhex("82 0032 00") + b"q") + el("9b", b"\x07"))
    body = bytes.fromhex("e7 81 64") + el("a3", xiph) + el("a3", fixed) + groups
    cluster = el("1f43b675", el("bf", zlib.crc32(body).to_bytes(4, "little")) + body)
    cues = el("1c53bb6b", el("bb", bytes.fromhex("b3 81 64") + el("b7", bytes.fromhex("f7 81 01 f1 81 40")) + el("b7", bytes.fromhex("f7 81 02 f1 81 40"))))
    inner = info + tracks + cluster + cues
    data = bytes.fromhex("1a45dfa3 80 18538067 01") + len(inner).to_bytes(7, "big") + inner
    ms = 1_000_000
    got = [(r["track"], r["timestamp_ns"] / ms, r["keyframe"], data[r["byte_offset"] :][: r["byte_length"]], r["duration_ns"] / ms, r["cued"]) for r in matroska.packet_rows(data)]
    assert got[:3] == [(1, 100, True, b"a", 5, True), (1, 105, True, b"bb", 5, False), (1, 110, True, b"ccc", 5, False)]
    assert got[3:5] == [(1, 110, True, b"xy", 5, False), (1, 115, True, b"zw", 5, False)]
    assert got[5:] == [(2, 140, False, b"a", 10, False), (2, 150, False, b"bb", 10, False), (2, 160, False, b"ccc", 10, False), (2, 200, True, b"q", 7, False)]
    assert [c[:2] for c in matroska.parse(data)["cues"]] == [(1, 100 * ms), (2, 100 * ms)]
    with pytest.raises(matroska.Malformed, match="checksum"):
        matroska.parse(data.replace(b"xyzw", b"xyzv"))


def test_stored_frames_follow_each_other():
    for frames, ms in ((8, 576), (20, 1440), (1, 72), (300, 21600)):
        payload = bytes(range(256)) * (576 * frames // 256) + b"\x80" * (576 * frames % 256)
        found = matroska.parse(matroska.store(payload))
        assert [p[1] for p in found["packets"]] == [72_000_000 * i for i in range(frames)]
        assert f";ms={ms};" in matroska.feature(payload, found)


def test_malformed_media_is_an_error_row(spark):
    media = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"\x1aE\xdf\xa3\x85abc")), (3, None), (4, bytearray(matroska.store(matroska.padded(b"x"))))], "id int, media binary")
    got = {r["id"]: (r["parse_error"] is None, r["byte_length"]) for r in matroska.packet_table(media, "media", ("id",)).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (False, None), 4: (True, 576)}


def test_media_query(spark, rows):
    got = queries.op5_matroska(spark, SF).toPandas().set_index("doc_id")
    for d, text in zip(rows.doc_id, rows.text):
        raw = (text or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got.loc[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


# quality rules


def plain_stats(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abc é世#|\n\t \x85")), max_size=120))
def test_statistics_of_odd_texts(text):
    assert rules.measure(text.encode())[:5] == plain_stats(text)


def test_rules_query(spark, rows):
    got = queries.op1_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for d, text in zip(rows.doc_id, rows.text):
        n, *rest = plain_stats(text)
        r = got.loc[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n) and not (r.base_failed and r.kept)


def test_covering_finds_a_planted_conjunction():
    rng = np.random.default_rng(1)
    x = {"n_words": rng.random(3000), "symbols_per_word": rng.random(3000), "upper_share": rng.random(3000)}
    bad = (x["n_words"] > 0.7) & (x["symbols_per_word"] <= 0.4)
    found = rules.learn(x, bad)
    assert (found.bad(x) == bad).mean() > 0.98 and len(found.rules) <= 6


def test_expression_equals_the_list(spark, docs):
    t = rules.Test
    found = rules.DecisionList([[t("n_words", False, 200.0), t("upper_share", True, 0.02)], [t("word_length", True, 5.6)]])
    got = rules.statistics(docs, keep=["doc_id"]).select(found.expression().alias("kept"), found.rule_number().alias("rule"), *[F.expr(e).alias(c) for c, e in rules.FEATURES.items()]).toPandas()
    assert (got.kept == ~found.bad({c: got[c].to_numpy(float) for c in rules.FEATURES})).all() and set(got.rule[~got.kept]) <= {1, 2}


# n-gram join


def plain_links(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(texts)
    link = [[(not a and not b) or bool(a and b) and Fraction(len(a & b), len(a | b)) >= Fraction(4, 5) for b in sets] for a in sets]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if link[i][j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [sum(r) - 1 for r in link], [find(i) for i in range(n)]


def test_join_equals_brute_force(spark, rows):
    texts = rows.text.tolist()
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    hot = [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # a large group of near copies, some at the threshold
        w = list(hot)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[-1]] * 20 + ["", None, "x y", "x y", "x z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["links"], r["class_id"]) for r in ngram_join.classes(df).collect()}
    links, roots = plain_links(texts)
    assert got == {i: (links[i], roots[i]) for i in range(len(texts))}


def test_join_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"v{rng.randrange(900)}" for _ in range(90)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(90)] = f"v{rng.randrange(900)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["links"], r["class_id"]) for r in ngram_join.classes(df).collect()}
    links, roots = plain_links(texts)
    assert got == {i: (links[i], roots[i]) for i in range(len(texts))}


def test_only_pairs_that_survive_pruning_are_verified(monkeypatch):
    """A chain of texts whose neighbours have a similarity of 0.744: hardly a pair survives, and only survivors are verified."""
    rng = random.Random(1)
    words, step = [f"c{rng.randrange(10**6)}" for _ in range(3000)], 9
    sets = [ngram_join.shingles(" ".join(words[i * step : i * step + 65]).encode()) for i in range(300)]
    low = np.stack([ngram_join.minhash(s).astype(np.uint8) for s in sets])
    i, j = ngram_join.undropped(low)
    want = {(a, b) for a in range(300) for b in (a + 1 + ngram_join.survivors(low[a], low[a + 1 :])).tolist()}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) < 600
    seen = []
    monkeypatch.setattr(ngram_join, "agreeing", lambda s, i, j, plain=ngram_join.agreeing: (seen.append(len(i)), plain(s, i, j))[1])
    cols = [np.zeros(300, np.int64)] * 4 + [np.arange(300), np.ones(300, np.int64)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([x.tobytes() for x in low]), pa.array([s.tobytes() for s in sets])], names=list("abcdefgh"))
    assert sum(b.num_rows for b in ngram_join.verify_kernel([batch])) == 0 and sum(seen) == len(want)
    dense = [sets[0], sets[0][:-1], sets[0][:-2], sets[0][1:], sets[5]]
    a, b = np.triu_indices(5, 1)
    plain = [Fraction(len(x & y), len(x | y)) >= Fraction(4, 5) for x, y in ((set(dense[p].tolist()), set(dense[q].tolist())) for p, q in zip(a, b))]
    assert ngram_join.agreeing(dense, a, b).tolist() == plain == ngram_join.linked(dense)[a, b].tolist()


def test_pruning_keeps_what_the_posterior_allows():
    one = np.zeros((1, 128), np.uint8)
    other = np.zeros((2, 128), np.uint8)
    other[1, :64] = 1
    assert ngram_join.survivors(one[0], other).tolist() == [0]
    assert 0 < ngram_join.LEAST[16] < 13 and ngram_join.LEAST[128] > 70


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for p in pairs if p[0] != p[1] for i in p}


# line dedup


def test_patience_aligns_lines_in_one_order():
    assert lines.longest_run([(0, 3), (1, 1), (2, 2), (3, 5)]) == [(1, 1), (2, 2), (3, 5)]
    a = [(0, 1), (1, 2), (2, 9), (3, 9), (4, 3)]
    b = [(10, 1), (11, 9), (12, 2), (13, 9), (14, 9), (15, 3)]
    got = lines.patience(a, b)
    assert (0, 10) in got and (4, 15) in got and all(dict(a)[x] == dict(b)[y] for x, y in got)
    assert [y for _, y in got] == sorted(y for _, y in got)


def test_line_dedup_deletes_from_later_documents(spark):
    block = "\n".join(f"this is line {i} of a passage that many documents share" for i in range(4))
    rows = [(5, f"own five\n{block}\nend five"), (2, f"{block}\nown two"), (9, f"own nine\n\n{block}"), (11, "own nine\nshort"), (12, block), (13, None), (14, f"x\n{block.splitlines()[3]}\ny\n{block.splitlines()[0]}")]
    got = {r["doc_id"]: r for r in lines.dedupe(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[2]["removed_lines"] == [] and got[2]["text"] == rows[1][1]
    assert got[5]["text"] == "own five\nend five" and got[5]["sources"] == [2] and got[9]["text"] == "own nine\n"
    assert got[12]["text"] == "" and got[11]["removed_lines"] == [] and got[13]["text"] is None
    assert got[14]["removed_lines"] == [1, 3]  # one of two crossed lines is aligned first, the other one then
    kept = lines.clean(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {2, 5, 9, 11, 13, 14}


def test_line_dedup_query(spark, rows):
    got = queries.op6_line_dedup(spark, SF).toPandas().set_index("doc_id")
    first, seen = {}, collections.Counter()
    for d, text in sorted(zip(rows.doc_id, rows.text)):
        for line in set((text or "").split("\n")):
            first.setdefault(line, d)
    for d, text in zip(rows.doc_id, rows.text):
        solid = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        for p in got.loc[d].removed_lines:
            assert first[solid[p]] < d
        for line in set((got.loc[d].text or "").split("\n")):
            if len(line.split()) > 50:
                seen[line] += 1
    assert not [x for x, n in seen.items() if n > 1]


# models


def test_context_trees_give_exact_code_lengths():
    texts = {"aa": ["abcabcabd", "abca"], "bb": ["xyxyxz", "xyzab"]}
    counts = []
    for ts in texts.values():
        k, n = np.unique(np.concatenate([ppm.grams(ppm.START + t.encode()) for t in ts]), return_counts=True)
        counts.append((k, n))
    trees = ppm.Trees([*texts], counts)

    def bits(language, text):
        seen = collections.defaultdict(collections.Counter)
        for t in texts[language]:
            s = ppm.START + t.encode()
            for i in range(3, len(s)):
                for k in range(4):
                    seen[s[i - k : i]][s[i]] += 1
        total, s = 0.0, ppm.START + text
        for i in range(3, len(s)):
            for k in (3, 2, 1, 0, None):
                if k is None:
                    total += 8
                    break
                ctx = seen.get(s[i - k : i])
                if ctx is None:
                    continue
                n, d = sum(ctx.values()), len(ctx)
                if s[i] in ctx:
                    total -= math.log2(ctx[s[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
        return total

    probe = [b"abcabd", b"xyz", b"\xff\x00q", b"a"]
    got = trees.lengths(probe)
    for i, p in enumerate(probe):
        for j, lang in enumerate(texts):
            assert got[i, j] == pytest.approx(bits(lang, p), rel=1e-12)


def test_language_query(spark, rows):
    got = queries.op7_language_id(spark, SF).toPandas().merge(rows, on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in held.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_kneser_ney_probabilities_sum_to_one():
    m = kneser_ney.build([b"abc", b"abd", b"xyz"], np.array([[3, 0], [1, 2], [0, 5]]))
    for ctx in (b"     ", b"   ab", b"zzzzz", b"    x"):
        keys = np.array([int.from_bytes(ctx + bytes([c]), "big") for c in range(256)], np.uint64)
        assert m.probability(kneser_ney.ORDER - 1, keys).sum(axis=0) == pytest.approx([1, 1])
    difference = lambda w: float(m.spelled([w])[0] @ [1, -1])
    assert difference(b"abc") > 1 > -1 > difference(b"xyz")


def fitted_to(texts, labels):
    """Models from plain counts of texts, and the counts."""
    counts = kneser_ney.counted([t.encode() for t in texts], labels)
    alone = {k[1]: n for k, n in counts.items() if k[0] is None}
    pairs = {k: n for k, n in counts.items() if k[0] is not None}
    m = kneser_ney.build([*alone], np.array([*alone.values()]))
    first = collections.defaultdict(lambda: np.zeros(2))
    for (v, _), n in pairs.items():
        first[v] += n
    of = [[n[0] for n in pairs.values()], [n[1] for n in pairs.values()], [sum(n) for n in pairs.values()]]
    m.pairs = kneser_ney.pair_model([(*k, *n) for k, n in pairs.items() if sum(n) >= kneser_ney.LEAST_PAIRS], {v: tuple(n) for v, n in first.items()}, [(x.count(1), x.count(2)) for x in of])
    return m, alone, pairs, first, of


def test_toxicity_evidence_equals_plain_probabilities():
    rng = random.Random(12)
    some = ["sun", "moon", "star", "sky", "rain", "zonk", "day"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    m, alone, pairs, first, of = fitted_to(texts, [i % 3 == 0 for i in range(60)])
    d = [kneser_ney.discount(np.array(x)) for x in of]

    def probability(c, v, w):
        spelled = math.exp(m.spelled([w])[0, c])
        if v is None:
            return spelled
        kept = {k[1]: n for k, n in pairs.items() if k[0] == v and sum(n) >= kneser_ney.LEAST_PAIRS}
        pool, own = first[v].sum(), first[v][c]
        take = lambda n, d: max(n - d, 0)
        below = spelled
        if pool:
            below = (take(sum(kept[w]), d[2]) if w in kept else 0) / pool + (1 - sum(take(sum(n), d[2]) for n in kept.values()) / pool) * spelled
        return below if not own else (take(kept[w][c], d[c]) if w in kept else 0) / own + (1 - sum(take(n[c], d[c]) for n in kept.values()) / own) * below

    probe = "sun moon zonk new star star sky"
    ws = probe.encode().split()
    by_pair = [math.log(probability(0, v, w) / probability(1, v, w)) for v, w in zip([None, *ws], ws)]
    by_spelling = [float(m.spelled([w])[0] @ [1, -1]) for w in ws]
    got = m.evidence([b"rain", probe.encode(), None])[1]
    assert got[0] == pytest.approx(sum(by_spelling) / 7) and got[3] == pytest.approx(sum(by_pair) / 7)
    assert got[1] == pytest.approx(max(0, max(sum(by_spelling[:k]) for k in range(1, 8))) / 24, abs=1e-6)
    assert got[2] == pytest.approx(sum(x > kneser_ney.STRONG for x in by_spelling) / math.sqrt(7))
    # the pairs of a known first word, and what is left for the spelling of all words, sum to one
    v = b"sun"
    seen = {k[1] for k, n in pairs.items() if k[0] == v and sum(n) >= kneser_ney.LEAST_PAIRS}
    for c in (0, 1):
        spelled = sum(math.exp(m.spelled([w])[0, c]) for w in seen)
        left = m.pairs.rest[m.pairs.number[v], c] * m.pairs.pooled_rest[m.pairs.number[v]] * (1 - spelled)
        assert sum(probability(c, v, w) for w in seen) + left == pytest.approx(1)
    plain = 1 / (1 + math.exp(-float(np.append(got, 1) @ m.logistic)))
    assert m.score([probe.encode()])[0] == pytest.approx(plain)


def test_toxic_expressions_of_ordinary_words(spark):
    """Both words of an expression are as common in ordinary texts; only their pair tells."""
    rng = random.Random(8)
    fill = [f"{a}{b}{c}" for a in "bcdfgk" for b in ("ara", "ele", "ono", "uti") for c in ("s", "n", "")]
    said = [("baras", "dono"), ("kutin", "felen"), ("cono", "gara")]
    rows = []
    for i in range(1200):
        w = [rng.choice(fill) for _ in range(60)]
        for _ in range(3):
            k, e = rng.randrange(59), rng.choice(said)
            w[k], w[k + 1] = e if i % 3 == 0 else (e[0], rng.choice(fill))
            if i % 3:
                w[rng.randrange(60)] = e[1]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    held = common.fold("doc_id", 5) == 0
    models = kneser_ney.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), ~held)
    got = kneser_ney.score(docs.select("doc_id", "text", F.col("toxic").alias("truth")), models, ["doc_id", "truth"]).where(held).collect()
    assert sum(r["predicted"] == r["truth"] for r in got) > 0.85 * len(got)


def test_toxicity_query(spark):
    labels = common.read(spark, SF.replace("0.001", "0.01"), "labels")
    out = queries.op8_toxicity(spark, SF.replace("0.001", "0.01"))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.toxic).mean() > max(0.9, (held.toxic == 0).mean())


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(3)
    fill = [f"{a}{b}" for a in "bcdfgklmn" for b in ("ara", "ele", "ono", "uti")]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(fill) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["zonk", "zonkler", "zonkish", "vrax", "vraxen"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = common.fold("doc_id", 5) == 0
    got = kneser_ney.score(docs, kneser_ney.fit(docs, lab, ~held), ["doc_id"]).where(held).join(lab, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) > 0.97 * len(got)


def plain_chain(node, edge):
    """Marginals by summing over all label sequences."""
    import itertools

    n = len(node)
    weight = {s: math.exp(sum(node[i][s[i]] for i in range(n)) + sum(edge[s[i]][s[i + 1]] for i in range(n - 1))) for s in itertools.product((0, 1), repeat=n)}
    z = sum(weight.values())
    return [sum(w for s, w in weight.items() if s[i]) / z for i in range(n)]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 4, 2, 6])
    x = rng.normal(size=(13, crf.SIZE))
    f = crf.Field(rng.normal(size=3 * crf.SIZE), rng.normal(size=(2, 2)))
    got = f.marginals(x, sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    full = crf.with_neighbours(x, starts)
    for s, n in zip(starts, sizes):
        node = [(0.0, float(full[i] @ f.weights)) for i in range(s, s + n)]
        assert got[s : s + n] == pytest.approx(plain_chain(node, f.edge))


def test_lines_of_glued_texts_get_their_own_labels(spark):
    """Labels stand on whole texts; of a good and a bad text glued together both halves get the right side."""
    sf = SF.replace("0.001", "0.01")
    both = common.read(spark, sf, "documents").join(common.read(spark, sf, "labels"), "doc_id").select("doc_id", "text", "quality").toPandas().sort_values("doc_id")
    field = crf.fit(common.read(spark, sf, "documents"), common.read(spark, sf, "labels"), common.fold("doc_id", 3) != 1)
    both = both[[t is not None and zlib.crc32(str(d).encode()) % 3 == 1 and 3 <= t.count("\n") <= 40 for d, t in zip(both.doc_id, both.text)]]
    good, bad = ([t.encode() for t in both[both.quality == q].text] for q in (1, 0))
    right, ranges = 0, []
    for i, b in enumerate(bad):
        for first, second, sides in ((good[i], b, (1, 0)), (b, good[i], (0, 1))):
            x, weight = crf.line_features(first + b"\n" + second)
            p = field.marginals(x.astype(float), np.array([len(x)]))
            cut = first.count(b"\n") + 1
            half = [np.average(p[s], weights=weight[s]) for s in (slice(0, cut), slice(cut, None))]
            right += all((h >= 0.5) == bool(s) for h, s in zip(half, sides))
            ranges.append(p.max() - p.min())
    assert len(bad) >= 8 and right >= 0.8 * 2 * len(bad) and np.median(ranges) > 0.5


def test_field_maximises_the_expected_likelihood():
    """Labels of lines that are known by themselves are found from labels of texts, switches inside a text included."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(200):
        y = int(rng.integers(2))
        lines = rng.random(8) < (0.9 if y else 0.1)
        x = np.zeros((8, crf.SIZE), np.float32)
        x[:, 0], x[:, 2], x[:, 4] = 1, rng.random(8), np.where(lines, 0.0, 1.0) + rng.normal(0, 0.1, 8)
        texts.append((x, np.ones(8), y))
    field = crf.train(texts)
    p = field.marginals(np.vstack([x for x, *_ in texts]).astype(float), np.full(200, 8)).reshape(200, 8)
    clean = np.stack([x[:, 4] < 0.5 for x, *_ in texts])
    assert ((p >= 0.5) == clean).mean() > 0.9
    share = np.where(np.array([y for *_, y in texts]) == 1, p.mean(axis=1), 1 - p.mean(axis=1))
    assert (share > 0.5).mean() > 0.97


def test_quality_of_held_out_documents(spark):
    labels = common.read(spark, SF, "labels")
    got = queries.op10_line_crf(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert got and sum(r["predicted"] == r["quality"] for r in got) > 0.9 * len(got)


def test_brown_query(spark, rows):
    count, n = collections.Counter(), 0
    for d, text in zip(rows.doc_id, rows.text):
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update([*(text or "").encode().lower().split(), b" "])
    n, v = sum(count.values()), len(count)
    got = queries.op9_brown_bigrams(spark, SF).toPandas().set_index("doc_id")
    for d, text in zip(rows.doc_id, rows.text):
        t = [*(text or "").encode().lower().split(), b" "]
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()


def test_brown_tail_is_joined(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 3)
    docs = spark.createDataFrame([(0, "a a a b b c d"), (1, "A b e"), (2, None)], "doc_id bigint, text string")
    model, counts = brown.train(docs)
    got = {r["doc_id"]: r for r in brown.score(docs, model, counts).collect()}
    assert model.n == 13 and model.v == 6 and [got[i]["n_known"] for i in range(3)] == [8, 4, 1]
    want = sum(math.log10((c + 1) / 20) for c in (4, 3, 1, 3))
    assert got[1]["base_score"] == pytest.approx(want)


def plain_score(text, train, model):
    """log10 probability of a text by class bigrams that are counted here, given the classes of words alone."""
    number, size = model.head.number, 1 + brown.SHAPES + brown.CLASSES
    kind = lambda w: int(model.of[number[w]]) if w in number else 1 + brown.shape(w)
    count, table, kinds = collections.Counter(), np.zeros((size, size)), set(range(1 + brown.SHAPES))
    for t in train:
        ws = brown.tokens(t)
        count.update(ws)
        ks = [0, *map(kind, ws), 0]
        for a, b in zip(ks, ks[1:]):
            table[a, b] += 1
    # texts of a slice share boundaries, so a boundary follows each text once
    kinds |= {kind(w) for w in count}
    arrive = table.sum(axis=0)
    unigram = [(arrive[k] + 1) / (arrive.sum() + len(kinds)) if k in kinds else 0.0 for k in range(size)]
    mass, types = collections.Counter(), collections.Counter()
    for w, c in count.items():
        mass[kind(w)] += c
        types[kind(w)] += 1
    total, before = 0.0, 0
    for w in [*brown.tokens(text), None]:
        k = 0 if w is None else kind(w)
        total += math.log10((table[before, k] + brown.BETA * unigram[k]) / (table[before].sum() + brown.BETA))
        if w is not None:
            total += math.log10((count[w] + brown.ALPHA) / (mass[k] + brown.ALPHA * (types[k] + (k <= brown.SHAPES))))
        before = k
    return total


@pytest.mark.parametrize("head", [150_000, 30])
def test_brown_score_equals_plain_class_bigrams(spark, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)
    rng = random.Random(21)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}a" for i in range(30)]
    texts = [" ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} {rng.randrange(40)}," for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts += ["a a a a b", "", None, "the the the", "x" * 100 + " the y"]
    train, probe = texts[5:], [*texts, "never seen noun3 Ünïc 77", "the " + "x" * 100]
    model, counts = brown.train(spark.createDataFrame([*enumerate(train)], "doc_id bigint, text string"))
    assert len(model.head.counts) <= head and (model.of > brown.SHAPES).all()
    got = {r["doc_id"]: r["score"] for r in brown.score(spark.createDataFrame([*enumerate(probe)], "doc_id bigint, text string"), model, counts).collect()}
    plain = [t.encode() if t else b"" for t in train]
    for i, t in enumerate(probe):
        assert got[i] == pytest.approx(plain_score((t or "").encode(), plain, model))
    # what may follow a class sums to one: known words, one unknown word of each spelling class, and the end
    rest = {bytes(r["word"]): r["c"] for r in counts.collect()}
    known = [(int(model.of[i]), c) for i, c in enumerate(model.head.counts)] + [(1 + brown.shape(w), c) for w, c in rest.items()]
    for before in {0, 1, *model.of.tolist()}:
        p = 10.0 ** model.transition[before]
        words = sum(p[k] * (c + brown.ALPHA) / model.emission[k] for k, c in known)
        unknown = sum(p[k] * brown.ALPHA / model.emission[k] for k in range(1, 1 + brown.SHAPES))
        assert p[0] + words + unknown == pytest.approx(1)


def test_a_word_moves_to_the_class_of_the_highest_likelihood():
    rng = random.Random(2)
    first = 1 + brown.SHAPES
    size = first + 4
    seq = [rng.randrange(9) for _ in range(800)]
    of = np.array([first, first + 1, first + 2, first + 3, first, first + 1, 3, 3, 0])

    def table(of):
        out = np.zeros((size, size))
        np.add.at(out, (of[seq[:-1]], of[seq[1:]]), 1)
        return out

    for w in range(8):
        after, before, same = np.zeros(size), np.zeros(size), 0
        for a, b in zip(seq, seq[1:]):
            same += a == b == w
            if a != b:
                after[of[b]] += a == w
                before[of[a]] += b == w
        value = []
        for k in range(first, size):
            other = of.copy()
            other[w] = k
            value.append(brown.likelihood(table(other)))
        now = table(of)
        best = brown.best_class(now, now.sum(axis=1), now.sum(axis=0), int(of[w]), after, before, int(same))
        assert value[best - first] == pytest.approx(max(value))


def test_head_is_taken_by_a_threshold(spark):
    rng = random.Random(5)
    c = [rng.choice((1, 1, 2, 3, 1023, 1024, 5000, rng.randrange(1, 10**9))) for _ in range(400)]
    counts = spark.createDataFrame([(f"w{i}".encode(), n) for i, n in enumerate(c)], "word binary, c bigint")
    for most in (0, 1, 5, 60, 399, 400, 1000):
        least = brown.threshold(counts, most)
        n = sum(x >= least for x in c)
        assert n <= most and (most < 60 or n > 0.5 * most or least == 1)
    assert brown.threshold(counts, 400) == 1 and brown.threshold(counts.limit(0), 5) == 1


def test_exchange_ends_where_no_move_helps():
    rng = random.Random(6)
    seq = []
    for _ in range(3000):
        seq += [rng.choice((0, 1, 2, 2, 6)), rng.choice((3, 4, 5, 7))]
        if rng.random() < 0.1:
            seq.append(rng.randrange(8))
    first = 1 + brown.SHAPES
    ids = np.array(seq) + first
    key, n = np.unique(ids[:-1] * 1000 + ids[1:], return_counts=True)
    left, right, n = key // 1000, key % 1000, n.astype(float)

    def likelihood(of):
        table = np.zeros((first + 3, first + 3))
        np.add.at(table, (of[left], of[right]), n)
        x = lambda v: (v[v > 0] * np.log(v[v > 0])).sum()
        return x(table) - x(table.sum(axis=1)) - x(table.sum(axis=0))

    of = brown.exchange(left, right, n, 8, classes=3, sweeps=50)
    best = likelihood(of)
    assert best > likelihood(np.concatenate([np.arange(first), first + np.arange(8) % 3]))
    for w in range(first, first + 8):
        for c in range(first, first + 3):
            other = of.copy()
            other[w] = c
            assert likelihood(other) <= best + 1e-6
