"""Media columns: Matroska files written to and parsed from binary columns.

``store`` puts a payload into a Matroska file as an uncompressed 8-bit audio track: EBML header, segment, info, track
table, clusters of laced simple blocks, and cues. ``parse`` reads any such file: variable-length EBML elements of known
or unknown size, clusters, simple blocks and block groups with Xiph, fixed-size or EBML lacing, and cues, and yields a
packet table (track, timestamp, duration, key frame, byte range). ``read_back`` joins the byte ranges of a track.

The frames of a lace follow each other by their duration: that of the block group divided among them, or the default of
their track; where a file says neither, they share the timestamp of their block. A block of a group is a key frame if the
group refers to no other block. Times inside a block count by the scale of its track. A checksum that does not fit is an
error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Element ids of the Matroska specification.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, TRACK_UID, CODEC_ID, AUDIO = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x73C5, 0x86, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, VOID, CRC32, TAGS, CHAPTERS, ATTACHMENTS = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xEC, 0xBF, 0x1254C367, 0x1043A770, 0x1941A469
DEFAULT_DURATION, TRACK_SCALE, BLOCK_DURATION, REFERENCE = 0x23E383, 0x23314F, 0x9B, 0xFB
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION, MUXING_APP, WRITING_APP = 0x4282, 0x4287, 0x4285, 0x4D80, 0x5741
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}

#: One frame is 576 samples of one byte; eight frames make a laced block, sixteen blocks a cluster.
FRAME, LACE, BLOCKS, RATE = 576, 8, 16, 8000


def vint(n: int, width: int = 0) -> bytes:
    """A size as an EBML variable-length integer, as short as it can be unless a width is given."""
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | (1 << (7 * width))).to_bytes(width, "big")


def number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def element(kind: int, body: bytes) -> bytes:
    return number(kind) + vint(len(body)) + body


def padded(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of a frame."""
    n = max(1, -(-len(text) // FRAME)) * FRAME
    return text + b"\xff" * (n - len(text))


def block(track: int, at: int, frames: list[bytes], lacing: str) -> bytes:
    """A simple block; lacing is none, xiph, fixed or ebml."""
    flag = {"none": 0x80, "xiph": 0x82, "fixed": 0x84, "ebml": 0x86}[lacing]
    head = vint(track) + struct.pack(">hB", at, flag)
    if lacing == "none":
        (only,) = frames
        return element(SIMPLE_BLOCK, head + only)
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            head += vint(d + (1 << (7 * w - 1)) - 1, w)
    elif len(set(sizes)) != 1:
        raise ValueError("frames of fixed lacing must be equally long")
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def store(payload: bytes, lacing: str = "fixed") -> bytes:
    """A Matroska file that holds the payload, a multiple of 576 bytes, as 8-bit PCM at 8 kHz (72 ms a frame)."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    head = element(EBML, element(DOC_TYPE, b"matroska") + element(DOC_VERSION, b"\x04") + element(DOC_READ_VERSION, b"\x02"))
    info = element(INFO, element(TIMESTAMP_SCALE, number(1_000_000)) + element(MUXING_APP, b"tributary") + element(WRITING_APP, b"tributary"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + element(CHANNELS, b"\x01") + element(BIT_DEPTH, b"\x08"))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, b"\x01") + element(TRACK_UID, b"\x01") + element(TRACK_TYPE, b"\x02") + element(CODEC_ID, b"A_PCM/INT/LIT") + element(DEFAULT_DURATION, number(FRAME * 1_000_000_000 // RATE)) + audio))
    ms = FRAME * 1000 // RATE
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    per = FRAME * LACE * BLOCKS
    for c in range(0, len(payload), per):
        start = c // FRAME * ms
        body = [element(TIMESTAMP, number(start))]
        for b in range(c, min(c + per, len(payload)), FRAME * LACE):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + FRAME * LACE, len(payload)), FRAME)]
            body.append(block(1, b // FRAME * ms - start, frames, lacing if len(frames) > 1 else "none"))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, element(CUE_TIME, number(start)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER, number(at)))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


class Malformed(ValueError):
    """The bytes are no Matroska file that this parser can follow."""


def element_head(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(id, size or -1 if unknown, place of the body) of the element at ``at``."""
    if at >= end:
        raise Malformed("element beyond its parent")
    first = data[at]
    width = 9 - first.bit_length()
    if width > 4 or at + width >= end:
        raise Malformed("bad element id")
    kind = int.from_bytes(data[at : at + width], "big")
    size, body = read_vint(data, at + width, end)
    return kind, size, body


def read_vint(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(value, -1 if all its bits are set; next place)."""
    if at >= end or not data[at]:
        raise Malformed("bad variable-length integer")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Malformed("cut variable-length integer")
    n = int.from_bytes(data[at : at + width], "big") & ((1 << (7 * width)) - 1)
    return (-1 if n == (1 << (7 * width)) - 1 else n), at + width


def children(data: bytes, at: int, end: int, stop: set[int] = frozenset()):
    """(id, body, end of body) of the elements between two places; an unknown size reaches to the next id in ``stop``."""
    while at < end:
        kind, size, body = element_head(data, at, end)
        if size < 0:
            upto = end if kind == SEGMENT else unknown_end(data, body, end)
        else:
            upto = body + size
        if upto > end:
            raise Malformed("element longer than its parent")
        yield kind, body, upto
        at = upto


def unknown_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next element of the segment's level."""
    while at < end:
        kind, size, body = element_head(data, at, end)
        if kind in TOP:
            return at
        if size < 0:
            raise Malformed("unknown size inside a cluster")
        at = body + size
    return end


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose lacing starts at ``at``; kind 1 is Xiph, 2 fixed, 3 EBML."""
    if at >= end:
        raise Malformed("lacing without a count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            s = 0
            while True:
                if at >= end:
                    raise Malformed("cut lacing")
                b, at = data[at], at + 1
                s += b
                if b != 255:
                    break
            sizes.append(s)
    elif kind == 3 and n > 1:
        s, at = read_vint(data, at, end)
        sizes.append(s)
        for _ in range(n - 2):
            before = at
            d, at = read_vint(data, at, end)
            if d < 0:
                d = (1 << (7 * (at - before))) - 1
            s += d - ((1 << (7 * (at - before) - 1)) - 1)
            sizes.append(s)
    elif kind == 2:
        if (end - at) % n:
            raise Malformed("fixed lacing does not divide the block")
        sizes = [(end - at) // n] * (n - 1)
    if min(sizes, default=0) < 0 or at + sum(sizes) > end:
        raise Malformed("frames beyond the block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    out.append((at, end - at))
    return out


def real(data: bytes, a: int, b: int) -> float:
    """A floating-point element of four or eight bytes; one without bytes is 0."""
    if b - a not in (0, 4, 8):
        raise Malformed("bad floating-point element")
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def checked(data: bytes, a: int, b: int) -> list[tuple[int, int, int]]:
    """The children of an element, whose checksum, if there is one, must fit all that follows it."""
    found = list(children(data, a, b))
    if found and found[0][0] == CRC32 and int.from_bytes(data[found[0][1] : found[0][2]], "little") != zlib.crc32(data[found[0][2] : b]):
        raise Malformed("checksum does not fit")
    return found


def track_entry(data: bytes, a: int, b: int) -> dict:
    e = {k: (x, y) for k, x, y in children(data, a, b)}
    sound = {k: (x, y) for k, x, y in children(data, *e[AUDIO])} if AUDIO in e else {}
    get = lambda m, k, d=0: unsigned(data, *m[k]) if k in m else d
    codec = data[slice(*e[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in e else ""
    scale = real(data, *e[TRACK_SCALE]) if TRACK_SCALE in e else 1.0
    return {"track": get(e, TRACK_NUMBER), "type": get(e, TRACK_TYPE), "codec": codec, "channels": get(sound, CHANNELS, 1), "bit_depth": get(sound, BIT_DEPTH), "default_ns": get(e, DEFAULT_DURATION), "scale": scale}


def block_packets(data: bytes, a: int, b: int, when: int, scale: int, tracks: dict[int, dict], cluster: int, group: list[tuple[int, int, int]] | None) -> list[tuple]:
    """Packets of one block; ``group`` holds the elements of its block group, None for a simple block."""
    track, at = read_vint(data, a, b)
    if at + 3 > b:
        raise Malformed("cut block")
    rel, flags = struct.unpack_from(">hB", data, at)
    lace = flags >> 1 & 3
    spans = laced(data, at + 3, b, lace) if lace else [(at + 3, b - at - 3)]
    entry = tracks.get(track, {"default_ns": 0, "scale": 1.0})
    whole = next((unsigned(data, x, y) for k, x, y in group or () if k == BLOCK_DURATION), None)
    step = entry["default_ns"] if whole is None else whole * scale // len(spans)
    key = bool(flags & 0x80) if group is None else all(k != REFERENCE for k, _, _ in group)
    start = round((when + rel * entry["scale"]) * scale)
    return [(track, start + i * step, key, p, n, cluster, i, step) for i, (p, n) in enumerate(spans)]


def parse(data: bytes) -> dict:
    """Tracks, packets (track, timestamp, keyframe, byte range, cluster, lace, duration) and cues (track, timestamp, place
    of the cluster) of a file; a cue point of several tracks is a cue of each."""
    tracks: dict[int, dict] = {}
    packets: list[tuple] = []
    cues: list[tuple] = []
    scale, clusters = 1_000_000, 0
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Malformed("no EBML header")
    for kind, a, b in top:
        if kind != SEGMENT:
            continue
        base = a
        for kind, a, b in children(data, a, b):
            if kind == INFO:
                scale = next((unsigned(data, x, y) for k, x, y in checked(data, a, b) if k == TIMESTAMP_SCALE), scale)
            elif kind == TRACKS:
                entries = [track_entry(data, x, y) for k, x, y in checked(data, a, b) if k == TRACK_ENTRY]
                tracks |= {e["track"]: e for e in entries}
            elif kind == CLUSTER:
                when = 0
                for k, x, y in checked(data, a, b):
                    if k == TIMESTAMP:
                        when = unsigned(data, x, y)
                    elif k == SIMPLE_BLOCK:
                        packets += block_packets(data, x, y, when, scale, tracks, clusters, None)
                    elif k == BLOCK_GROUP:
                        group = list(children(data, x, y))
                        for _, x2, y2 in [z for z in group if z[0] == BLOCK]:
                            packets += block_packets(data, x2, y2, when, scale, tracks, clusters, group)
                clusters += 1
            elif kind == CUES:
                for k, x, y in checked(data, a, b):
                    if k == CUE_POINT:
                        point = list(children(data, x, y))
                        time = next((unsigned(data, x2, y2) for k2, x2, y2 in point if k2 == CUE_TIME), None)
                        for _, x2, y2 in [z for z in point if z[0] == CUE_POSITIONS and time is not None]:
                            where = {k3: unsigned(data, x3, y3) for k3, x3, y3 in children(data, x2, y2) if k3 in (CUE_TRACK, CUE_CLUSTER)}
                            if CUE_CLUSTER in where:
                                cues.append((where.get(CUE_TRACK, 0), time * scale, base + where[CUE_CLUSTER]))
    return {"tracks": [*tracks.values()], "packets": packets, "cues": cues, "scale": scale}


def read_back(data: bytes, found: dict, track: int = 1) -> bytes:
    return b"".join([data[p[3] : p[3] + p[4]] for p in found["packets"] if p[0] == track])


PACKET_DDL = "packets array<struct<track:int,timestamp_ns:bigint,keyframe:boolean,byte_offset:bigint,byte_length:bigint,cluster:int,lace:int,duration_ns:bigint,cued:boolean>>, parse_error string"
PACKET_FIELDS = ["track", "timestamp_ns", "keyframe", "byte_offset", "byte_length", "cluster", "lace", "duration_ns", "cued"]


def packet_rows(data: bytes) -> list[dict]:
    """The packet table of one file; ``cued`` marks packets that a cue of their track points to by its time."""
    found = parse(data)
    cued = {(t, when) for t, when, _ in found["cues"]}
    return [dict(zip(PACKET_FIELDS, (*p, p[:2] in cued))) for p in found["packets"]]


def packet_table(media: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each packet of the Matroska files in a binary column, with the columns ``keep``.

    Null, empty and malformed files have no packets; ``parse_error`` says why on the one row that they get. Repeated rows
    give their packets again, and an empty table gives none; a file is parsed whole, however long. A kept column named
    like a packet field, in whatever case, gives way to it.
    """
    import pyarrow as pa

    common.bound_batches(media.sparkSession)
    struct_type = T.StructType.fromDDL(PACKET_DDL)
    kind = common.arrow_type(struct_type)

    def run(col: pa.Array) -> pa.Array:
        out = []
        for data in col.to_pylist():
            try:
                out.append({"packets": packet_rows(data or b""), "parse_error": None})
            except (Malformed, struct.error) as e:
                out.append({"packets": [], "parse_error": str(e)})
        return pa.array(out, kind)

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    kept = [F.col(f"`{c}`") for c in common.without(keep, ["parse_error", *PACKET_FIELDS])]
    made, each = (common.free(n, keep) for n in ("__made", "__packet"))
    parsed = media.select(*kept, F.arrow_udf(run, returnType=struct_type)(F.col(column)).alias(made))
    return parsed.select(*kept, F.col(f"{made}.parse_error"), F.explode_outer(f"{made}.packets").alias(each)).select(*kept, "parse_error", f"{each}.*")


def feature(payload: bytes, found: dict) -> str:
    """Packets, clusters named by cues, duration in ms, mean sample, root mean square around 128, and zero crossings."""
    x = np.frombuffer(payload, np.uint8)
    c = x.astype(np.int32) - 128
    total, square = int(x.sum(dtype=np.int64)), int((c * c).sum(dtype=np.int64))
    crossings = int(((c[1:] >= 0) != (c[:-1] >= 0)).sum())
    last = max((p[1] + p[7] for p in found["packets"]), default=0) // 1_000_000
    return f"packets={len(found['packets'])};cues={len(found['cues'])};ms={last};mean={total / len(x):.4f};rms={(square / len(x)) ** 0.5:.4f};crossings={crossings}"


def media_kernel(texts: list) -> dict:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"]
    out: dict = {n: [] for n in names}
    for t in texts:
        t = t or b""
        data = store(padded(t))
        found = parse(data)
        payload = read_back(data, found)
        row = (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, found), len(found["packets"]))
        for n, v in zip(names, row):
            out[n].append(v)
    return out


MEDIA_DDL = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint"


def store_kernel(texts: list) -> dict:
    return {"media": [store(padded(t or b"")) for t in texts]}


def as_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with a binary column of Matroska files; a null text is stored as an empty one.

    Each row is stored by itself, so repeated rows and texts of any length stay whole, and an empty table gives an empty
    one; a column named ``out`` is replaced.
    """
    common.bound_batches(docs.sparkSession)
    made = common.text_kernel(store_kernel, "media binary")(F.col(text))
    return docs.select(*[F.col(f"`{c}`") for c in common.without(docs.columns, [out])], made.getField("media").alias(out))


def digests(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the digests of payload and file of each whole text, read back through the parser.

    A null or empty text is one frame of bytes 255. One row out for each row in, repeated rows and null ids included, and
    none for an empty table; no shuffle. A text of any length is one file. Ties cannot occur; of ``keep``, columns named
    like a digest are replaced.
    """
    common.bound_batches(docs.sparkSession)
    made = common.text_kernel(media_kernel, MEDIA_DDL)(F.col(text))
    return common.with_struct(docs, made, [f.name for f in T.StructType.fromDDL(MEDIA_DDL).fields], keep)
