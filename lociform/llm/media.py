"""ISO media containers: write, walk and describe them without decoding payloads.

``walk`` follows nested boxes, ``tracks`` decodes the sample tables of each track, and the
runs of its movie fragments, into codec, time scale, duration, sample ranges and key-frame
byte ranges.
Malformed input never raises: the part that could be read is returned with an
``error``. Null content is an empty file: no track, error ``empty``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import map_batches, table, utf8

CONTAINERS = frozenset(b"moov trak mdia minf stbl edts dinf mvex udta moof traf".split())
UNIT = 192
RATE = 8000
SAMPLES_A_CHUNK = 16


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ")
HANDLER = _full(b"hdlr", b"\0\0\0\0soun", b"\0" * 12, b"bytes\0")
SOUND = _full(b"smhd", b"\0" * 4) + _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
ENTRY = _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))


def encode(payload: bytes, unit: int = UNIT, per_chunk: int = SAMPLES_A_CHUNK) -> bytes:
    """A file with one track of unsigned 8-bit samples; ``payload`` is a multiple of ``unit``.

    A sample of the tables is ``unit`` bytes; the first of each chunk is a sync sample.
    """
    n = len(payload) // unit
    chunks = -(-n // per_chunk)
    rest = n - (chunks - 1) * per_chunk
    runs = [(1, per_chunk, 1)] if rest == per_chunk else [(1, rest, 1)] if chunks == 1 else [(1, per_chunk, 1), (chunks, rest, 1)]
    offsets = np.arange(chunks, dtype=np.int64) * (per_chunk * unit)
    wide = len(payload) > 0xF0000000

    def moov(start: int) -> bytes:
        at = (offsets + start).astype(">u8" if wide else ">u4").tobytes()
        stbl = _box(
            b"stbl",
            ENTRY,
            _full(b"stts", struct.pack(">III", 1, n, unit)),
            _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * per_chunk + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", unit, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at),
        )
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n * unit, 0x55C4, 0), version=1), HANDLER, _box(b"minf", SOUND, stbl))
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * unit), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, b"\0" * 8, version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, n * unit, 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24, struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(FTYP) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return FTYP + moov(head) + _box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> list[tuple[tuple, int, int]]:
    """(path, body start, body end) of every box, outer before inner.

    Sizes of 1 (64 bits follow) and 0 (to the end) are read; a size that leaves the
    enclosing box ends that level.
    """
    end = len(data) if end is None else end
    found: list[tuple[tuple, int, int]] = []
    stack = [(start, end, path)]
    while stack:
        at, stop, above = stack.pop()
        while at + 8 <= stop:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1 and at + 16 <= stop:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = stop - at
            if size < head or at + size > stop:
                break
            found.append(((*above, kind), at + head, at + size))
            if kind in CONTAINERS:
                stack.append((at + size, stop, above))
                stack.append((at + head, at + size, (*above, kind)))
                break
            at += size
    return found


def _ints(data: bytes, at: int, end: int, count: int, width: int, dtype: str = ">u4") -> np.ndarray:
    size = np.dtype(dtype).itemsize
    fit = max(0, min(count * width, (end - at) // size))
    return np.frombuffer(data, dtype, fit, at).astype(np.int64)


def tracks(data: bytes | None) -> tuple[list[dict], str | None]:
    """Each track's codec, kind, time scale, duration, sample ranges and key frames."""
    if not data:
        return [], "empty"
    found: list[dict] = []
    now: dict[bytes, tuple[int, int]] = {}
    groups: list[dict[bytes, tuple[int, int]]] = []
    boxes = walk(data)
    bad = (struct.error, KeyError, IndexError, ValueError, OverflowError)
    for path, at, end in boxes:
        if path[-1] == b"trak":
            now = {}
            groups.append(now)
        elif b"trak" in path:
            now[path[-1]] = (at, end)
    for boxes_of in groups:
        try:
            found.append(_track(data, boxes_of))
        except bad:
            return found, "bad sample table"
    try:
        _add_fragments(data, boxes, found)
    except bad:
        return found, "bad fragment"
    return found, None if boxes and groups else "no track"


def _add_fragments(data: bytes, boxes: list[tuple[tuple, int, int]], found: list[dict]) -> None:
    """Appends the samples of all ``trun`` boxes to their tracks.

    A sample is a key frame unless its flags say that it depends on others or is no sync sample.
    """
    of = {t["id"]: t for t in found}
    usual: dict[int, tuple[int, int, int]] = {}
    more: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}
    moof, track, base, size, ticks, flags, place = 0, 0, 0, 0, 0, 0, None
    for path, at, end in boxes:
        kind = path[-1]
        if kind == b"trex":
            i, _, *rest = struct.unpack_from(">IIIII", data, at + 4)
            usual[i] = tuple(rest)
        elif kind == b"moof":
            # the box's head lies before its body: 16 bytes if its size is a 64-bit number
            moof, place = at - (16 if struct.unpack_from(">I", data, at - 16)[0] == 1 and data[at - 12 : at - 8] == b"moof" else 8), None
        elif kind == b"tfhd":
            has, track = struct.unpack_from(">II", data, at)
            has, at = has & 0xFFFFFF, at + 8
            ticks, size, flags = usual.get(track, (0, 0, 0))
            base = moof if has & 0x20000 or place is None else place
            if has & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 if has & 2 else 0
            for bit in (8, 16, 32):
                if has & bit:
                    value, at = struct.unpack_from(">I", data, at)[0], at + 4
                    ticks, size, flags = (value if bit == 8 else ticks), (value if bit == 16 else size), (value if bit == 32 else flags)
            place = base
        elif kind == b"trun":
            has, n = struct.unpack_from(">II", data, at)
            has, at = has & 0xFFFFFF, at + 8
            if has & 1:
                place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            first, at = (struct.unpack_from(">I", data, at)[0], at + 4) if has & 4 else (None, at)
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if has & bit]
            n = min(n, (end - at) // (4 * len(fields)) if fields else len(data))
            cells = np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, len(fields))
            column = lambda bit, usual_: cells[:, fields.index(bit)] if bit in fields else np.full(n, usual_, np.int64)  # noqa: E731, B023
            sizes, marks = column(0x200, size), column(0x400, flags).copy()
            if first is not None and n:
                marks[0] = first
            starts = place + np.cumsum(sizes) - sizes
            more.setdefault(track, []).append((starts, sizes, (marks & 0x10000 == 0) & (marks >> 24 & 3 != 1), int(column(0x100, ticks).sum())))
            place += int(sizes.sum())
    for i, parts in more.items():
        t = of[i]
        before = len(t["sizes"])
        t["starts"] = np.concatenate([t["starts"], *(x[0] for x in parts)])
        t["sizes"] = np.concatenate([t["sizes"], *(x[1] for x in parts)])
        t["keys"] = np.concatenate([t["keys"], before + np.flatnonzero(np.concatenate([x[2] for x in parts]))])
        t["ticks"] += sum(x[3] for x in parts)


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    def counted(kind: bytes, width: int, dtype: str = ">u4") -> np.ndarray:
        if kind not in boxes:
            return np.zeros(0, np.int64)
        at, end = boxes[kind]
        return _ints(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], width, dtype)

    at = boxes[b"tkhd"][0] if b"tkhd" in boxes else None
    number = 0 if at is None else struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    at, _ = boxes[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    handler = data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12].decode("latin-1") if b"hdlr" in boxes else ""
    at, _ = boxes[b"stsd"]
    codec = data[at + 12 : at + 16].decode("latin-1")
    if b"stsz" in boxes:
        at, end = boxes[b"stsz"]
        size, n = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(min(n, len(data)), size, np.int64) if size else _ints(data, at + 12, end, n, 1)
    else:
        at, end = boxes[b"stz2"]
        field, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if field == 4:
            raw = np.frombuffer(data, np.uint8, min((n + 1) // 2, end - at - 12), at + 12)
            sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
        else:
            sizes = _ints(data, at + 12, end, n, 1, ">u1" if field == 8 else ">u2")
    chunks = counted(b"co64", 1, ">u8") if b"co64" in boxes else counted(b"stco", 1)
    runs = counted(b"stsc", 3).reshape(-1, 3)
    firsts = np.append(runs[:, 0] - 1, len(chunks))
    per = np.repeat(runs[:, 1], np.clip(np.diff(firsts), 0, len(chunks)))[: len(chunks)]
    # no chunk holds more than the samples that are left, whatever it says
    upto = np.minimum(np.cumsum(np.minimum(per, len(sizes))), len(sizes))
    of = np.repeat(np.arange(len(per)), np.diff(upto, prepend=0))
    sizes = sizes[: len(of)]
    before = np.cumsum(sizes) - sizes
    starts = chunks[of] + before - before[np.searchsorted(of, of)] if len(of) else np.zeros(0, np.int64)
    times = counted(b"stts", 2).reshape(-1, 2)
    keys = counted(b"stss", 1) - 1 if b"stss" in boxes else np.arange(len(sizes))
    keys = keys[(keys >= 0) & (keys < len(sizes))]
    return {"id": int(number), "codec": codec, "handler": handler, "scale": int(scale), "duration": int(duration), "ticks": int((times[:, 0] * times[:, 1]).sum()), "starts": starts, "sizes": sizes, "keys": keys}


def payload_of(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples in order, runs of adjacent samples read at once."""
    s, z = track["starts"], track["sizes"]
    if not len(s):
        return b""
    cut = np.flatnonzero(s[1:] != s[:-1] + z[:-1]) + 1
    lo = s[np.concatenate([[0], cut])]
    last = np.concatenate([cut, [len(s)]]) - 1
    return b"".join(data[a:b] for a, b in zip(lo.tolist(), (s[last] + z[last]).tolist(), strict=True))


def describe(track: dict) -> str:
    """codec, time scale, duration, samples, key frames and a digest of the key frames' byte ranges."""
    keys = track["keys"]
    ranges = np.stack([track["starts"][keys], track["sizes"][keys]], 1).astype(">i8").tobytes()
    seconds = track["duration"] / track["scale"] if track["scale"] else 0.0
    return f"codec={track['codec'].strip()};kind={track['handler']};scale={track['scale']};duration={track['duration']};seconds={seconds:.6f};samples={len(track['sizes'])};keyframes={len(keys)};ranges={zlib.crc32(ranges):08x}"


def inspect(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One row per track of each file in a binary column: what the sample tables say.

    A file without a readable track gives one row with nulls and ``error``. Null ids
    and repeated rows are kept; other columns are not read.
    """

    def rows(b: dict[str, list]) -> dict[str, list]:
        names = "id track codec handler timescale duration n_samples key_offsets key_lengths error".split()
        out: dict[str, list] = {n: [] for n in names}
        for i, data in zip(b["id"], b["content"], strict=True):
            found, error = tracks(bytes(data) if data is not None else None)
            for k, t in enumerate(found):
                keys = t["keys"]
                for n, v in zip(names, (i, k, t["codec"], t["handler"], t["scale"], t["duration"], len(t["sizes"]), t["starts"][keys].tolist(), t["sizes"][keys].tolist(), error), strict=True):
                    out[n].append(v)
            if not found:
                for n in names:
                    out[n].append(i if n == "id" else error if n == "error" else None)
        return out

    return map_batches(df.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).cast("binary").alias("content")), rows, "id string, track int, codec string, handler string, timescale long, duration long, n_samples long, key_offsets array<long>, key_lengths array<long>, error string")


def padded(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with spaces up to a positive multiple of ``unit``, and their number before."""
    raw = utf8(text)
    return raw + b" " * ((-len(raw)) % unit if raw else unit), len(raw)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text as a media file. Null text: a file of one unit of spaces."""

    def rows(b: dict[str, list]) -> dict[str, list]:
        return {"id": b["id"], "media": [encode(padded(t)[0]) for t in b["text"]]}

    return map_batches(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), rows, "id string, media binary")


def op4_media(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a media file, read back and described; a null text counts as empty.

    Repeated rows give repeated rows; a null doc_id stays null; an empty table gives no rows.
    """

    def rows(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()}
        for text in b["text"]:
            raw, n = padded(text)
            media = encode(raw)
            found, error = tracks(media)
            back = payload_of(media, found[0])
            for k, v in (("n_bytes", n), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-16:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", error or describe(found[0]))):
                out[k].append(v)
        return out | {"doc_id": b["doc_id"]}

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_batches(docs, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
