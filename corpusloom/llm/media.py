"""Media columns from ISO media containers.

read_tracks() walks the nested boxes of a file, decodes the sample tables and movie fragments of its tracks and gives
codec, duration and the byte ranges of the key frames, without decoding any payload. write_container() stores bytes losslessly
as 8-bit PCM samples of one track, in the same kind of file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import beside_ids

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"mvex", b"moof", b"traf"}
#: Boxes within boxes that are entered; the format's own need no more than six.
DEEPEST = 32
BLOCK, RATE, KEY_EVERY = 64, 8000, 64


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of BLOCK."""
    return raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def write_container(payload: bytes) -> bytes:
    """A file with one sound track whose samples, BLOCK bytes each, hold payload (a positive multiple of BLOCK bytes)."""
    n, matrix = len(payload) // BLOCK, struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = n * BLOCK
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def moov(at: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, BLOCK)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", BLOCK, n)),
            _full(b"co64", struct.pack(">IQ", 1, at)),
        )
        info = _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1), _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"samples\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), matrix, b"\0" * 8, version=1, flags=7), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, length, 0x10000, 0x100), matrix, b"\0" * 24, struct.pack(">I", 2), version=1), track)

    head = 8 if length + 8 < 1 << 32 else 16
    at = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(at) + _box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of the body of each box, in file order.

    A box that runs over its parent's end ends the walk of that parent; boxes nested deeper than DEEPEST aren't entered.
    """
    inside = [((), 0, len(data))]
    while inside:
        path, start, end = inside.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue
        inside.append((path, start + size, end))
        yield (*path, kind), start + head, start + size
        if kind in NESTED and len(path) < DEEPEST:
            inside.append(((*path, kind), start + head, start + size))


def _table(data: bytes, at: int, end: int, width: int, skip: int = 4) -> np.ndarray:
    """Entries of a full box's table of width big-endian words each, as far as the box goes."""
    n = struct.unpack_from(">I", data, at + skip)[0]
    n = min(n, (end - at - skip - 4) // (4 * width))
    return np.frombuffer(data, ">u4", n * width, at + skip + 4).astype(np.int64).reshape(n, width)


def _sample_sizes(data: bytes, box: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Sizes by stsz or stz2. A size that all samples share is taken for as many as the file has bytes for."""
    if b"stsz" in box:
        a, b = box[b"stsz"]
        one, n = struct.unpack_from(">II", data, a + 4)
        return np.full(min(n, len(data) // one), one, np.int64) if one else _table(data, a, b, 1, 8).ravel()
    a, b = box[b"stz2"]
    bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    raw = np.frombuffer(data, np.uint8, b - a - 12, a + 12)
    if bits == 4:
        raw = np.stack([raw >> 4, raw & 15], 1).ravel()
    elif bits == 16:
        raw = raw[: len(raw) // 2 * 2].view(">u2")
    elif bits != 8:
        raise ValueError("field size of stz2")
    return raw[:n].astype(np.int64)


def _sample_table(data: bytes, box: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, sizes, numbers of sync samples from 0) by a track's sample table; empty without one."""
    none = np.empty(0, np.int64)
    if b"stsc" not in box or not {b"stsz", b"stz2"} & box.keys() or not {b"stco", b"co64"} & box.keys():
        return none, none, none
    sizes = _sample_sizes(data, box)
    if b"co64" in box:
        pairs = _table(data, *box[b"co64"], 2)
        chunks = pairs[:, 0] << 32 | pairs[:, 1]
    else:
        chunks = _table(data, *box[b"stco"], 1).ravel()
    runs = _table(data, *box[b"stsc"], 3)
    if not len(runs) or not len(chunks) or not len(sizes):
        return none, none, none
    run = np.searchsorted(runs[:, 0] - 1, np.arange(len(chunks)), "right") - 1
    per_chunk = np.where(run < 0, 0, np.minimum(runs[run, 1], len(sizes)))
    ends = np.cumsum(per_chunk)
    sizes = sizes[: ends[-1]]
    of = np.searchsorted(ends, np.arange(len(sizes)), "right")
    before = np.cumsum(sizes) - sizes
    offsets = chunks[of] + before - before[(ends - per_chunk)[of]]
    sync = _table(data, *box[b"stss"], 1).ravel() - 1 if b"stss" in box else np.arange(len(sizes))
    return offsets, sizes, sync[(sync >= 0) & (sync < len(sizes))]


def _fragment(data: bytes, box: list[tuple[bytes, int, int]], moof: int, after: int, usual: dict[int, tuple[int, ...]]) -> tuple[int, list[tuple[np.ndarray, ...]], int, int]:
    """(track, its runs as (offsets, sizes, sync), their duration, end of the data) of one traf with boxes (kind, start, end)."""
    at, end = next((a, b) for k, a, b in box if k == b"tfhd")
    flags, track = struct.unpack_from(">II", data, at)
    flags, at = flags & 0xFFFFFF, at + 8
    duration, size, kind = usual.get(track, (0, 0, 0))
    base = moof if flags & 0x20000 or after < 0 else after
    if flags & 1:
        base, at = struct.unpack_from(">Q", data, at)[0], at + 8
    at += 4 if flags & 2 else 0
    values = []
    for bit, now in ((8, duration), (16, size), (32, kind)):
        if flags & bit and at + 4 <= end:
            now, at = struct.unpack_from(">I", data, at)[0], at + 4
        values.append(now)
    duration, size, kind = values
    runs, took, place = [], 0, base
    for name, a, b in box:
        if name != b"trun":
            continue
        flags, n = struct.unpack_from(">II", data, a)
        a += 8
        if flags & 1:
            place, a = base + struct.unpack_from(">i", data, a)[0], a + 4
        first = None
        if flags & 4:
            first, a = struct.unpack_from(">I", data, a)[0], a + 4
        fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
        n = min(n, (b - a) // (4 * len(fields)) if fields else len(data) // max(size, 1))
        table = np.frombuffer(data, ">u4", n * len(fields), a).astype(np.int64).reshape(n, len(fields))
        column = {f: table[:, i] for i, f in enumerate(fields)}
        sizes = column.get(0x200, np.full(n, size, np.int64))
        kinds = column.get(0x400, np.full(n, kind, np.int64)).copy()
        if first is not None and n:
            kinds[0] = first
        took += int(column[0x100].sum()) if 0x100 in column else n * duration
        runs.append((place + np.cumsum(sizes) - sizes, sizes, kinds & 0x10000 == 0))
        place += int(sizes.sum())
    return track, runs, took, place


def read_tracks(data: bytes | None) -> list[dict]:
    """The tracks of a file in its order: track_id, handler, codec, timescale, duration (in timescale units), offsets and
    sizes of samples, and sync (sample numbers from 0) of those that are key frames.

    Samples come from the sample table and from movie fragments. The duration is the media header's, and that of the
    fragments where the header has none; edit lists aren't applied. A track whose tables are broken is left out; tables that are
    cut short are read as far as they go. Anything but an ISO file, a null too, has no tracks.
    """
    data = data or b""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    parts: list[tuple[int, list[tuple[bytes, int, int]]]] = []  # of each traf: where its moof begins, and its boxes
    usual: dict[int, tuple[int, ...]] = {}
    moof = 0
    for path, a, b in walk(data):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and tracks:
            tracks[-1].setdefault(path[-1], (a, b))
        elif path == (b"moov", b"mvex", b"trex") and b - a >= 24:
            track, _, *rest = struct.unpack_from(">5I", data, a + 4)
            usual[track] = tuple(rest)
        elif path == (b"moof",):
            moof = a - 8
        elif path == (b"moof", b"traf"):
            parts.append((moof, []))
        elif path[:2] == (b"moof", b"traf") and len(path) == 3 and parts:
            parts[-1][1].append((path[-1], a, b))
    found: dict[int, dict] = {}
    out = []
    for box in tracks:
        try:
            a, _ = box[b"mdhd"]
            scale, length = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
            number = 0
            if b"tkhd" in box:
                number = struct.unpack_from(">I", data, box[b"tkhd"][0] + (20 if data[box[b"tkhd"][0]] else 12))[0]
            handler = data[box[b"hdlr"][0] + 8 : box[b"hdlr"][0] + 12].decode("latin-1") if b"hdlr" in box else ""
            codec = data[box[b"stsd"][0] + 12 : box[b"stsd"][0] + 16].decode("latin-1")
            offsets, sizes, sync = _sample_table(data, box)
        except (struct.error, ValueError, IndexError, KeyError):
            continue
        out.append({"track_id": number, "handler": handler, "codec": codec, "timescale": scale, "duration": length, "offsets": offsets, "sizes": sizes, "sync": sync, "runs": [], "took": 0})
        found.setdefault(number, out[-1])
    after, last = -1, None
    for moof, box in parts:
        after = after if moof == last else -1
        last = moof
        try:
            number, runs, took, after = _fragment(data, box, moof, after, usual)
        except (struct.error, ValueError, StopIteration):
            continue
        if number in found:
            found[number]["runs"] += runs
            found[number]["took"] += took
    for t in out:
        runs, took = t.pop("runs"), t.pop("took")
        if runs:
            n = np.cumsum([len(t["sizes"]), *(len(r[1]) for r in runs)])
            t["sync"] = np.concatenate([t["sync"], *(np.flatnonzero(r[2]) + k for r, k in zip(runs, n, strict=False))])
            t["offsets"], t["sizes"] = (np.concatenate([t[x], *(r[i] for r in runs)]) for i, x in enumerate(("offsets", "sizes")))
            t["duration"] = t["duration"] or took
    return out


def read_container(data: bytes | None) -> dict | None:
    """The first video track of a file, else its first track; None if it has none."""
    tracks = read_tracks(data)
    return next((t for t in tracks if t["handler"] == "vide"), tracks[0] if tracks else None)


def key_ranges(track: dict) -> list[dict]:
    """Byte ranges (offset, length) of a track's key frames; neighbours stay apart."""
    return [{"offset": int(o), "length": int(s)} for o, s in zip(track["offsets"][track["sync"]], track["sizes"][track["sync"]], strict=True)]


def samples(data: bytes, track: dict) -> bytes:
    """The bytes of all samples of a track; samples that follow each other in the file are copied in runs."""
    o, s = track["offsets"], track["sizes"]
    if not len(o):
        return b""
    cut = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(o)) - 1
    return b"".join(data[o[a] : o[b] + s[b]] for a, b in zip(starts, ends, strict=True))


def _seconds(track: dict) -> float | None:
    return track["duration"] / track["timescale"] if track["timescale"] else None


def media_columns(files: DataFrame, column: str = "media") -> DataFrame:
    """files with the column replaced by codec, duration_s, keyframes (array of offset, length) and tracks.

    tracks has track_id, handler, codec, duration_s and keyframes of each track, in file order; the other columns are those
    of the first video track, else of the first track. Nulls, empty and broken files, and files without a track, give
    nulls and no tracks. Payloads aren't decoded, and a file of any length is walked by its headers alone. Columns of files that are
    named like a new one are dropped. Rows stand for themselves, repeated ones too; an empty table gives no rows.
    """
    new = ["codec", "duration_s", "keyframes", "tracks"]
    rest = [c for c in files.columns if c != column and c not in new]
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    each = pa.list_(pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("keyframes", ranges)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_, first = [], []
            for x in b.column(column).to_pylist():
                tracks = [{"track_id": t["track_id"], "handler": t["handler"], "codec": t["codec"], "duration_s": _seconds(t), "keyframes": key_ranges(t)} for t in read_tracks(x)]
                all_.append(tracks)
                first.append(next((t for t in tracks if t["handler"] == "vide"), tracks[0] if tracks else {}))
            got = {c: pa.array([t.get(c) for t in first], kind) for c, kind in zip(new, (pa.string(), pa.float64(), ranges), strict=False)}
            yield beside_ids(b, got | {"tracks": pa.array(all_, each)}, carried=tuple(rest))

    keys = "array<struct<offset: long, length: long>>"
    schema = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in rest)
    schema += f"codec string, duration_s double, keyframes {keys}, tracks array<struct<track_id: long, handler: string, codec: string, duration_s: double, keyframes: {keys}>>"
    return files.select(*rest, column).mapInArrow(run, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each text (null: empty), padded and stored in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            yield beside_ids(b, {"n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array([write_container(padded(r)) for r in raw], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_digests(stored: DataFrame) -> DataFrame:
    """What is read back from (doc_id, n_bytes, media): digests of payload and file, codec, duration, key frames, feature.

    A broken or null file gives nulls for all but doc_id and n_bytes. feature sums up the track in a line.
    """
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    kinds = {
        "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
        "feature": pa.string(), "codec": pa.string(), "duration_s": pa.float64(), "keyframes": ranges,
    }

    def digests(data: bytes | None) -> tuple:
        t = read_container(data)
        if t is None:
            return (None,) * len(kinds)
        back, keys = samples(data, t), key_ranges(t)
        last = keys[-1] if keys else {"offset": 0, "length": 0}
        feature = f"codec={t['codec'].strip()};scale={t['timescale']};duration={t['duration']};samples={len(t['sizes'])};keyframes={len(keys)};last_key={last['offset']}+{last['length']}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, t["codec"], _seconds(t), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digests(data) for data in b.column("media").to_pylist()]
            columns = {c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())}
            yield beside_ids(b, columns, carried=("doc_id", "n_bytes"))

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset: long, length: long>>"
    return stored.mapInArrow(run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {schema}")
