"""AVI motion-JPEG: lossless storage of payloads as video, intra frame decoding, shots.

A payload is stored as grey frames of 24 x 24 samples (576 bytes), each a lossless JPEG (process 14,
SOF3, predictor 1), in an AVI file with an `idx1` index. The Huffman table gives a difference category
of s extra bits a code of 9 - s bits, so every sample takes exactly nine bits and both directions are
array operations; frames of other encoders, with any Huffman table, size or predictor, go through
the scalar decoder. Reading walks the RIFF chunks, follows the index, decodes each intra frame, and
cuts shots where the histogram difference of neighbouring frames exceeds an adaptive threshold: the
mean of the shot's last small differences and a multiple of their deviation, or `least` where that is
more or the shot has none yet.

Null text is empty, and an empty text is one frame of bytes 255. Repeated rows give equal values. Long
texts are long videos, encoded in blocks of frames. An empty table gives an empty one. Bytes that
aren't such a file give no clips and an error message instead of failing the job. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C

SIDE, FRAME, FPS = 24, 576, 10
#: Fixed values of the formats: AVI index flags, JPEG markers.
HAS_INDEX, KEY_FRAME = 0x10, 0x10
SOI, SOF3, DHT, SOS, EOI, DRI = 0xD8, 0xC3, 0xC4, 0xDA, 0xD9, 0xDD

INDEX = np.dtype([("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


#: One code of each length 1 to 9, for categories 8 down to 0.
HEAD = bytes([0xFF, SOI]) + _segment(SOF3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(DHT, bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)])) + _segment(SOS, bytes([1, 1, 0, 1, 0, 0]))
TAIL = bytes([0xFF, EOI])


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """The nine bits of each difference (+255), and back."""
    to = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = ((1 << (8 - s)) - 1) << 1  # 8 - s ones and a zero
        to[d + 255] = (code << s) | (d if d >= 0 else d + (1 << s) - 1)
    back = np.zeros(512, np.int16)
    back[to] = np.arange(-255, 256)
    return to, back


_TO_BITS, _FROM_BITS = _code_tables()


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG scans of (n, 24, 24) samples, stuffed: all bytes and the length of each."""
    n = len(samples)
    wide = samples.astype(np.int16)
    diff = np.empty_like(wide)
    diff[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    diff[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    diff[:, 0, 0] = wide[:, 0, 0] - 128
    v = _TO_BITS[diff.reshape(n, 72, 8) + 255]
    out = np.zeros((n, 72, 9), np.uint16)
    k = np.arange(8, dtype=np.uint16)
    out[:, :, :8] = v >> (k + 1)
    out[:, :, 1:] |= (v << (7 - k)) & 0xFF
    scan = out.astype(np.uint8).reshape(n, 648)
    full = scan == 0xFF
    lengths = 648 + full.sum(1)
    flat = scan.ravel()
    return np.insert(flat, np.flatnonzero(full.ravel()) + 1, 0), lengths


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file of one motion-JPEG stream with an index; offsets count from the `movi` tag."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, HAS_INDEX, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"LIST" + struct.pack("<I", 4 + 8 + len(avih) + 12 + 8 + len(strh) + 8 + len(strf)) + b"hdrl" + _chunk(b"avih", avih) + b"LIST" + struct.pack("<I", 4 + 8 + len(strh) + 8 + len(strf)) + b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)
    index = np.zeros(len(frames), INDEX)
    sizes = np.array([len(x) for x in frames], np.int64)
    index["id"], index["flags"], index["size"] = b"00dc", KEY_FRAME, sizes
    index["offset"] = 4 + np.cumsum(sizes + (sizes & 1) + 8) - (sizes + (sizes & 1) + 8)
    movi = b"movi" + b"".join(_chunk(b"00dc", x) for x in frames)
    body = b"AVI " + hdrl + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_avi(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Microseconds a frame, and where each indexed video frame lies (start, size)."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, step, movi, index = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]), 0, -1, None
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            inner = at + 12
            if data[inner : inner + 4] == b"avih":
                step = struct.unpack_from("<I", data, inner + 8)[0]
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"idx1":
            index = np.frombuffer(data, INDEX, size // INDEX.itemsize, at + 8)
        at += 8 + size + (size & 1)
    if movi < 0 or index is None:
        raise ValueError("no movi list or no index")
    index = index[np.char.endswith(index["id"], b"dc") | np.char.endswith(index["id"], b"db")]
    offsets = index["offset"].astype(np.int64)
    base = movi if len(offsets) and offsets[0] < movi else 0  # some writers count from the file's start
    return step or 1_000_000 // FPS, [(base + o + 8, s) for o, s in zip(offsets.tolist(), index["size"].tolist(), strict=True)]


def _unpack_nine_bits(scan: np.ndarray) -> np.ndarray:
    """Samples of (n, 648) scan bytes of this module's own table."""
    n = len(scan)
    b = scan.reshape(n, 72, 9).astype(np.uint16)
    k = np.arange(8, dtype=np.uint16)
    diff = _FROM_BITS[((b[:, :, :8] << 8 | b[:, :, 1:]) >> (7 - k)) & 0x1FF].reshape(n, SIDE, SIDE)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return np.cumsum(diff, axis=2).astype(np.uint8)


def decode_lossless(jpeg: bytes) -> np.ndarray:
    """A grey lossless JPEG with any table, size and predictor, bit by bit."""
    if jpeg[:2] != bytes([0xFF, SOI]):
        raise ValueError("no JPEG")
    at, table, shape, precision = 2, {}, None, 8
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DHT:
            if table or len(body) != 17 + sum(body[1:17]):
                raise ValueError("more than one Huffman table")
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == SOF3:
            precision, h, w, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("more than one component")
            shape = h, w
        elif marker == DRI and any(body):
            raise ValueError("restart intervals")
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a lossless frame")
        elif marker == SOS:
            predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
            break
    if shape is None:
        raise ValueError("no frame header")
    if not 0 < shape[0] * shape[1] <= 8 * (len(jpeg) - at):  # a sample has a bit at least, so what is allocated is bounded by what is there
        raise ValueError("a frame without samples, or with more than its scan can hold")
    bits = "".join(f"{x:08b}" for x in jpeg[at : jpeg.rindex(bytes([0xFF, EOI]))].replace(b"\xff\0", b"\xff"))
    out, p = np.zeros(shape, np.int64), 0
    for y in range(shape[0]):
        for x in range(shape[1]):
            code, length = 0, 0
            while (length, code) not in table or not length:
                code, length, p = code << 1 | int(bits[p]), length + 1, p + 1
                if length > 16:
                    raise ValueError("no such code")
            s = table[length, code]
            d = 32768 if s == 16 else int(bits[p : p + s] or "0", 2)
            p += s if s < 16 else 0
            if 0 < s < 16 and d < 1 << (s - 1):
                d -= (1 << s) - 1
            a = int(out[y, x - 1]) if x else 0
            b = int(out[y - 1, x]) if y else 0
            c = int(out[y - 1, x - 1]) if x and y else 0
            if not y:
                guess = a if x else 1 << (precision - shift - 1)
            elif not x:
                guess = b
            else:
                guess = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
            out[y, x] = (guess + d) & 0xFFFF
    return (out << shift).astype(np.uint8)


def decode_frames(data: bytes, places: list[tuple[int, int]]) -> list[np.ndarray]:
    """Samples of each indexed frame, as (h, w)."""
    raw, own = np.frombuffer(data, np.uint8), []
    out: list[np.ndarray | None] = [None] * len(places)
    for k, (start, size) in enumerate(places):
        if data.startswith(HEAD, start) and data[start + size - 2 : start + size] == TAIL:
            own.append(k)
        else:
            out[k] = decode_lossless(data[start : start + size])
    if own:
        start = np.array([places[k][0] + len(HEAD) for k in own])
        length = np.array([places[k][1] - len(HEAD) - 2 for k in own])
        scans = raw[C.ragged(start, length)]
        stuffed = np.zeros(len(scans), bool)
        stuffed[1:] = (scans[1:] == 0) & (scans[:-1] == 0xFF)
        stuffed[np.cumsum(length)[:-1]] = False
        scans = scans[~stuffed]
        if len(scans) != 648 * len(own):
            raise ValueError("a scan has another length than its frame")
        for k, x in zip(own, _unpack_nine_bits(scans.reshape(-1, 648)), strict=True):
            out[k] = x
    return out


def shots(frames: list[np.ndarray], bins: int = 16, window: int = 8, factor: float = 3.0, least: float = 0.2) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first, end) frames of each shot, and the histogram differences (0 to 1) of neighbours."""
    if not frames:
        return [], np.zeros(0)
    hist = np.stack([np.bincount(x.ravel() * bins >> 8 if x.dtype != np.uint8 else x.ravel() >> (8 - (bins - 1).bit_length()), minlength=bins) / x.size for x in frames])
    diffs = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts, recent = [0], []
    for k, d in enumerate(diffs.tolist(), 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(least, mean + factor * spread):
            cuts.append(k)
            recent = []
        elif d <= least:  # larger ones would hide the cuts behind them
            recent = [*recent[1 - window :], d] if window > 1 else [d]
    return list(zip(cuts, [*cuts[1:], len(frames)], strict=True)), diffs


# ------------------------------------------------------------------ Spark side


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the text's bytes, padded by 255 to a positive multiple of 576, as an AVI file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in C.text_blocks(batch, limit=1 << 20):
                n = np.diff(offs)
                padded = np.maximum(-(-n // FRAME), 1) * FRAME
                payload = np.full(int(padded.sum()), 255, np.uint8)
                payload[C.ragged(np.cumsum(padded) - padded, n)] = data
                scans, lengths = encode_frames(payload.reshape(-1, SIDE, SIDE))
                raw, ends = scans.tobytes(), np.cumsum(lengths)
                jpegs = [HEAD + raw[a:b] + TAIL for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                upto = np.concatenate(([0], np.cumsum(padded // FRAME))).tolist()
                media = [encode_avi(jpegs[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


CLIPS = "array<struct<first_frame:int,end_frame:int,start_ms:long,end_ms:long,mean_luma:double>>"


def read_media(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: the decoded payload's digests and the clips of its shots. One row each; error is null if the file can be read."""
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, clips {CLIPS}, error string"

    def read_one(data: bytes) -> dict:
        out = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "clips": []}
        try:
            step, places = parse_avi(data)
            frames = decode_frames(data, places)
        except (ValueError, IndexError, struct.error) as e:
            return out | {"error": str(e)}
        payload = b"".join(x.tobytes() for x in frames)
        cuts, _ = shots(frames)
        out["clips"] = [{"first_frame": a, "end_frame": b, "start_ms": a * step // 1000, "end_ms": b * step // 1000, "mean_luma": round(float(np.mean([x.mean() for x in frames[a:b]])), 4)} for a, b in cuts]
        return out | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "frames": len(frames)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int32()), ("clips", pa.list_(pa.struct([("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mean_luma", pa.float64())]))), ("error", pa.string())])
        for batch in batches:
            rows = [{"doc_id": d.as_py(), "n_bytes": n.as_py()} | read_one(m.as_py() or b"") for d, n, m in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, kind)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def clip_rows(read: DataFrame) -> DataFrame:
    """Timed clip rows: one for each shot."""
    return read.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
