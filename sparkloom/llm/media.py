"""Media columns: AVI files of motion JPEG, written, read back and cut into shots.

``encode`` stores bytes as the 8-bit grey samples of frames ``WIDTH`` wide and up to ``HEIGHT`` high. Frames are intra
coded by the lossless process of the JPEG standard (SOF3, predictor 1): the baseline process would round samples away.
Every row is a restart interval, so many rows are decoded in step, one array operation for the n-th sample of each, instead of
bit by bit; frames are coded and decoded in steps of about ``STEP_ROWS`` rows, so memory does not grow with a file's samples. The AVI file has the usual header lists, a ``movi`` list and an ``idx1`` index; the last
frame may be lower than the others, which its own header says.

``decode`` parses the index, decodes the frames and gives back the samples. ``clips`` detects shots: a cut lies where the
histogram of a frame differs from the one before by more than the mean difference of the ``WINDOW`` pairs before it plus
``SIGMAS`` deviations, and by ``LEAST`` at least; each shot is a row with its times.

Cases: a null or empty value is stored as one row of fill; repeated rows and repeated keys are kept; an empty table gives
an empty result; of a file that is null, damaged or of another form, ``decode`` gives no payload and says what is wrong, and
``clips`` gives no rows; files with Huffman tables of their own may stand side by side; other columns are not read, so they
may have any name; a very long value makes many frames of one file, below the 4 GB that the format has.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, flat, table

WIDTH, HEIGHT, FILL = 192, 64, 32
FRAME_US = 40_000
WINDOW, SIGMAS, LEAST = 12, 3.0, 0.25
BINS = 16
#: Rows that are coded or decoded at a time, to the next end of a frame.
STEP_ROWS = 4096

#: Huffman table for difference categories: how many codes there are of each length from 1 to 16, and their categories.
CODE_COUNTS = (0, 2, 2, 3, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
CATEGORIES = (7, 4, 3, 5, 2, 6, 1, 0, 8)
#: Bits that are looked up at a time: at least, and at most, as three bytes hold them at any place.
PEEK, MOST_PEEK = 14, 17


def huffman_codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), codes being assigned in order."""
    found, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            found[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return found


def difference_codes(counts, symbols) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each difference from -255 to 255, extra bits included, at index difference + 255."""
    codes = huffman_codes(counts, symbols)
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = codes[category]
        value[d + 255] = code << category | (d if d >= 0 else d + (1 << category) - 1)
        length[d + 255] = n + category
    return value, length


@functools.lru_cache(64)
def peek_table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Difference and length by the next bits, length 0 where they start no code; and how many bits that are."""
    value, length = difference_codes(counts, symbols)
    peek = max(PEEK, int(length.max()))
    if peek > MOST_PEEK:
        raise ValueError("a Huffman table with codes longer than this reader takes")
    difference, used = np.zeros(1 << peek, np.int32), np.zeros(1 << peek, np.int32)
    for i in range(511):
        spare = peek - int(length[i])
        low = int(value[i]) << spare
        difference[low : low + (1 << spare)] = i - 255
        used[low : low + (1 << spare)] = length[i]
    return difference, used, peek


CODE_VALUE, CODE_LENGTH = difference_codes(CODE_COUNTS, CATEGORIES)
TABLE = bytes([0x00, *CODE_COUNTS, *CATEGORIES])


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(height: int) -> bytes:
    return b"\xff\xd8" + segment(0xC4, TABLE) + segment(0xC3, struct.pack(">BHHBBBB", 8, height, WIDTH, 1, 1, 0x11, 0)) + segment(0xDD, struct.pack(">H", WIDTH)) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def entropy_code(rows: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of ``rows``, and where each row ends in them.

    last: rows that end a frame, which no restart marker follows; number: place of each row in its frame.
    """
    wide = rows.astype(np.int16)
    d = np.empty_like(wide)
    d[:, 0] = wide[:, 0] - 128
    d[:, 1:] = wide[:, 1:] - wide[:, :-1]
    at = d.ravel() + 255
    length = CODE_LENGTH[at]
    ends = np.cumsum(length.reshape(rows.shape), axis=1)
    bits = ends[:, -1]
    size = (bits + 7) >> 3
    row_end = np.cumsum(size)
    begin = ((row_end - size) * 8)[:, None] + ends - length.reshape(rows.shape)
    begin = begin.ravel()
    window = CODE_VALUE[at] << (24 - (begin & 7) - length)
    total = int(row_end[-1])
    sums = np.bincount(begin >> 3, weights=window, minlength=total + 2).astype(np.int64)
    out = sums >> 16
    out[1:] += (sums[:-1] >> 8) & 255
    out[2:] += sums[:-2] & 255
    out = out[:total]
    out[row_end - 1] += (1 << ((-bits) & 7)) - 1
    raw = out.astype(np.uint8)
    full = raw == 255
    extra = full.astype(np.int64)
    marked = row_end[~last] - 1
    extra[marked] += 2
    after = np.cumsum(extra)
    place = np.arange(total) + after - extra
    coded = np.zeros(total + int(after[-1]), np.uint8)
    coded[place] = raw
    at = place[marked] + full[marked]
    coded[at + 1] = 255
    coded[at + 2] = 0xD0 + (number[~last] & 7)
    return coded.tobytes(), row_end + after[row_end - 1]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], height: int) -> bytes:
    """An AVI file of the JPEG ``frames``."""
    largest = max(map(len, frames))
    avih = struct.pack("<14I", FRAME_US, largest * 1_000_000 // FRAME_US, 0, 0x10, len(frames), 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 256, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    at, index, movi = 4, [], [b"movi"]
    for f in frames:
        movi.append(chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def encode_all(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    """An AVI file for each of the byte strings that ``at`` cuts out of ``raw``."""
    sizes = np.diff(at)
    rows = np.maximum(1, -(-sizes // WIDTH))
    first = np.concatenate(([0], np.cumsum(rows)))
    place = np.arange(first[-1]) - np.repeat(first[:-1], rows)
    number = (place % HEIGHT).astype(np.int16)
    last = number == HEIGHT - 1
    last[first[1:] - 1] = True
    del place
    stops = np.flatnonzero(last) + 1  # by frame
    heights = (number[stops - 1] + 1).tolist()
    headers = {h: frame_header(h) for h in set(heights)}
    frames: list[bytes] = []
    low = 0
    while low < first[-1]:
        high = int(stops[min(np.searchsorted(stops, low + STEP_ROWS), len(stops) - 1)])
        coded, ends = entropy_code(samples_of(raw, at, first, low, high), last[low:high], number[low:high])
        begin = 0
        for stop in ends[last[low:high]].tolist():
            frames.append(headers[heights[len(frames)]] + coded[begin:stop] + b"\xff\xd9")
            begin = stop
        low = high
    found, k = [], 0
    for i, n in enumerate((-(-rows // HEIGHT)).tolist()):
        found.append(avi(frames[k : k + n], min(HEIGHT, int(rows[i]))))
        k += n
    return found


def samples_of(raw: np.ndarray, at: np.ndarray, first: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows ``low`` to ``high`` of all files; ``first`` are the files' first rows."""
    samples = np.full((high - low) * WIDTH, FILL, np.uint8)
    for i in range(int(np.searchsorted(first, low, "right")) - 1, int(np.searchsorted(first, high))):
        begin = int(at[i]) + max(0, low - int(first[i])) * WIDTH
        part = raw[begin : min(int(at[i + 1]), int(at[i]) + (high - int(first[i])) * WIDTH)]
        to = max(0, int(first[i]) - low) * WIDTH
        samples[to : to + len(part)] = part
    return samples.reshape(-1, WIDTH)


def parse_avi(data: bytes) -> list[tuple[int, int]]:
    """Offset and size of each video frame, by the file's index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file: no RIFF header")
    movi, index, at = -1, None, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + (size & 1)
    if movi < 0 or index is None:
        raise ValueError("an AVI file without a movi list or an index")
    found = []
    for p in range(index[0], index[0] + index[1], 16):
        name, _, offset, size = struct.unpack_from("<4sIII", data, p)
        if name[2:] in (b"dc", b"db"):
            if data[movi + offset : movi + offset + 4] != name:
                raise ValueError(f"index entry at {p} points at no {name!r} chunk")
            found.append((movi + offset + 8, size))
    return found


def parse_frame(data: bytes, at: int, size: int) -> tuple[int, bytes, int, int]:
    """Height, Huffman table, and begin and end of the entropy-coded bytes of the JPEG frame at ``at``."""
    stop, height, codes = at + size, 0, b""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError(f"no JPEG frame at {at}")
    p = at + 2
    while p < stop:
        _, marker, length = struct.unpack_from(">BBH", data, p)
        body = data[p + 4 : p + 2 + length]
        p += 2 + length
        if marker == 0xC4:
            codes = body
        elif marker == 0xC3:
            precision, height, width, components = struct.unpack_from(">BHHB", body)
            if (precision, width, components) != (8, WIDTH, 1):
                raise ValueError(f"a frame of another form at {at}")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"a frame of process {marker:#x} at {at}; only lossless ones are read")
        elif marker == 0xDD and struct.unpack(">H", body)[0] != WIDTH:
            raise ValueError(f"restart intervals of another length at {at}")
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError(f"predictor {body[3]} at {at}; only 1 is read")
            return height, codes, p, stop - 2
    raise ValueError(f"a frame without a scan at {at}")


def entropy_decode(coded: np.ndarray, rows: int, codes: bytes, first: np.ndarray) -> np.ndarray:
    """Samples of ``rows`` restart intervals. ``coded``: scans one after another; ``first``: where each scan begins."""
    difference, used, n_peek = peek_table(codes[1:17], codes[17:])
    full = np.flatnonzero(coded[:-1] == 255)
    follow = coded[full + 1]
    keep = np.ones(len(coded), bool)
    keep[full[follow == 0] + 1] = False
    restarts = full[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[restarts] = keep[restarts + 1] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    begins = np.sort(np.concatenate((kept[first], kept[restarts])))
    if len(begins) != rows:
        raise ValueError(f"{len(begins)} restart intervals for {rows} rows")
    raw = np.concatenate((coded[keep], np.zeros(4, np.uint8))).astype(np.int32)
    words = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    at = begins * 8
    stop = len(words) - 1
    sample = np.full(rows, 128, np.int32)
    out = np.empty((WIDTH, rows), np.uint8)
    for k in range(WIDTH):
        peek = words[np.minimum(at >> 3, stop)] >> (24 - n_peek - (at & 7)) & ((1 << n_peek) - 1)
        sample = sample + difference[peek]
        at = at + used[peek]
        out[k] = sample
    return np.ascontiguousarray(out.T)


def parse_file(data: bytes | None) -> list[tuple[int, bytes, int, int]]:
    """``parse_frame`` of each frame; an error says what is wrong with the file."""
    if data is None:
        raise ValueError("no file")
    try:
        frames = [parse_frame(data, at, size) for at, size in parse_avi(data)]
        for _, codes, _, _ in frames:
            peek_table(codes[1:17], codes[17:])
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"a file that ends early or has no valid table: {e}") from e
    return frames


def decode_all(files: list[bytes | None]) -> list[list[np.ndarray] | ValueError]:
    """The frames of each file, as arrays of samples, or what is wrong with it."""
    found: list[list[np.ndarray] | ValueError] = []
    scans: list[tuple[int, int, bytes, int, int]] = []
    for i, data in enumerate(files):
        try:
            scans += [(i, *frame) for frame in parse_file(data)]
            found.append([])
        except ValueError as e:
            found.append(e)
    k = 0
    while k < len(scans):
        n, rows = k, 0
        while n < len(scans) and scans[n][2] == scans[k][2] and rows < STEP_ROWS:
            rows += scans[n][1]
            n += 1
        decode_step(files, scans[k:n], found)
        k = n
    return found


def decode_step(files: list[bytes], scans: list[tuple[int, int, bytes, int, int]], found: list) -> None:
    """Decode frames of one Huffman table together; if that fails, file by file, to tell the damaged ones."""
    parts = [files[i][begin:end] for i, _, _, begin, end in scans]
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts[:-1]]))).astype(np.int64)
    try:
        samples = entropy_decode(np.frombuffer(b"".join(parts), np.uint8), sum(h for _, h, *_ in scans), scans[0][2], first)
    except (ValueError, IndexError) as e:
        owners = sorted({i for i, *_ in scans})
        if len(owners) == 1:
            found[owners[0]] = ValueError(f"a scan that can't be decoded: {e}")
        for i in owners if len(owners) > 1 else ():
            decode_step(files, [scan for scan in scans if scan[0] == i], found)
        return
    row = 0
    for i, height, *_ in scans:
        if isinstance(found[i], list):
            found[i].append(samples[row : row + height])
        row += height


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    return np.array([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames])


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First frame and end of each shot."""
    if len(frames) < 2:
        return [(0, len(frames))]
    gaps = np.abs(np.diff(histograms(frames), axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, gap in enumerate(gaps):
        before = gaps[max(0, i - WINDOW) : i]
        if gap >= LEAST and (not len(before) or gap > before.mean() + SIGMAS * before.std()):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(frames)], strict=True))


def encode(rows: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """``key, n_bytes, media``: each string or binary of ``value`` as an AVI file."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, at = flat(batch.column(0))
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(at)), pa.array(encode_all(raw, at), pa.binary())], ["key", "n_bytes", "media"])

        return step

    return arrow_map(rows.select(F.col(value).alias("value"), F.col(key).alias("key")), make, f"key {dict(rows.dtypes)[key]}, n_bytes long, media binary").withColumnRenamed("key", key)


def decode(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """``key, payload, problem``: the samples of all frames of each AVI file, one after another, or what is wrong with it."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = decode_all(batch.column(0).to_pylist())
            payloads = [b"".join(f.tobytes() for f in frames) if isinstance(frames, list) else None for frames in found]
            problems = [None if isinstance(frames, list) else str(frames) for frames in found]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], ["key", "payload", "problem"])

        return step

    return arrow_map(files.select(F.col(media).alias("media"), F.col(key).alias("key")), make, f"key {dict(files.dtypes)[key]}, payload binary, problem string").withColumnRenamed("key", key)


def clips(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each shot: ``key, clip, start_ms, end_ms, frames``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, found = batch.column(1).to_pylist(), []
            for k, frames in zip(keys, decode_all(batch.column(0).to_pylist()), strict=True):
                cut = shots(frames) if isinstance(frames, list) else []
                found += [(k, i, a * FRAME_US // 1000, b * FRAME_US // 1000, b - a) for i, (a, b) in enumerate(cut)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(1).type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["key", "clip", "start_ms", "end_ms", "frames"])

        return step

    return arrow_map(files.select(F.col(media).alias("media"), F.col(key).alias("key")), make, f"key {dict(files.dtypes)[key]}, clip long, start_ms long, end_ms long, frames long").withColumnRenamed("key", key)


def digests(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each file of ``encode``: digests of the bytes stored and read back, and a feature string of its shots."""
    schema = f"key {dict(files.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            files, rows = batch.column(0).to_pylist(), []
            for data, frames in zip(files, decode_all(files), strict=True):
                if not isinstance(frames, list):
                    raise frames
                payload = b"".join(f.tobytes() for f in frames)
                cut = shots(frames)
                mean = np.rint(1000 * np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=BINS) / len(payload)).astype(int)
                feature = f"shots={len(cut)};clips=" + ",".join(f"{a * FRAME_US // 1000}-{b * FRAME_US // 1000}" for a, b in cut) + ";hist=" + ".".join(map(str, mean))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *columns], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        return step

    return arrow_map(files.select("media", F.col(key).alias("key"), "n_bytes"), make, schema).withColumnRenamed("key", key)


def op8_media_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
