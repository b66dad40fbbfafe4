"""TIFF columns: a writer and a reader of grey 8-bit images, one row per page.

The reader walks the image directories of a file and decodes uncompressed, PackBits, LZW and
deflate data in strips or tiles, with the horizontal predictor undone.  Tag numbers and codes are
those of the TIFF 6.0 specification.
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

from wayfold.llm.arrays import ready

# Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SHORT, LONG = 3, 4
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

ROW = 64
#: Rows of one strip and of one page that the writer makes.
STRIP_ROWS, PAGE_ROWS = 1024, 1 << 18
#: Samples of the largest page that is decoded; a damaged size may name any number.
MOST_SAMPLES = 1 << 30
#: What a damaged file may raise.
DAMAGE = (ValueError, LookupError, TypeError, ArithmeticError, struct.error, zlib.error)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more equal bytes as repeats, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(a)]]) if len(a) else starts
    out, plain = bytearray(), 0

    def literal(upto):
        for k in range(plain, upto, 128):
            piece = data[k: min(k + 128, upto)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for s, e in zip(starts[ends - starts >= 3].tolist(), ends[ends - starts >= 3].tolist()):
        literal(s)
        while e - s >= 2:
            n = min(128, e - s)
            out += bytes((257 - n, data[s]))
            s += n
        plain = s
    literal(len(a))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1: i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1: i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early (by the reader's table, one entry behind)."""
    out = bytearray()
    table, following, width = {}, 258, 9  # (code of a word, next byte) to the code of both
    bits, held, word = 256, 9, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = table.get(word << 8 | byte)
        if longer is not None:
            word = longer
            continue
        bits, held = bits << width | word, held + width
        table[word << 8 | byte], following = following, following + 1
        word = byte
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            bits, held = bits << width | 256, held + width
            table, following, width = {}, 258, 9
        if held >= 64:
            held -= 64
            out += (bits >> held).to_bytes(8)
            bits &= (1 << held) - 1
    if word >= 0:
        bits, held, following = bits << width | word, held + width, following + 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    bits, held = bits << width | 257, held + width
    spare = -held % 8
    return bytes(out) + (bits << spare).to_bytes((held + spare) // 8)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        n = len(table)
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
    return bytes(out[:size])


def _packed(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[compression](data)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)[:size]
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {compression} is not supported")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int | None = None) -> bytes:
    """Little-endian file of grey pages; ``tile`` (a multiple of 16) stores square tiles instead of strips."""
    out = bytearray(b"II" + struct.pack("<HI", 42, 0))
    link = 4
    for image in pages:
        height, width = image.shape
        if tile:
            image = np.pad(image, ((0, -height % tile), (0, -width % tile)))
            blocks = [image[y: y + tile, x: x + tile] for y in range(0, image.shape[0], tile) for x in range(0, image.shape[1], tile)]
        else:
            blocks = [image[y: y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        at, length = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _packed(np.ascontiguousarray(block, np.uint8).tobytes(), compression)
            at.append(len(out))
            length.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        where = [(TILE_WIDTH, LONG, [tile]), (TILE_HEIGHT, LONG, [tile]), (TILE_OFFSETS, LONG, at), (TILE_BYTES, LONG, length)] if tile else [(STRIP_OFFSETS, LONG, at), (ROWS_PER_STRIP, LONG, [STRIP_ROWS]), (STRIP_BYTES, LONG, length)]
        tags = sorted([(WIDTH, LONG, [width]), (HEIGHT, LONG, [height]), (BITS, SHORT, [8]), (COMPRESSION, SHORT, [compression]), (PHOTOMETRIC, SHORT, [1]), (SAMPLES, SHORT, [1]), (PREDICTOR, SHORT, [predictor]), *where])
        entries = []
        for tag, kind, values in tags:
            raw = struct.pack(f"<{len(values)}{'H' if kind == SHORT else 'I'}", *values)
            if len(raw) > 4:
                place, raw = len(out), raw
                out += raw
                raw = struct.pack("<I", place)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link: link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def _directories(data: bytes) -> Iterator[dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", data, k)
            size = TYPE_SIZE.get(kind, 1) * count
            place = k + 8 if size <= 4 else struct.unpack_from(order + "I", data, k + 8)[0]
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place) if letter else (data[place: place + size],)
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_tiff(data: bytes) -> Iterator[np.ndarray]:
    """The grey 8-bit pages of a file in order."""
    for tags in _directories(data):
        one = lambda tag, default: tags.get(tag, (default,))[0]
        width, height = one(WIDTH, 0), one(HEIGHT, 0)
        if not 0 < width * height <= MOST_SAMPLES:
            raise ValueError(f"a page of {width} x {height} samples is not supported")
        if one(BITS, 8) != 8 or one(SAMPLES, 1) != 1:
            raise ValueError("only 8-bit pages of one sample are supported")
        tiled = TILE_OFFSETS in tags
        across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height) or 1)
        image = np.zeros((-(-height // down) * down, -(-width // across) * across), np.uint8)
        columns = image.shape[1] // across
        for k, (at, length) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES])):
            y, x = k // columns * down, k % columns * across
            rows = down if tiled else min(down, height - y)
            block = np.frombuffer(_unpacked(data[at: at + length], one(COMPRESSION, 1), rows * across), np.uint8).reshape(rows, across)
            if one(PREDICTOR, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            image[y: y + rows, x: x + across] = block
        yield image[:height, :width]


def text_pages(raw: bytes, page_rows: int = PAGE_ROWS) -> list[np.ndarray]:
    """A text's bytes, padded with 0 to a positive multiple of 64, as pages 64 samples wide."""
    size = max(64, -(-len(raw) // 64) * 64)
    rows = np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, ROW)
    return [rows[k: k + page_rows] for k in range(0, len(rows), page_rows)]


def layout(raw: bytes) -> tuple[int, int, int | None]:
    """Compression, predictor and tile size of a text's file: any of the reader's, by a hash of the content."""
    h = zlib.crc32(raw)
    return (PACKBITS, LZW, DEFLATE)[h % 3], 1 + h // 3 % 2, (None, 64, 32)[h // 6 % 3]


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_rows: int = PAGE_ROWS) -> DataFrame:
    """(id, n_bytes, media): every whole text as a TIFF file in the ``layout`` of its content; null is empty."""

    def run(batches):
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            media = [write_tiff(text_pages(x, page_rows), *layout(x)) for x in raw]
            if media:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    ready(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def pages(files: DataFrame, id_col: str = "id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, page, width, height, pixels, status, then the columns in ``keep``): one row per page, in order.

    Null files have no rows.  A file that is damaged or of another layout brings the pages before
    the fault, then one row without size and pixels whose ``status`` says what is wrong; all other
    rows have the status ``ok``.
    """

    def rows(data):
        n = -1
        try:
            for n, image in enumerate(read_tiff(data)):
                yield n, image.shape[1], image.shape[0], image.tobytes(), "ok"
        except DAMAGE as fault:
            yield n + 1, None, None, None, f"{type(fault).__name__}: {fault}"

    def run(batches):
        for b in batches:
            for k, data in enumerate(b.column(1)):
                for n, width, height, pixels, status in rows(data.as_py()) if data.is_valid else ():
                    own = [pa.array([n], pa.int32()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([pixels], pa.binary()), pa.array([status])]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *own, *[b.column(2 + c).slice(k, 1) for c in range(len(keep))]], ["id", "page", "width", "height", "pixels", "status", *keep])

    given = files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, ", ".join([f"id {kinds['id']}, page int, width int, height int, pixels binary, status string", *[f"`{c}` {kinds[c]}" for c in keep]]))


def features(files: DataFrame) -> DataFrame:
    """Digests of stored files (id, n_bytes, media), folded from the rows of their ``pages``.

    ``feature`` is ``pages:rows:mean:deviation:entropy`` of the samples.  A damaged file has its own
    size and digest, but nulls for what its samples would give.  A file's pages follow each other
    in one task, page 0 first, so nothing is shuffled.
    """

    def digest(sha, tail, size, counts, n):
        p = counts / max(size, 1)
        mean = float(p @ np.arange(256))
        spread = float(p @ (np.arange(256) - mean) ** 2) ** 0.5
        p = p[p > 0]
        return size, sha.hexdigest(), zlib.crc32(tail), f"{n}:{size // ROW}:{mean:.4f}:{spread:.4f}:{abs(float(p @ np.log2(p))):.4f}"

    def batch(done):
        own = pa.concat_tables([pa.table(f) for f, _ in done]).combine_chunks().to_batches()[0]
        c = list(zip(*[d or (None,) * 4 for _, d in done]))
        return pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), own.column(2), own.column(3), pa.array(c[3], pa.string())],
                                          ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    def run(batches):
        done, about, state = [], None, None
        for b in batches:
            t = pa.table(b).select(["id", "n_bytes", "media_bytes", "media_sha256"])
            for k, (n, pixels) in enumerate(zip(b.column(1).to_pylist(), b.column(4))):
                if n == 0:
                    if about is not None:
                        done.append((about, state and digest(*state)))
                    about, state = t.slice(k, 1), (hashlib.sha256(), b"", 0, np.zeros(256, np.int64), 0)
                if not pixels.is_valid:
                    state = None
                elif state:
                    sha, tail, size, counts, _ = state
                    raw = pixels.as_buffer()
                    sha.update(raw)
                    samples = np.frombuffer(raw, np.uint8)
                    state = sha, (tail + samples[-64:].tobytes())[-64:], size + len(samples), counts + np.bincount(samples, minlength=256), n + 1
            if len(done) >= 64:
                yield batch(done)
                done = []
        if about is not None:
            yield batch([*done, (about, state and digest(*state))])

    kind = files.schema["id"].dataType.simpleString()
    given = files.select("id", "media", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return pages(given, keep=("n_bytes", "media_bytes", "media_sha256")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
