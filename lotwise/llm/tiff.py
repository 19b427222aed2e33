"""Operator 10, media columns: TIFF files in a binary column, one row per page.

The reader walks the chain of image directories, decodes strips or tiles that are stored plain, as PackBits, LZW or
deflate, undoes the horizontal predictor, unpacks samples of 1, 2, 4, 8 or 16 bits, chunky or planar, and emits one row
per page; a page that can't be read is a row with the reason and hides no other page. The writer makes multi-page grey
files with any of these codecs, in strips or tiles. Files are read whole, one at a time; no row needs another row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format: tags, codecs and the byte width of field types.
NEW_SUBFILE, WIDTH, HEIGHT, BITS, CODEC, PHOTOMETRIC = 254, 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PAGE_NUMBER, PREDICTOR = 273, 277, 278, 279, 284, 297, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 16: (8, "Q")}


class BadTiff(ValueError):
    """The bytes are no TIFF file that this reader knows."""


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    codec: int
    predictor: int
    data: bytes


def pack_bits(data: bytes) -> bytes:
    """PackBits: a run of 2 to 128 equal bytes as two bytes, other bytes behind their count."""
    out, i, n = bytearray(), 0, len(data)
    plain = bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush()
            out.append(257 - (j - i))
            out.append(data[i])
        else:
            plain.extend(data[i:j])
        i = j
    flush()
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from 9 to 12 bits, most significant first, 256 clears, 257 ends, early change."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    width, free, now = 9, 258, b""
    put(256, width)
    for i in range(len(data)):
        longer = now + data[i : i + 1]
        if longer in table:
            now = longer
            continue
        put(table[now], width)
        table[longer] = free
        free += 1
        now = data[i : i + 1]
        if free == 4094:
            put(256, width)
            table = {bytes([i]): i for i in range(256)}
            width, free = 9, 258
        elif free > (1 << width) - 1:
            width += 1
    if now:
        put(table[now], width)
        free += 1
        if free > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, last = list(first), bytearray(), 9, b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif last and code == len(table):
            now = last + last[:1]
        else:
            raise BadTiff("an LZW code that isn't in the table")
        out += now
        if last:
            table.append(last + now[:1])
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        last = now
    return bytes(out)


def encode(data: bytes, codec: int) -> bytes:
    if codec == PLAIN:
        return data
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return {LZW: lzw, PACKBITS: pack_bits}[codec](data)


def decode(data: bytes, codec: int, size: int) -> bytes:
    """The ``size`` bytes of a strip or tile; missing ones are an error."""
    if codec == PLAIN:
        out = data[:size]
    elif codec in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as broken:
            raise BadTiff(f"deflate: {broken}") from broken
    elif codec == LZW:
        out = unlzw(data, size)
    elif codec == PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise BadTiff(f"codec {codec}")
    if len(out) < size:
        raise BadTiff(f"{len(out)} of {size} bytes in a strip or tile")
    return out[:size]


def write(samples: bytes, width: int, page_rows: int, strip_rows: int, codec: int = DEFLATE, predictor: int = 2, tile: int = 0) -> bytes:
    """8-bit grey samples as a little-endian file: pages of up to page_rows rows, in strips, or in tiles if tile > 0."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, width)
    pages = [grid[r : r + page_rows] for r in range(0, len(grid), page_rows)]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for number, page in enumerate(pages):
        if tile:
            down, across = -(-len(page) // tile), -(-width // tile)
            full = np.zeros((down * tile, across * tile), np.uint8)
            full[: len(page), :width] = page
            blocks = [full[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile] for r in range(down) for c in range(across)]
        else:
            blocks = [page[r : r + strip_rows] for r in range(0, len(page), strip_rows)]
        at, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            stored = encode(block.tobytes(), codec)
            at.append(len(out))
            sizes.append(len(stored))
            out += stored
        tags = {NEW_SUBFILE: (4, [2 * (len(pages) > 1)]), WIDTH: (4, [width]), HEIGHT: (4, [len(page)]), BITS: (3, [8]), CODEC: (3, [codec]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PLANAR: (3, [1]), PAGE_NUMBER: (3, [number & 0xFFFF, len(pages) & 0xFFFF]), PREDICTOR: (3, [predictor])}
        if tile:
            tags |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_AT: (4, at), TILE_BYTES: (4, sizes)}
        else:
            tags |= {STRIP_AT: (4, at), STRIP_ROWS: (4, [strip_rows]), STRIP_BYTES: (4, sizes)}
        out += b"\0" * (len(out) % 2)
        entries, beyond = bytearray(), bytearray()
        directory = len(out)
        after = directory + 2 + 12 * len(tags) + 4
        for tag in sorted(tags):
            kind, values = tags[tag]
            value = struct.pack(f"<{len(values)}{FIELD[kind][1]}", *values)
            if len(value) > 4:
                entries += struct.pack("<HHII", tag, kind, len(values), after + len(beyond))
                beyond += value + b"\0" * (len(value) % 2)
            else:
                entries += struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        struct.pack_into("<I", out, link, directory)
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0" + beyond
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory, in the order of their chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise BadTiff("a directory outside the file, or a loop of directories")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        if at + 2 + 12 * count + 4 > len(data):
            raise BadTiff("a directory that is cut off")
        fields = {}
        for k in range(count):  # a field's values are at most as long as the file
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELD:
                continue
            size, code = FIELD[kind]
            place = at + 10 + 12 * k if size * n <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if place + size * n > len(data):
                raise BadTiff("a field outside the file")
            fields[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def read_page(data: bytes, order: str, fields: dict[int, tuple], most: int = 1 << 30) -> Page:
    """A page with its samples chunky, one byte a sample up to 8 bits and two, in the machine's order, for 16."""

    def one(tag: int, default: int | None = None) -> int | None:
        value = fields[tag][0] if fields.get(tag) else default
        if value is not None and not isinstance(value, int) or value is not None and value < 0:
            raise BadTiff(f"tag {tag} is {value}")
        return value

    width, height, bits, samples = one(WIDTH), one(HEIGHT), one(BITS, 1), one(SAMPLES, 1)
    codec, predictor, planar = one(CODEC, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or not samples:
        raise BadTiff("no width, height or samples")
    if bits not in (1, 2, 4, 8, 16) or len(set(fields.get(BITS, (bits,)))) > 1:
        raise BadTiff(f"{fields.get(BITS)} bits a sample")
    if predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise BadTiff(f"predictor {predictor} with {bits} bits")
    if planar not in (1, 2):
        raise BadTiff(f"planar configuration {planar}")
    size = 2 if bits == 16 else 1
    if width * height * samples * size > most:
        raise BadTiff(f"{width} x {height} x {samples} samples are more than {most} bytes")
    tiled = TILE_AT in fields
    wide, tall = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    if not wide or not tall:
        raise BadTiff("strips or tiles without a size")
    planes, inside = (samples, 1) if planar == 2 else (1, samples)
    line = -(-wide * inside * bits // 8)
    if tiled and line * tall > most:
        raise BadTiff(f"tiles of {wide} x {tall} samples are more than {most} bytes")
    at, sizes = (fields.get(k, ()) for k in ((TILE_AT, TILE_BYTES) if tiled else (STRIP_AT, STRIP_BYTES)))
    across, down = -(-width // wide), -(-height // tall)
    if min(len(at), len(sizes)) < across * down * planes or min([*at, *sizes], default=0) < 0:
        raise BadTiff("too few strips or tiles, or such before the file's start")
    kind = np.dtype(order + "u2" if bits == 16 else "u1")
    page = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, spot = divmod(k, across * down)
        top, left = spot // across * tall, spot % across * wide
        rows = tall if tiled else min(tall, height - top)
        raw = np.frombuffer(decode(data[at[k] : at[k] + sizes[k]], codec, rows * line), np.uint8)
        if bits < 8:
            split = np.unpackbits(raw).reshape(rows, line * 8 // bits, bits)
            block = (split @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8)))[:, : wide * inside].reshape(rows, wide, inside)
        else:
            block = raw.view(kind).reshape(rows, wide, inside)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=page.dtype)
        page[top : top + rows, left : left + wide, plane : plane + inside] = block[: height - top, : width - left]
    return Page(width, height, bits, samples, codec, predictor, page.tobytes())


def each_page(data: bytes, most: int = 1 << 30) -> Iterator[Page | BadTiff]:
    """The pages in the order of their directories, one at a time, an error in place of one that can't be read; a broken
    chain of directories ends with its error. All pages of a file have ``most`` bytes of samples together: a page that
    doesn't fit into what is left of them is an error."""
    chain = directories(data)
    while True:
        try:
            order, fields = next(chain)
            page = read_page(data, order, fields, most)
            most -= len(page.data)
            yield page
        except StopIteration:
            return
        except BadTiff as why:
            yield why


def read_pages(data: bytes, most: int = 1 << 30) -> list[Page | BadTiff]:
    return list(each_page(data, most))


def count_pages(data: bytes) -> int:
    """How many each_page() gives."""
    n = 0
    try:
        for _ in directories(data):
            n += 1
    except BadTiff:
        n += 1
    return n


PAGES = "page int, n_pages int, width int, height int, bits int, samples int, codec int, predictor int, data binary, error string"


def tiff_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of each file in the binary column ``media``, with the bigint column ``key``.

    A page that can't be read has the reason in ``error`` and no samples; a null or empty file, or one without a page,
    gives one row with page null. No file stops the job: a task holds one page, and a file's pages have 1 GiB of samples
    together, beyond which they are error rows. Samples of up to 8 bits come as one byte each, of 16 as two.
    Rows with equal keys or equal files each give their own rows, and other columns of df play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(x.split()[0] for x in PAGES.split(", "))]
        kinds = [pa.int64(), *[pa.int32()] * 8, pa.binary(), pa.string()]
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py() or b""
                n = count_pages(data)
                for i, p in enumerate(each_page(data)):
                    if isinstance(p, Page):
                        out = (row, i, n, p.width, p.height, p.bits, p.samples, p.codec, p.predictor, p.data, None)
                    else:
                        out = (row, i if n > 1 else None, n, *[None] * 7, str(p))
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(out, kinds, strict=True)], names)
                if not n:
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((row, *[None] * 9, "no page"), kinds, strict=True)], names)

    return df.select(df[key].cast("bigint").alias(key), df[media]).mapInArrow(run, f"{key} bigint, {PAGES}")


WIDE, PAGE_ROWS, ROWS, TILE = 64, 1024, 256, 64
#: Of each 16 texts, by a digest: LZW strips, LZW tiles, four PackBits strips, two PackBits tiles, two deflate tiles.
FORMS = [(LZW, 0), (LZW, TILE), *[(PACKBITS, 0)] * 4, *[(PACKBITS, TILE)] * 2, *[(DEFLATE, TILE)] * 2, *[(DEFLATE, 0)] * 6]


def stored_form(payload: bytes) -> bytes:
    """The payload as a TIFF file, whose codec and layout its own bytes choose, so that equal texts have equal files."""
    codec, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write(payload, WIDE, PAGE_ROWS, ROWS, codec, 1 if codec == PACKBITS else 2, tile)


def store_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text in UTF-8, filled with bytes 0 to a positive multiple of 64, as a TIFF file.

    The samples are rows of 64 grey pixels in pages of up to 1024 rows, in strips of 256 rows or tiles of 64 x 64, as
    PackBits, or as LZW or deflate with the horizontal predictor (FORMS). A null text counts as empty and gives one row
    of zero pixels. Columns other than doc_id and text play no part; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                data = text.as_py() or b""
                media = stored_form(data + b"\0" * (-len(data) % WIDE if data else WIDE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(data)], pa.int64()), pa.array([media], pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


FEATURES = ("doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages int")


def stored_features(stored: DataFrame) -> DataFrame:
    """One row per file of store_texts(): digests of the file and of the samples read back, and features of these.

    ``feature`` has pages, rows, the mean, the distinct values and the sum of differences between neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in FEATURES.split(", ")), strict=True)
        kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for batch in batches:
            rows = []
            for key, n, media in zip(*(batch.column(i) for i in range(3)), strict=True):
                media = media.as_py()
                pages = read_pages(media)
                if errors := [p for p in pages if isinstance(p, BadTiff)]:
                    raise errors[0]  # a file of our own that can't be read is no input error
                payload = b"".join(p.data for p in pages)
                x = np.frombuffer(payload, np.uint8)
                values = np.bincount(x, minlength=256)
                steps = int(np.abs(np.diff(x.astype(np.int16))).sum())
                feature = f"pages={len(pages)};rows={sum(p.height for p in pages)};sum={int(values @ np.arange(256))};distinct={int((values > 0).sum())};steps={steps}"
                rows.append((key.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(pages)))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], list(names))

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
