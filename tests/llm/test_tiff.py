import hashlib
import struct
import zlib

import numpy as np
import pytest

from lotwise.llm import tiff


@pytest.mark.parametrize("codec", [tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 32])
def test_round_trip(codec, predictor, tile):
    rng = np.random.default_rng(1)
    for data in (bytes(64), bytes(64 * 40), b"abcabcabd!" * 64 * 11, rng.integers(0, 256, 64 * 130, np.uint8).tobytes(), rng.integers(0, 3, 64 * 700, np.uint8).tobytes()):
        pages = tiff.read_pages(tiff.write(data, 64, 100, 33, codec, predictor, tile))
        assert b"".join(p.data for p in pages) == data
        assert len(pages) == -(-len(data) // 6400)


def test_broken_files_are_rows(spark):
    good = tiff.write(b"x" * 128, 64, 1, 1)
    rows = [(1, None), (2, b""), (3, b"II*\0"), (4, good), (5, good[:60]), (6, b"MM\0*\0\0\0\x08\0\0")]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "k int, f binary"), "k", "f").collect()
    assert sorted((r.k, r.page, r.error is None) for r in got if r.k == 4) == [(4, 0, True), (4, 1, True)]
    assert all(r.page is None and r.error for r in got if r.k != 4) and {r.k for r in got} == {1, 2, 3, 4, 5, 6}


def tiff_of(*pages, order="<"):
    """A file of pages (fields, strips): fields {tag: (type, values)} without the strips' places and sizes."""
    out, link = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0)), 4
    for fields, strips in pages:
        places = []
        for x in strips:
            places.append(len(out))
            out += x
        fields = fields | {273: (4, places), 279: (4, [len(x) for x in strips])}
        for tag, (kind, values) in fields.items():
            raw = struct.pack(f"{order}{len(values)}{tiff.FIELD[kind][1]}", *values)
            if len(raw) > 4:
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            fields[tag] = struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields[t] for t in sorted(fields))
        link = len(out)
        out += bytes(4)
    return bytes(out)


GREY = {256: (4, [2]), 257: (4, [2]), 258: (3, [8]), 259: (3, [1])}


@pytest.mark.parametrize(
    "change",
    [
        {256: (9, [-5])}, {257: (8, [-1])}, {277: (8, [-1])}, {277: (3, [0])}, {256: (4, [1 << 31]), 257: (4, [1 << 31])}, {258: (3, [7])}, {259: (3, [99])},
        {317: (3, [3])}, {278: (3, [0])}, {284: (3, [9])}, {256: (4, [3])}, {259: (3, [5])}, {259: (3, [8])}, {258: (3, [8, 16])},
    ],
)
def test_odd_fields_are_error_rows_and_hide_no_other_page(spark, change):
    data = tiff_of((GREY, [b"abcd"]), (GREY | change, [b"efgh"]), (GREY, [b"ijkl"]))
    got = {r.page: r for r in tiff.tiff_pages(spark.createDataFrame([(1, data, "x")], "k int, f binary, page string"), "k", "f").collect()}
    assert bytes(got[0].data) == b"abcd" and bytes(got[2].data) == b"ijkl" and got[1].error and got[1].data is None


def test_samples_of_all_widths():
    bilevel = {256: (4, [10]), 257: (4, [2]), 258: (3, [1]), 259: (3, [tiff.PACKBITS])}
    page = tiff.read_pages(tiff_of((bilevel, [tiff.pack_bits(bytes([0b10110000, 0b01000000, 0xFF, 0xFF]))])))[0]
    assert list(page.data) == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1] + [1] * 10
    four = {256: (4, [3]), 257: (4, [1]), 258: (3, [4])}
    assert list(tiff.read_pages(tiff_of((four, [b"\x12\x3f"])))[0].data) == [1, 2, 3]
    planar = {256: (4, [2]), 257: (4, [2]), 258: (3, [8, 8]), 277: (3, [2]), 284: (3, [2])}
    assert tiff.read_pages(tiff_of((planar, [b"abcd", b"ABCD"])))[0].data == b"aAbBcCdD"
    wide = {256: (4, [2]), 257: (4, [1]), 258: (3, [16]), 317: (3, [2])}
    page = tiff.read_pages(tiff_of((wide, [struct.pack(">HH", 1000, 65535)]), order=">"))[0]
    assert np.frombuffer(page.data, np.uint16).tolist() == [1000, 999]


def test_no_rows(spark):
    assert tiff.tiff_pages(spark.createDataFrame([], "k long, f binary"), "k", "f").count() == 0


def test_features_against_plain_python(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "long words " * 20000, "a"]
    texts += [f"text {i} {'ab' * i}" for i in range(60)]  # all forms
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, media int")
    got = {r.doc_id: r for r in tiff.stored_features(tiff.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        steps = sum(abs(a - b) for a, b in zip(payload, payload[1:]))
        n_pages = -(-len(payload) // 65536)
        assert r.feature == f"pages={n_pages};rows={len(payload) // 64};sum={sum(payload)};distinct={len(set(payload))};steps={steps}"
    forms = {tuple((p.codec, p.predictor) for p in tiff.read_pages(x.media)) for x in tiff.store_texts(docs).collect()}
    assert {f[0][0] for f in forms} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE}
    assert got[2].asDict() | {"doc_id": 7} == got[7].asDict()
    assert tiff.stored_features(tiff.store_texts(docs.limit(0))).count() == 0


def test_pages_that_share_a_strip_are_bounded_together(spark):
    """A small file with many directories on one strip: pages come one at a time, and beyond the file's limit as errors."""
    many = tiff_of(*[(GREY, [b"abcd"])] * 50)
    found = tiff.read_pages(many, 4 * 20)
    assert [isinstance(p, tiff.Page) for p in found] == [True] * 20 + [False] * 30 and tiff.count_pages(many) == 50
    assert all("more than 0 bytes" in str(p) for p in found[20:])
    got = tiff.tiff_pages(spark.createDataFrame([(1, many), (2, b"")], "k int, f binary"), "k", "f").collect()
    assert [r.page for r in got if r.k == 1] == list(range(50)) and {r.n_pages for r in got if r.k == 1} == {50}
