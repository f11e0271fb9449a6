"""Sizes by headers, and archives read in place."""

import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gallerium.functions import images
from gallerium.operators import items
from gallerium.sources import archives


def png(w, h):
    body = b"IHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + body + zlib.crc32(body).to_bytes(4, "big")


def gif(w, h):
    return b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\0\0\0"


def jpeg(w, h, before=0, frame=0xC0):
    segment = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    apps = b"".join(segment(0xE1, bytes(60_000)) for _ in range(before))
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + apps + segment(0xC4, b"tables") + b"\xff" + segment(frame, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03")


def webp(kind, w, h):
    if kind == b"VP8X":
        body = b"\0\0\0\0" + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
    elif kind == b"VP8L":
        body = b"\x2f" + ((w - 1) | (h - 1) << 14).to_bytes(4, "little") + bytes(5)
    else:
        body = b"\0\0\0\x9d\x01\x2a" + w.to_bytes(2, "little") + h.to_bytes(2, "little")
    return b"RIFF" + (4 + 8 + len(body)).to_bytes(4, "little") + b"WEBP" + kind + len(body).to_bytes(4, "little") + body


MADE = {
    "png": (png(70_000, 3), (70_000, 3)), "gif": (gif(513, 2), (513, 2)), "jpeg": (jpeg(640, 480), (640, 480)), "progressive": (jpeg(1, 2, 5, 0xC2), (1, 2)),
    "vp8": (webp(b"VP8 ", 100, 200), (100, 200)), "vp8l": (webp(b"VP8L", 16384, 1), (16384, 1)), "vp8x": (webp(b"VP8X", 1 << 24, 9), (1 << 24, 9)),
    "far": (jpeg(5, 5, 7), None),  # its frame lies behind what is looked at
    "none": (None, None), "empty": (b"", None), "text": (b"<html>", None), "scan": (b"\xff\xd8\xff\xda\0\x08", None), "loop": (b"\xff\xd8\xff\xe0\0\0" * 9, None),
}


@pytest.mark.parametrize("name", MADE)
def test_header_sizes(name):
    data, want = MADE[name]
    assert images.header_size(data) == want


@pytest.mark.parametrize("name", [n for n, (d, s) in MADE.items() if s])
def test_a_truncated_header_tells_nothing_or_the_same(name):
    data, want = MADE[name]
    told = [images.header_size(data[:k]) for k in range(min(len(data), 400))]
    assert set(told) <= {None, want} and told[0] is None


def test_missing_sizes_are_probed_once(spark):
    rows = [("a", "u1", "", 0, 5), ("b", "u1", "", None, None), ("c", "", "u2", 0, 0), ("d", "u3", "", 7, 8), ("e", "u4", "u2", 0, 0), ("f", "", "", 0, 0)]
    frame = spark.createDataFrame(rows, "id string, image_url string, thumb_url string, width int, height int")
    files = spark.createDataFrame([("u1", png(10, 20)), ("u2", jpeg(30, 40)), ("u3", png(1, 1)), ("u4", b"broken"), ("u1", png(10, 20))], "url string, content binary")
    filled, sizes = items.probe_sizes(frame, files)
    assert {r.id: (r.width, r.height) for r in filled.collect()} == {"a": (10, 20), "b": (10, 20), "c": (30, 40), "d": (7, 8), "e": (0, 0), "f": (0, 0)}
    assert {r.url: (r.width, r.height) for r in sizes.collect()} == {"u1": (10, 20), "u2": (30, 40), "u4": (0, 0)}
    again, _ = items.probe_sizes(frame, files.limit(0), sizes)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in filled.collect()}


def test_archives_are_read_in_place(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/pool.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("P/annotations/b.json", json.dumps([{"image_path": "./images/2.png", "image_metadata": {"k": "first"}}, {"image_path": "P/images/10.PNG", "image_metadata": None}]))
        for n in ("10.PNG", "2.png", "notes.txt", "3.png"):
            z.writestr(f"P/images/{n}", n.encode() * 1000)
        z.writestr("P/annotations/a.json", json.dumps([{"image_path": "images/2.png", "image_metadata": {"k": "second"}}, {"image_path": "images/3.png", "image_metadata": {"k": "third"}}]))
        z.writestr("P/images/sub/", b"")
    with zipfile.ZipFile(f"{tmp_path}/empty.zip", "w"):
        pass
    got = [(r.id, r.number, r.size, r.metadata) for r in archives.pool(spark, [path, f"{tmp_path}/empty.zip"], "P/").orderBy("number").collect()]
    assert got == [("10", 1, 6000, {}), ("2", 2, 5000, {"k": "first"}), ("3", 3, 5000, {"k": "third"})]
    every = {r.member: bytes(r.content) for r in archives.members(spark, [path], "P/images/").collect()}
    assert every["P/images/notes.txt"] == b"notes.txt" * 1000 and len(every) == 4
    with archives.opened(path) as z:
        runs = list(archives.dealt(z.infolist(), 1))
    assert len(runs) == 7 and runs[0] == ["P/annotations/b.json"]  # a member each, in the order of their places


def test_sizes_of_archived_images(spark, tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/i.zip", "w") as z:
        z.writestr("images/a.png", png(3, 4))
        z.writestr("images/b.png", jpeg(5, 6))
    found = archives.members(spark, [f"{tmp_path}/i.zip"]).select("member", images.header_sizes(F.col("content")).alias("s")).collect()
    assert {r.member: (r.s.width, r.s.height) for r in found} == {"images/a.png": (3, 4), "images/b.png": (5, 6)}
