"""Images as columns: type by magic bytes, fingerprints of raw pixels, proportions and file types for display."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FINGERPRINT = "color array<float>, gray array<float>, dhash array<boolean>, aspect double"
THUMB = 128
AT_ONCE = 4 << 20  # bytes of pixels
# File types by the names that addresses and media types use.
FILE_TYPES = {"jpeg": "JPG", "jpg": "JPG", "png": "PNG", "webp": "WEBP", "gif": "GIF", "tif": "TIFF", "tiff": "TIFF", "jp2": "JP2"}


def mime_type(data: Column) -> Column:
    """The media type by the first bytes; null if it's none of the supported ones."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24), "image/webp")
    )


def file_type(*values: Column) -> Column:
    """The type that the first telling value names: a media type, a bare name or an address's ending."""
    names = "|".join(FILE_TYPES)
    kinds = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    found = [F.nullif(F.regexp_extract(F.lower(F.coalesce(v, F.lit(""))), rf"(?:^|[/.])({names})(?:$|[?#;])", 1), F.lit("")) for v in values]
    return F.coalesce(F.element_at(kinds, F.coalesce(*found)), F.lit(""))


def tile_ratio(width: Column, height: Column) -> Column:
    """Width by height within the bounds of a tile; 1.38 where either is unknown."""
    ratio = F.when((width > 0) & (height > 0), width / height).otherwise(1.38)
    return F.greatest(F.least(ratio, F.lit(2.8)), F.lit(0.62))


def candidates(*urls: Column) -> Column:
    """Addresses to try in order, once each, without empty ones."""
    return F.array_distinct(F.filter(F.array_compact(F.array(*urls)), lambda u: u != ""))


def shrunk(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over a grid of boxes of each image; smaller images repeat their pixels."""
    rows, columns = (np.minimum((np.arange(n + 1) * size / n).astype(int), size - 1) for n, size in ((height, pixels.shape[1]), (width, pixels.shape[2])))
    out = [[pixels[:, a : max(b, a + 1), c : max(d, c + 1)].mean((1, 2)) for c, d in zip(columns, columns[1:])] for a, b in zip(rows, rows[1:])]
    return np.moveaxis(np.array(out, dtype="float32"), 2, 0)


def unit(v: np.ndarray) -> np.ndarray:
    """Each row divided by its length; rows of zeros stay."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, np.float32(1))


def fingerprint(pixels: np.ndarray) -> dict:
    """Of images of one size, rows of RGB pixels each: histograms of 16 bins a channel, 8 by 8 grays, signs of horizontal
    steps, log proportion."""
    n, height, width = pixels.shape[:3]
    thumb = shrunk(pixels.astype("float32"), min(height, THUMB), min(width, THUMB)) if max(height, width) > THUMB else pixels
    bins = (thumb.astype(int) // 16).reshape(n, -1, 3) + 16 * np.arange(3) + 48 * np.arange(n)[:, None, None]
    color = np.bincount(bins.ravel(), minlength=48 * n).reshape(n, 48).astype("float32")
    gray = (pixels.astype("float32") @ np.array([0.299, 0.587, 0.114], dtype="float32"))[..., None]
    steps = shrunk(gray, 8, 9)[..., 0]
    return {
        "color": unit(color),
        "gray": unit(shrunk(gray, 8, 8).reshape(n, -1) + 1),
        "dhash": (steps[:, :, 1:] > steps[:, :, :-1]).reshape(n, -1),
        "aspect": np.full(n, math.log(max(width / max(height, 1), 0.05))),
    }


def _fingerprints(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Images of one size are taken together, about AT_ONCE bytes of them."""
    parts = ("color", "gray", "dhash", "aspect")
    out = {part: np.full(len(data), None, dtype=object) for part in parts}
    w, h = (pd.to_numeric(s).fillna(0).to_numpy(dtype="int64") for s in (width, height))
    good = (w > 0) & (h > 0) & (data.map(lambda raw: -1 if raw is None else len(raw)).to_numpy(dtype="int64") == 3 * w * h)
    for size, places in pd.Series(np.flatnonzero(good)).groupby([w[good], h[good]]):
        places, step = places.to_numpy(), max(1, AT_ONCE // int(3 * size[0] * size[1]))
        for some in (places[i : i + step] for i in range(0, len(places), step)):
            pixels = np.frombuffer(b"".join(data.iloc[some]), dtype="uint8").reshape(len(some), size[1], size[0], 3)
            for part, values in fingerprint(pixels).items():
                for place, value in zip(some, values):
                    out[part][place] = value
    return pd.DataFrame(out, columns=parts)


def fingerprints(data: Column, width: Column, height: Column) -> Column:
    """Of raw RGB bytes, row by row; null parts where the bytes don't fill the size."""
    return F.pandas_udf(_fingerprints, FINGERPRINT)(data, width, height)


def colourfulness(pixels: Column) -> Column:
    """How coloured an image is: the mean over its pixels (red, green, blue in a row, 0 to 255) of the span between a pixel's
    channels; 0 is grey, 1 pure colour, null none at all."""
    whole = F.filter(F.sequence(F.lit(0), F.greatest(F.size(pixels) - 1, F.lit(0))), lambda i: i % 3 == 0)
    span = lambda i: F.greatest(F.get(pixels, i), F.get(pixels, i + 1), F.get(pixels, i + 2)) - F.least(F.get(pixels, i), F.get(pixels, i + 1), F.get(pixels, i + 2))
    n = F.floor(F.size(pixels) / 3)
    return F.when(n > 0, F.aggregate(whole, F.lit(0.0), lambda s, i: s + span(i)) / (255 * n))


HEADER_BYTES = 384 * 1024  # fixed value: what is looked at of an image
SIZE = "struct<width:int,height:int>"
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height by the header of a PNG, GIF, JPEG or WebP image; None if it isn't one or ends before they are told."""
    head = (data or b"")[:HEADER_BYTES]
    big = lambda at, n: int.from_bytes(head[at : at + n], "big")
    little = lambda at, n: int.from_bytes(head[at : at + n], "little")
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return big(16, 4), big(20, 4)
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return little(6, 2), little(8, 2)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8X":
            return little(24, 3) + 1, little(27, 3) + 1
        if head[12:16] == b"VP8L" and head[20] == 0x2F:
            both = little(21, 4)
            return (both & 0x3FFF) + 1, (both >> 14 & 0x3FFF) + 1
        if head[12:16] == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
            return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(head) and head[at] == 0xFF:
            mark = head[at + 1]
            if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD7:  # fill, or a mark without a segment
                at += 1 if mark == 0xFF else 2
            elif mark in _FRAMES:
                return (big(at + 7, 2), big(at + 5, 2)) if at + 9 <= len(head) else None
            elif mark == 0xD9 or mark == 0xDA or big(at + 2, 2) < 2:
                return None
            else:
                at += 2 + big(at + 2, 2)
    return None


def header_sizes(content: Column) -> Column:
    """Width and height of binary images by the first HEADER_BYTES of each, or nulls. Only these bytes leave the JVM."""

    def run(values: pd.Series) -> pd.DataFrame:
        found = [header_size(v) or (None, None) for v in values]
        return pd.DataFrame({"width": pd.array([w for w, _ in found], "Int32"), "height": pd.array([h for _, h in found], "Int32")})

    return F.pandas_udf(run, SIZE)(F.substring(content, 1, HEADER_BYTES))
