"""Functions on bytes that no built-in expression has: the favicon hash and charset decoding, Arrow-batched."""

import base64
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

META_CHARSET = re.compile(rb"""<meta[^>]*charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, x86, 32 bits, as a signed number."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: (x << r | x >> 32 - r) & mask
    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (turn(h ^ turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    if data[whole:]:
        h ^= turn(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def icon_hash(data: bytes | None) -> int | None:
    """The hash that search engines for hosts use: of the base64 text in lines of 76, each ended."""
    return None if data is None else murmur3(base64.encodebytes(data))


def decoded(data: bytes | None, content_type: str | None) -> str | None:
    """Text of a body: by the content type's charset, else a byte order mark, else a meta tag in the first 1024 bytes, else UTF-8."""
    if data is None:
        return None
    named = re.search(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", content_type or "", re.I)
    mark = next(((m, c) for m, c in MARKS if data.startswith(m)), None)
    meta = META_CHARSET.search(data[:1024])
    charset = named.group(1) if named else mark[1] if mark else meta.group(1).decode("ascii", "replace") if meta else "utf-8"
    body = data[len(mark[0]) :] if mark else data
    try:
        return body.decode("cp1252" if charset.lower() in ("iso-8859-1", "latin1", "ascii", "us-ascii") else charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def icon_batch(s: pd.Series) -> pd.Series:
    return s.map(icon_hash).astype("Int32")


def decode_batch(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([decoded(d, k) for d, k in zip(data, kind, strict=True)])


def favicon_hash(data: Column | str) -> Column:
    return F.pandas_udf(icon_batch, "int")(data)


def decode_body(data: Column | str, content_type: Column | str) -> Column:
    return F.pandas_udf(decode_batch, "string")(data, content_type)


def favicon_url(page: Column | str, href: Column | str) -> Column:
    """Where a page's icon is: what it links to, or /favicon.ico of its host."""
    from webstrata.functions.domains import url_join

    return F.coalesce(url_join(page, href), url_join(page, F.lit("/favicon.ico")))
