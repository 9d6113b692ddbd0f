"""Names and object identifiers of X.509 certificates: a walk over the DER elements of the certificate's extensions, in an
Arrow-batched function on binary columns. Broken certificates have none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are read: alternative names, extended key usages, certificate policies; fixed values.
ALT_NAMES, USAGES, POLICIES = "2.5.29.17", "2.5.29.37", "2.5.29.32"
SEQUENCE, OID, OCTETS, EXTENSIONS, DNS_NAME = 0x30, 0x06, 0x04, 0xA3, 0x82
SCHEMA = "sans array<string>, oids array<string>"


def elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, content) of the elements that follow each other in data."""
    at = 0
    while at < len(data):
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n]), at + n
        if at + size > len(data):
            raise ValueError("an element is cut off")
        yield tag, data[at : at + size]
        at += size


def oid_text(data: bytes) -> str:
    """Dotted text of an object identifier: digits in base 128, the first two numbers in one."""
    numbers, n = [], 0
    for byte in data:
        n = n << 7 | byte & 0x7F
        if not byte & 0x80:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def names_and_oids(der: bytes | None) -> tuple[list[str], list[str]]:
    """DNS names in order, and the identifiers of all extensions, key usages and policies, sorted, each once."""
    sans: list[str] = []
    oids: set[str] = set()
    try:
        [(_, whole)] = elements(der or b"")
        body = next(elements(whole))[1]
        wrapped = next((x for tag, x in elements(body) if tag == EXTENSIONS), b"")
        for _, listed in elements(wrapped):
            for _, extension in elements(listed):
                parts = list(elements(extension))
                name, value = oid_text(parts[0][1]), next(x for tag, x in parts if tag == OCTETS)
                oids.add(name)
                for _, inner in elements(value) if name in (ALT_NAMES, USAGES, POLICIES) else ():
                    for tag, x in elements(inner):
                        if name == ALT_NAMES and tag == DNS_NAME:
                            sans.append(x.decode("ascii", "replace"))
                        elif name == USAGES and tag == OID:
                            oids.add(oid_text(x))
                        elif name == POLICIES and tag == SEQUENCE:
                            oids.add(oid_text(next(elements(x))[1]))
    except (ValueError, IndexError, StopIteration):
        return [], []
    return list(dict.fromkeys(sans)), sorted(oids)


def parse_batch(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([names_and_oids(x if isinstance(x, bytes) else None) for x in s], columns=["sans", "oids"])


def certificate_names(der: Column | str) -> Column:
    """struct(sans, oids) of a certificate in DER."""
    return F.pandas_udf(parse_batch, SCHEMA)(der)
