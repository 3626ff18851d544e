"""Column expressions for little-endian integers, domain-separated digests and version tokens; the canonical value codec."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = "keyloom"


def u64_le(x: Column) -> Column:
    """The eight bytes of a non-negative long, little-endian."""
    big = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, k, 2) for k in range(15, 0, -2)]))


def u64_from_le(x: Column) -> Column:
    """The number in the first eight bytes, little-endian; null with fewer bytes or from 2 ** 63 on."""
    h = F.hex(x)
    big = F.concat(*[F.substring(h, k, 2) for k in range(15, 0, -2)])
    return F.when(F.octet_length(x) >= 8, F.conv(big, 16, 10).try_cast("long"))


def digest(kind: str, *parts: Column) -> Column:
    """SHA-256 (lower hex) over the domain, a zero byte, and the parts as text with '|' between them."""
    body = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.sha2(F.concat(F.lit(f"{DOMAIN}:{kind}:"), body).cast("binary"), 256)


def checked_end(offset: Column, length: Column, size: Column) -> Column:
    """offset + length, or an error: a negative number, a sum beyond a long, or an end beyond size."""
    end = F.try_add(offset, length)
    good = (offset >= 0) & (length >= 0) & end.isNotNull() & (end <= size)
    return F.when(F.coalesce(good, F.lit(False)), end).otherwise(F.raise_error(F.lit("a range is out of bounds")).cast("long"))


def identity(label: Column) -> Column:
    """A snapshot's identity from its label."""
    return digest("snapshot", label)


def is_strong_token(x: Column) -> Column:
    """Quoted, nothing quoted inside, not weak."""
    return F.coalesce(x.rlike(r'^"[^"]*"$'), F.lit(False))


def encode_value(value) -> bytes:
    """Canonical bytes of None, bool, unsigned int, bytes, str, list or dict: a major type and length head, then the content;
    map entries in the order of their encoded keys (shorter first, then bytewise)."""
    def head(major: int, n: int) -> bytes:
        for limit, code, form in ((24, None, ""), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
            if n < limit:
                return bytes([major << 5 | n]) if code is None else bytes([major << 5 | code]) + struct.pack(form, n)
        raise ValueError("integer out of range")

    if value is None:
        return b"\xf6"
    if value is True or value is False:
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        if value < 0:
            raise ValueError("integer out of range")
        return head(0, value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return head(4, len(value)) + b"".join(map(encode_value, value))
    if isinstance(value, dict):
        if any(type(k) not in (int, bytes, str) for k in value):
            raise TypeError("keys are integers, bytes or text")
        entries = sorted(((encode_value(k), encode_value(v)) for k, v in value.items()), key=lambda e: (len(e[0]), e[0]))
        return head(5, len(entries)) + b"".join(k + v for k, v in entries)
    raise TypeError(type(value).__name__)


def decode_value(data: bytes, depth: int = 64):
    """The value of canonical bytes; anything not canonical (order, length form, trailing bytes) is an error."""
    value, at = _decode(data, 0, depth)
    if at != len(data):
        raise ValueError("trailing bytes")
    return value


def _decode(data: bytes, at: int, depth: int):
    if depth == 0 or at >= len(data):
        raise ValueError("too deep or truncated")
    major, n, at = data[at] >> 5, data[at] & 31, at + 1
    if major == 7:
        if n not in (20, 21, 22):
            raise ValueError("unsupported simple value")
        return {20: False, 21: True, 22: None}[n], at
    if n >= 24:
        size = {24: 1, 25: 2, 26: 4, 27: 8}.get(n)
        if size is None or at + size > len(data):
            raise ValueError("bad length")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if n < (24 if size == 1 else 1 << (4 * size)):
            raise ValueError("length not in its shortest form")
    if major == 0:
        return n, at
    if major in (2, 3):
        if at + n > len(data):
            raise ValueError("truncated")
        raw = data[at : at + n]
        return (raw.decode() if major == 3 else raw), at + n
    if major == 4:
        out = []
        for _ in range(n):
            x, at = _decode(data, at, depth - 1)
            out.append(x)
        return out, at
    if major == 5:
        out, last = {}, None
        for _ in range(n):
            start = at
            k, at = _decode(data, at, depth - 1)
            if type(k) not in (int, bytes, str):
                raise ValueError("unsupported key")  # 1 and true would be one key, and a list is none
            key = (at - start, data[start:at])
            if last is not None and key <= last:
                raise ValueError("keys out of order or repeated")
            last = key
            out[k], at = _decode(data, at, depth - 1)
        return out, at
    raise ValueError("unsupported type")
