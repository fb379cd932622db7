"""Order-preserving encodings and byte functions."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_u64(value: int) -> bytes:
    """One to nine bytes that sort like the number: ones in front count the bytes that follow."""
    if not 0 <= value < 1 << 64:
        raise ValueError("not an unsigned 64-bit number")
    for extra in range(8):
        if value < 1 << (7 * (extra + 1)):
            head = (0xFF << (8 - extra)) & 0xFF
            return (value | head << (8 * extra)).to_bytes(extra + 1, "big")
    return b"\xff" + value.to_bytes(8, "big")


def decode_u64(data: bytes) -> tuple[int, int]:
    """The number and how many bytes it took."""
    extra = 8
    for n in range(8):
        if not data[0] & (0x80 >> n):
            extra = n
            break
    if len(data) <= extra:
        raise ValueError("the encoding is cut off")
    head = data[0] & (0x7F >> extra) if extra < 8 else 0
    return head << (8 * extra) | int.from_bytes(data[1 : extra + 1], "big"), extra + 1


def encode_bytes(data: bytes) -> bytes:
    """Seven bits a byte, the lowest bit telling that more follow, so that no string's encoding is a prefix of another's and order is kept."""
    if not data:
        return b"\0"
    n = len(data) * 8
    groups = -(-n // 7)
    bits = int.from_bytes(data, "big") << (groups * 7 - n)
    body = [(bits >> (7 * (groups - 1 - i)) & 0x7F) << 1 | 1 for i in range(groups)]
    return bytes(body) + b"\0"


def decode_bytes(data: bytes) -> tuple[bytes, int]:
    """The string and how many bytes its encoding took."""
    groups = []
    for at, b in enumerate(data):
        if not b & 1:
            n = len(groups) * 7
            bits = 0
            for g in groups:
                bits = bits << 7 | g
            size = n // 8
            return (bits >> (n - size * 8)).to_bytes(size, "big"), at + 1
        groups.append(b >> 1)
    raise ValueError("the encoding is cut off")


def encode_tuple(*values) -> bytes:
    """Numbers, byte strings and UUIDs (16 bytes, big-endian), one to four, so that encodings sort like the tuples."""
    if not 1 <= len(values) <= 4:
        raise ValueError("a tuple has one to four elements")
    code = lambda v: encode_u64(v) if isinstance(v, int) else v.bytes if isinstance(v, UUID) else encode_bytes(v)
    return b"".join(map(code, values))


def decode_tuple(data: bytes, kinds: tuple[type, ...], prefix: bool = False) -> tuple:
    """The elements by their types (int, bytes, UUID); more bytes than they take are an error, unless a prefix is asked for."""
    out, at = [], 0
    for kind in kinds:
        if kind is UUID:
            if len(data) < at + 16:
                raise ValueError("the encoding is cut off")
            value, n = UUID(bytes=data[at : at + 16]), 16
        else:
            value, n = (decode_u64 if kind is int else decode_bytes)(data[at:]) if data[at:] else (None, None)
            if n is None:
                raise ValueError("the encoding is cut off")
        out.append(value)
        at += n
    if at < len(data) and not prefix:
        raise ValueError("bytes are left over")
    return tuple(out)


def u64_length(coded: Column) -> Column:
    """Hex digits of the number encoded at the start of a hex string."""
    first = F.conv(F.substr(coded, F.lit(1), F.lit(2)), 16, 10).cast("int")
    out = F.lit(18)
    for extra in range(7, -1, -1):
        out = F.when(first < 256 - (1 << (7 - extra)), 2 * (extra + 1)).otherwise(out)
    return out


def u64_from_hex(coded: Column) -> Column:
    """The number encoded at the start of a hex string, for those that fit a long."""
    first, out = F.conv(F.substr(coded, F.lit(1), F.lit(2)), 16, 10).cast("int"), F.conv(F.substr(coded, F.lit(3), F.lit(16)), 16, 10).cast("long")
    for extra in range(7, -1, -1):
        head = (0xFF << (8 - extra)) & 0xFF
        rest = F.coalesce(F.conv(F.substr(coded, F.lit(3), F.lit(2 * extra)), 16, 10).cast("long"), F.lit(0)) if extra else F.lit(0)
        out = F.when(first < 256 - (1 << (7 - extra)), F.shiftleft((first - head).cast("long"), 8 * extra) + rest).otherwise(out)
    return out


def shortest_between(a: bytes, b: bytes) -> bytes | None:
    """A short key strictly between two keys, in either order; None if they are equal or nothing lies between."""
    low, high = sorted((a, b))
    shared = 0
    while shared < len(low) and low[shared] == high[shared]:
        shared += 1
    if shared == len(high):
        return None
    top = high[shared]
    if shared == len(low):  # the lower key is a prefix of the higher
        return low + bytes([top // 2]) if top else None
    bottom = low[shared]
    if top - bottom == 1:  # no byte between: go on behind the lower key
        return low + b"\x7f"
    return low[:shared] + bytes([bottom + (top - bottom) // 2])


def shortest_between_hex(a: Column, b: Column) -> Column:
    """``shortest_between`` of two hex strings (upper case) as an expression."""
    low, high = F.least(a, b), F.greatest(a, b)
    shared = shared_prefix_bytes(low, high)
    byte = lambda x: F.conv(F.substr(x, 2 * shared + 1, F.lit(2)), 16, 10).cast("int")
    coded = lambda v: F.lpad(F.hex(v), 2, "0")
    bottom, top = byte(low), byte(high)
    half = F.floor((top - bottom) / 2).cast("int")
    behind = F.when(top > 0, F.concat(low, coded(F.floor(top / 2).cast("int"))))
    inside = F.when(top - bottom == 1, F.concat(low, F.lit("7F"))).otherwise(F.concat(F.substr(low, F.lit(1), 2 * shared), coded(bottom + half)))
    return F.when(a.isNull() | b.isNull() | (a == b), F.lit(None)).when(F.length(low) == 2 * shared, behind).otherwise(inside)


def bytes_hex(value: Column) -> Column:
    """``encode_bytes`` of a hex string, in hex, as an expression: the bits in groups of seven, each with a one behind, and a zero byte."""
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value) / 2).cast("int")), lambda i: F.lpad(F.conv(F.substr(value, 2 * i - 1, F.lit(2)), 16, 2), 8, "0"))
    groups = F.ceil(F.length(value) * 4 / 7).cast("int")
    bits = F.rpad(F.array_join(octets, ""), 7 * groups, "0")
    coded = F.transform(F.sequence(F.lit(1), groups), lambda i: F.lpad(F.conv(F.concat(F.substr(bits, 7 * i - 6, F.lit(7)), F.lit("1")), 2, 16), 2, "0"))
    return F.when(F.length(value) == 0, "00").when(value.isNotNull(), F.concat(F.array_join(coded, ""), F.lit("00")))


def u64_hex(value: Column) -> Column:
    """``encode_u64`` in hex as an expression, for longs that aren't negative."""
    out = F.concat(F.lit("FF"), F.lpad(F.hex(value), 16, "0"))
    for extra in range(7, -1, -1):
        head = (0xFF << (8 - extra)) & 0xFF
        # the first byte holds the head's ones and what is left of the number
        top = F.shiftright(value, 8 * extra) + F.lit(head)
        low = F.lpad(F.hex(value), 16, "0")
        here = F.concat(F.lpad(F.hex(top), 2, "0"), F.substr(low, F.lit(17 - 2 * extra), F.lit(2 * extra))) if extra else F.lpad(F.hex(value), 2, "0")
        limit = 1 << (7 * (extra + 1))
        out = F.when(value < F.lit(limit if limit < 1 << 63 else (1 << 63) - 1), here).otherwise(out)
    return out


def byte_width(value: Column) -> Column:
    """Bytes that a number takes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.hex(value), "^0+", "")) / 2)).cast("int")


def shared_prefix_bytes(a: Column, b: Column) -> Column:
    """Bytes that two hex strings share in front."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.length(a), F.length(b)) / 2 - 1).cast("int"))
    differ = F.filter(places, lambda i: F.substr(a, 2 * i + 1, F.lit(2)) != F.substr(b, 2 * i + 1, F.lit(2)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.array_min(differ), (F.least(F.length(a), F.length(b)) / 2).cast("int")))


def front_coded(keys: list[bytes]) -> list[tuple[int, bytes]]:
    """Sorted keys as (bytes shared with the key before, rest)."""
    out, before = [], b""
    for k in sorted(set(keys)):
        n = 0
        while n < min(len(k), len(before)) and k[n] == before[n]:
            n += 1
        out.append((n, k[n:]))
        before = k
    return out


def front_decoded(coded: list[tuple[int, bytes]]) -> list[bytes]:
    out, before = [], b""
    for n, rest in coded:
        before = before[:n] + rest
        out.append(before)
    return out
