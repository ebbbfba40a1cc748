"""Pieces of the SQL that checks queries."""

from __future__ import annotations

#: One row: table ``t`` of the 256 remainders of crc32.
BITS = """bits AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
         FROM range(256) r(b))"""


def crc32(key: str) -> str:
    """Unsigned crc32 of a column of ASCII characters, in a query that reads ``bits`` too."""
    codes = f"list_transform(range(1, length({key}) + 1), lambda i: ascii(substr({key}, i::INT, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, bits.t[xor(c, b) % 256 + 1])), 4294967295)"
