"""What the DuckDB texts of several operators share: CRC-32, which DuckDB has no function for."""

from __future__ import annotations

#: A table of one row whose ``crc_table`` holds the 256 remainders of CRC-32, to be in the FROM of what calls ``crc32``.
CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table) AS crc_tables"


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of the SQL expression ``text``."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
