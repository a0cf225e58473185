"""CRC-32 in SQL for DuckDB, which has no function for it."""

from __future__ import annotations

#: A common table expression ``crc(t)``: the table of 256 remainders, made by their rule.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def crc32_sql(text: str, table: str = "t") -> str:
    """The unsigned CRC-32 of a text's UTF-8, where ``table`` is the column of ``CRC_TABLE``."""
    octets = f"list_transform(range(0, len(hex(encode({text}))) // 2), lambda crc_i: ('0x' || substr(hex(encode({text})), 2 * crc_i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda crc_c, crc_b: xor(crc_c // 256, {table}[xor(crc_c % 256, crc_b) + 1])), 4294967295)"
