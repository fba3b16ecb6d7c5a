"""CRC-32 of a string in DuckDB SQL, which has no function for it."""

from __future__ import annotations


def _steps() -> list[int]:
    table = []
    for n in range(16):
        c = n
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


def crc32_sql(string: str) -> str:
    """A BIGINT expression: the unsigned CRC-32 of the UTF-8 bytes of ``string``."""
    table = "[" + ", ".join(f"{n}::BIGINT" for n in _steps()) + "]"
    places = f"list_transform(range(2 * strlen({string})), lambda k: CASE WHEN k % 2 = 0 THEN k + 2 ELSE k END)"
    halves = f"list_transform({places}, lambda p: (strpos('0123456789ABCDEF', substr(hex(encode({string})), p, 1)) - 1)::BIGINT)"
    step = f"xor({table}[(xor(c, h) & 15) + 1], c >> 4)"
    return f"xor(list_reduce({halves}, lambda c, h: {step}, 4294967295::BIGINT), 4294967295)"
