"""DuckDB expressions that several statements share."""

from __future__ import annotations


def _crc_unit(bit: int) -> int:
    """What one set bit of a byte adds to a CRC-32 (reflected polynomial 0xEDB88320)."""
    x = 1 << bit
    for _ in range(8):
        x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
    return x


def crc32(blob: str) -> str:
    """CRC-32 of a blob expression as an unsigned bigint: a fold over its bytes; a byte's term is the sum of its bits'."""
    step = "acc >> 8"
    for bit in range(8):
        step = f"xor({step}, ((xor(acc, b) >> {bit}) & 1) * {_crc_unit(bit)}::bigint)"
    read = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda p: ('0x' || p)::bigint)"
    return f"xor(coalesce(list_reduce(list_prepend(4294967295::bigint, {read}), lambda acc, b: {step}), 4294967295::bigint), 4294967295::bigint)"
