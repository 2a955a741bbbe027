"""DuckDB expressions that its functions lack."""

import zlib


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a SQL string, byte by byte through the table of the 256 single steps."""
    # the register after one byte, from its value for that byte alone: crc32 of one byte starts from all ones
    table = [zlib.crc32(bytes([b ^ 255])) ^ 0xFFFFFFFF ^ 0xFFFFFF for b in range(256)]
    listed = "[" + ",".join(map(str, table)) + "]::BIGINT[]"
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, ({listed})[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), {step}), 4294967295)"
