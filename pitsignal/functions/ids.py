"""Deterministic identifiers as SQL expressions."""

from __future__ import annotations

# Fixed value: the RFC 4122 URL namespace.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

_PLAIN = r"^[ !#-\x5B\x5D-~]*\z"


def json_string(col: str) -> str:
    """The JSON text of a string with non-ASCII characters escaped."""
    hex4 = lambda n: f"concat('\\\\u', lpad(lower(hex({n})), 4, '0'))"
    code = "ascii(ch)"
    # Code points beyond the basic plane are written as a surrogate pair.
    pair = f"concat({hex4(f'55296 + (({code} - 65536) div 1024)')}, {hex4(f'56320 + (({code} - 65536) % 1024)')})"
    escaped = (
        f"case when ch = '' then '' when ch = '\"' then '\\\\\"' when ch = '\\\\' then '\\\\\\\\' "
        f"when {code} = 10 then '\\\\n' when {code} = 13 then '\\\\r' when {code} = 9 then '\\\\t' "
        f"when {code} = 8 then '\\\\b' when {code} = 12 then '\\\\f' "
        f"when {code} between 32 and 126 then ch when {code} < 65536 then {hex4(code)} else {pair} end")
    chars = f"transform(sequence(1, greatest(length({col}), 1)), i -> substring({col}, i, 1))"
    slow = f"array_join(transform({chars}, ch -> {escaped}), '')"
    return f"concat('\"', if({col} rlike r'{_PLAIN}', {col}, {slow}), '\"')"


def json_list(cols: list[str]) -> str:
    return f"concat('[', concat_ws(', ', {', '.join(json_string(c) for c in cols)}), ']')"


def uuid5_hex(name: str, namespace: str = URL_NAMESPACE) -> str:
    """Name-based (SHA-1) UUID of a string expression, as 32 hex digits."""
    digest = f"sha1(concat(unhex('{namespace}'), cast({name} as binary)))"
    variant = "substr('89ab', cast(conv(substr(h, 17, 1), 16, 10) as int) % 4 + 1, 1)"
    build = f"concat(substr(h, 1, 12), '5', substr(h, 14, 3), {variant}, substr(h, 18, 15))"
    return f"transform(array({digest}), h -> {build})[0]"


def signal_id(cols: list[str]) -> str:
    return f"concat('sig-', {uuid5_hex(json_list(cols))})"


def content_hash(text: str = "raw_text") -> str:
    return f"concat('sha256:', sha2({text}, 256))"
