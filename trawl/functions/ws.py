"""Python's whitespace set, spelled for the Java regex engine (and for RE2 in oracle SQL).

Python's ``str.split()``/``str.strip()``/``re`` ``\\s`` treat exactly these code points as
whitespace. Java's ``\\s`` misses NBSP and ``(?U)\\s`` misses ``\\x1c``–``\\x1f``, so the
class is spelled out.
"""

# Python's whitespace code points.
WS_CLASS = (
    "\\t-\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)
WS = f"[{WS_CLASS}]"
NON_WS = f"[^{WS_CLASS}]"

# The same set as characters, for ``F.trim``.
WS_CHARS = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# The same set in RE2 syntax (DuckDB oracle SQL).
WS_CLASS_RE2 = (
    "\\t-\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
    "\\x{202f}\\x{205f}\\x{3000}"
)
