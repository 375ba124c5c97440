"""DuckDB SQL fragments that several oracles share."""

#: Lower-cases A-Z only.
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: A maximal run without space or U+0009-U+000D.
SPACED = r"[^\x20\x09-\x0D]+"
#: A maximal run of digits, a-z (after lower-casing) and code points from U+0080.
TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
