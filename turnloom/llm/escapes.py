"""Text inside JSON strings, read without its escapes, with the way back to the original positions."""

from __future__ import annotations

import re

_ESCAPE = re.compile(r"\\+(?:[ntr\"'/]|u[0-9a-fA-F]{4})")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "/": "/"}


def has_escapes(text: str) -> bool:
    return _ESCAPE.search(text) is not None


def unescaped(text: str) -> tuple[str, list[int]]:
    """text with escapes (of any depth) as what they stand for, and where each character of it begins in text.

    The list has one more entry than the text has characters, so a span (a, b) lies at [at[a], at[b]).
    """
    out: list[str] = []
    at: list[int] = []
    done = 0
    for m in _ESCAPE.finditer(text):
        out.append(text[done : m.start()])
        at += range(done, m.start() + 1)
        body = m.group().lstrip("\\")
        if len(body) == 5:
            code = int(body[1:], 16)
            out.append(chr(code) if code > 0x1F and code != 0x5C and not 0xD800 <= code <= 0xDFFF else " ")
        else:
            out.append(_PLAIN[body])
        done = m.end()
    out.append(text[done:])
    at += range(done, len(text) + 1)
    return "".join(out), at
