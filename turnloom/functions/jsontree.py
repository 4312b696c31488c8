"""Strict JSON for trees of any depth, on the Python side of Arrow batches."""

from __future__ import annotations

import json
import re
import sys

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_STRING = json.decoder.scanstring


class Number(str):
    """A number by its own spelling: no precision is lost and no size is too large."""

    __slots__ = ()


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)


def _iterative(text: str) -> object:
    """The value of a text nested deeper than the recursive decoder goes."""
    end_of = lambda at: _SPACE.match(text, at).end()
    stack: list[list] = []  # [container, key or None]
    at = end_of(0)
    while True:
        ch = text[at : at + 1]
        if ch in ("{", "["):
            value: object = {} if ch == "{" else []
            at = end_of(at + 1)
            if text[at : at + 1] == ("}" if ch == "{" else "]"):
                at += 1
            else:
                stack.append([value, None])
                if ch == "{":
                    if text[at : at + 1] != '"':
                        raise ValueError("key expected")
                    stack[-1][1], at = _STRING(text, at + 1, True)
                    at = end_of(at)
                    if text[at : at + 1] != ":":
                        raise ValueError("colon expected")
                    at = end_of(at + 1)
                continue
        elif ch == '"':
            value, at = _STRING(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = Number(m.group()), m.end()
        else:
            for word, value in (("true", True), ("false", False), ("null", None)):
                if text.startswith(word, at):
                    at += len(word)
                    break
            else:
                raise ValueError("value expected")
        while True:
            at = end_of(at)
            if not stack:
                if at != len(text):
                    raise ValueError("more after the value")
                return value
            holder, key = stack[-1]
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            ch = text[at : at + 1]
            if ch == ",":
                at = end_of(at + 1)
                if key is not None:
                    if text[at : at + 1] != '"':
                        raise ValueError("key expected")
                    stack[-1][1], at = _STRING(text, at + 1, True)
                    at = end_of(at)
                    if text[at : at + 1] != ":":
                        raise ValueError("colon expected")
                    at = end_of(at + 1)
                break
            if ch != ("]" if key is None else "}"):
                raise ValueError("end expected")
            at += 1
            value = stack.pop()[0]


def parse(text: str) -> object:
    """The value of a JSON text; ValueError for anything else, NaN and Infinity included. Of equal keys the last counts."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _iterative(text)


def nested(text: str) -> object | None:
    """The array or object that a string's whole content is, else None."""
    s = text.strip(" \t\n\r")
    if len(s) < 2 or (s[0], s[-1]) not in (("{", "}"), ("[", "]")):
        return None
    try:
        return parse(s)
    except ValueError:
        return None


def pointer_step(key: str | int) -> str:
    """One step of a JSON Pointer (RFC 6901)."""
    return "/" + (str(key) if isinstance(key, int) else key.replace("~", "~0").replace("/", "~1"))


def scalar(value: object) -> str:
    """The JSON text of a scalar."""
    return str(value) if isinstance(value, Number) else json.dumps(value, ensure_ascii=False)


def clean(text: str) -> str:
    """text without lone surrogates, which no column can hold."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
    return text


assert sys.maxsize > 2**32


def coerced(value: object) -> str:
    """The text of a value of any nesting: of lists the texts of their members, a line each; of objects the first that isn't blank of text, value and content; scalars as they are written."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n".join(t for t in (coerced(v).strip() for v in value) if t)
    if isinstance(value, dict):
        return next((t for t in (coerced(value[k]).strip() for k in ("text", "value", "content") if k in value) if t), "")
    return str(value)


def flattened(value: object) -> str:
    """The text of a message's content: a string, a list of strings and of blocks (their text or thinking by their type, else value or content), or an object's first text that isn't blank."""
    said = lambda v: v if isinstance(v, str) and not isinstance(v, Number) and v.strip() else ""
    if isinstance(value, dict):
        return next((t for t in (said(value.get(k)) for k in ("text", "content", "value", "message", "output", "result")) if t), "")
    if not isinstance(value, list):
        return value if isinstance(value, str) and not isinstance(value, Number) else ""
    parts = []
    for v in value:
        if isinstance(v, dict):
            kind = str(v.get("type", "")).strip()
            own = kind if kind in ("text", "thinking") and isinstance(v.get(kind), str) else None
            parts.append(said(v[own]) if own else said(v.get("value")) or said(v.get("content")))
        else:
            parts.append(said(v))
    return "\n".join(p for p in parts if p)
