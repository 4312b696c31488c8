"""Long texts made short: logs and repeated lines cut, blocks of code and logs thinned; code measured."""

from __future__ import annotations

import difflib
import math
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import jsontree as J

#: A text is shrunk from this length and this many lines on.
LEAST_CHARS, LEAST_LINES = 1024, 8
#: Runs of this many lines of one kind are thinned, outside so many characters at either end.
RUN, GUARD = 8, 512
#: The share of a run that is kept, from its top, middle and bottom.
KEEP = 0.10

_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\d{2}:\d{2}:\d{2}\b|\[?(?:INFO|DEBUG|WARN(?:ING)?|ERROR|TRACE|FATAL)\b|at [\w.$<>]+\(|File \"[^\"]+\", line \d+|Traceback \(most|[\w.]+(?:Error|Exception)\b:|\.\.\. \d+ more|npm (?:ERR|WARN)|>\s)")
_CODE = re.compile(r"(?:[{};]|\)\s*:|=>|\\)\s*$|^\s*(?:def|class|import|from|return|if|for|while|else|elif|try|except|const|let|var|function|func|public|private|static|package|use|#include|SELECT|INSERT|@\w+|//|#|/\*|\*)\b|^\s*[\w.]+\s*(?:=|\+=|:=)\s*\S|^\s*</?\w+[^>]*>\s*$")
_EMOJI = re.compile("[\U0001f300-\U0001faff☀-➿️]+ ?")


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text))) if n else 0.0


#: The features of a line, in order.
LINE_FEATURES = ("entropy", "digit_ratio", "punctuation_ratio", "leading_space_ratio", "repetition_ratio", "mean_word_length", "long_word_ratio", "shape_entropy", "symbol_ratio")


def line_features(line: str | None) -> tuple[float, ...]:
    """LINE_FEATURES of a line, shares of its characters or words; all 0 for NULL and ''. Long words have over 8 characters; a shape is a letter, digit, blank or symbol."""
    s = line or ""
    n, words = len(s), s.split()
    if not n:
        return (0.0,) * len(LINE_FEATURES)
    shape = "".join("A" if c.isalpha() else "D" if c.isdigit() else "_" if c.isspace() else "S" for c in s)
    twice = sum(a == b for a, b in zip(s, s[1:])) / (n - 1) if n > 1 else 0.0
    w = max(len(words), 1)
    return (entropy(s), shape.count("D") / n, sum(c in string.punctuation for c in s) / n, (n - len(s.lstrip())) / n, twice, sum(map(len, words)) / w, sum(len(x) > 8 for x in words) / w, entropy(shape), sum(not c.isalnum() and not c.isspace() for c in s) / n)


def features_column(line: Column) -> Column:
    """Struct of LINE_FEATURES of a text column, in Arrow batches."""

    @F.pandas_udf(", ".join(f"{name} double" for name in LINE_FEATURES))
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([line_features(x) for x in s], columns=list(LINE_FEATURES))

    return made(line)


def line_kind(line: str) -> str:
    """code, logs, text or none of a line, by its shape: a rule in place of a trained model."""
    s = line.strip()
    if not s:
        return "none"
    if _LOG.search(line):
        return "logs"
    letters = sum(c.isalpha() or c == " " for c in s) / len(s)
    if _CODE.search(line) or letters < 0.6 or line.startswith(("    ", "\t")) and letters < 0.85:
        return "code"
    return "text" if len(s.split()) > 2 or s[-1] in ".!?:" else "none"


def cut_repeats(text: str, most: int = 5) -> str:
    """text with runs of more than most log lines, or of lines that differ in digits only, cut to two, a mark and two."""
    out: list[str] = []
    run: list[str] = []
    shape = lambda x: re.sub(r"\d+", "0", x.strip())

    def end() -> None:
        out.extend([*run[:2], f"[... {len(run) - 4} lines ...]", *run[-2:]] if len(run) > most else run)
        run.clear()

    for line in text.split("\n"):
        same = run and (shape(line) == shape(run[-1]) and line.strip() or line_kind(line) == line_kind(run[-1]) == "logs")
        if not same:
            end()
        run.append(line)
    end()
    return _EMOJI.sub("", "\n".join(out))


def shrunk(text: str | None) -> str | None:
    """text with long runs of code, logs or shapeless lines thinned to a tenth, its beginning and end untouched; shorter texts stay."""
    if text is None or len(text) < LEAST_CHARS or text.count("\n") + 1 < LEAST_LINES:
        return text
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    kinds = [line_kind(x) if starts[i] >= GUARD and starts[i + 1] <= len(text) - GUARD else "guard" for i, x in enumerate(lines)]
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and (kinds[j] == kinds[i] or kinds[j] in ("code", "logs", "none") and kinds[i] in ("code", "logs", "none")):
            j += 1
        n = j - i
        if kinds[i] in ("code", "logs", "none") and n >= RUN:
            k = max(1, round(n * KEEP))
            keep = sorted({*range(i, i + k), *range(i + (n - k) // 2, i + (n - k) // 2 + k), *range(j - k, j)})
            last = i - 1
            for at in keep:
                if at > last + 1:
                    out.append(f"[... {at - last - 1} lines ...]")
                out.append(lines[at])
                last = at
        else:
            out += lines[i:j]
        i = j
    return "\n".join(out)


def _mapped(f, text: Column, kind: str = "string") -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([f(t) for t in s], dtype=object)

    return run(text)


def shrunk_column(text: Column) -> Column:
    return _mapped(shrunk, text)


def without_logs(text: Column) -> Column:
    return _mapped(lambda t: t if t is None else cut_repeats(t), text)


_BRANCH = re.compile(r"\b(?:if|elif|for|while|case|catch|except|when|and|or)\b|&&|\|\||\?(?!\?)")


def code_measure(code: str | None) -> tuple[int, float, int]:
    """(lines of code, complexity, tokens): non-blank lines that aren't comments, branches plus one per function, words and signs."""
    if not code or not code.strip():
        return 0, 0.0, 0
    lines = [x for x in (y.strip() for y in code.split("\n")) if x and not x.startswith(("#", "//", "--", "/*", "*", '"""'))]
    body = "\n".join(lines)
    functions = max(1, len(re.findall(r"\b(?:def|function|func|fn)\b|=>", body)))
    return len(lines), round((len(_BRANCH.findall(body)) + functions) / functions, 3), len(re.findall(r"\w+|[^\w\s]", body))


def diff_counts(before: str | None, after: str | None) -> tuple[int, int]:
    """(added, removed) lines between two texts."""
    a, b = (before or "").splitlines(), (after or "").splitlines()
    added = removed = 0
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag != "equal":
            removed += i2 - i1
            added += j2 - j1
    return added, removed


def edit_metrics(before: Column, after: Column) -> Column:
    """Struct(lines_added, lines_removed, nloc, complexity): what an edit changes."""

    @F.pandas_udf("lines_added int, lines_removed int, nloc int, complexity double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            (n0, c0, _), (n1, c1, _) = code_measure(x), code_measure(y)
            rows.append((*diff_counts(x, y), n1 - n0, round(c1 - c0, 3)))
        return pd.DataFrame(rows, columns=["lines_added", "lines_removed", "nloc", "complexity"])

    return run(before, after)


def text_column(json: Column, form: str = "coerced") -> Column:
    """jsontree.coerced or flattened of JSON text, in Arrow batches; NULL for NULL and for text that isn't JSON."""
    shape = {"coerced": J.coerced, "flattened": J.flattened}[form]

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else J.clean(shape(J.parse(text)))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([one(t) for t in s], dtype=object)

    return made(json)
