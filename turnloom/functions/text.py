"""Text and name normalisers as Spark expressions: tokens, paths, languages, models, tools, lines."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings and their languages.
LANGUAGES = {
    "py": "python", "pyw": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "scala": "scala",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "r": "r", "lua": "lua", "pl": "perl",
    "sh": "shell", "bash": "shell", "ps1": "powershell", "sql": "sql", "html": "html", "css": "css", "scss": "scss", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown", "vue": "vue", "dart": "dart", "ex": "elixir",
}
#: Tool names without punctuation, and their categories.
TOOLS = {
    "read": "Read", "notebookread": "Read", "copilotreadfile": "Read", "edit": "Edit", "multiedit": "Edit", "notebookedit": "Edit", "strreplace": "Edit", "copilotreplacestring": "Edit", "write": "Write", "copilotcreatefile": "Write",
    "bash": "Bash", "shell": "Bash", "copilotruninterminal": "Bash", "grep": "Grep", "copilotsearchfiles": "Grep", "copilotfindtextinfiles": "Grep", "glob": "Glob", "ls": "Glob", "copilotlistdir": "Glob",
    "task": "Task", "agent": "Task", "runsubagent": "Task", "managetodolist": "Task", "skill": "Tool", "todoread": "Tool", "todowrite": "Tool", "webfetch": "Tool", "websearch": "Tool",
}
#: Parts of a name that tell its category, in the order in which they count.
TOOL_PARTS = (
    ("Read", ("read", "openfile", "loadfile")), ("Edit", ("edit", "replace", "patch", "diff")), ("Write", ("write", "createfile")), ("Bash", ("bash", "shell", "terminal", "command")),
    ("Grep", ("grep", "search", "findtext")), ("Glob", ("glob", "listdir", "ls", "tree")), ("Task", ("task", "subagent", "agent")), ("Tool", ("skill", "tool", "todo")),
)


#: White space of any kind, as a class of characters.
SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def tokens(text: Column) -> Column:
    """An estimate of a text's tokens: four characters each, at least one; 0 for NULL and ''."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def tool_category(name: Column) -> Column:
    """The category of a tool by its name; of a server's tools (mcp..__..) the last part counts. Other for NULL and ''."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    short = F.when(plain(name).startswith("mcp") & name.contains("__"), plain(F.element_at(F.split(name, "__"), -1))).otherwise(plain(name))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv]), short)
    parts = reduce(lambda rest, p: F.when(short.rlike("|".join(p[1])), p[0]).otherwise(rest), reversed(TOOL_PARTS), F.lit("Other"))
    return F.when(F.coalesce(short, F.lit("")) == "", "Other").otherwise(F.coalesce(exact, parts))


def model_name(model: Column) -> Column:
    """A model id without its date, -preview and -latest; '' and NULL stay."""
    m = F.lower(F.trim(model))
    base = F.regexp_replace(F.regexp_replace(m, "-[0-9]{6,}.*$", ""), "-(preview|latest)$", "")
    return F.when(F.coalesce(base, F.lit("")) == "", model).otherwise(base)


def path(p: Column) -> Column:
    """A path with forward slashes and a lower-case drive, without the slash before a drive."""
    s = F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/([A-Za-z]:)", "$1")
    return F.when(s.rlike("^[A-Za-z]:"), F.concat(F.lower(F.substring(s, 1, 1)), F.call_function("substring", s, F.lit(2)))).otherwise(s)


def language(p: Column) -> Column:
    """The language of a path by its ending; NULL for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)))


def distinct_lines(text: Column) -> Column:
    """text without lines that repeat the line before."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1))), "\n")


def spaced(text: Column) -> Column:
    """text with LF line ends, no blanks at line ends and at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "[ \\t]+\n", "\n"), "\n{3,}", "\n\n")


def three_slices(text: Column, size: int = 2048) -> Column:
    """The first 40, middle 20 and last 40 percent of size characters of a longer text, joined by a mark."""
    n, head, middle = F.length(text), size * 2 // 5, size // 5
    mid = F.substring(text, F.floor((n - middle) / 2).cast("int") + 1, F.lit(middle))
    return F.when(text.isNull() | (n <= size), text).otherwise(F.concat_ws("\n[...]\n", F.substring(text, 1, head), mid, F.right(text, F.lit(head))))


def diff_lines(text: Column, sign: str) -> Column:
    """The number of lines that a unified diff adds (+) or removes (-), without its file headers."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))


def digest(text: Column) -> Column:
    """sha256 of the text without white space at its ends: tells whether a text has changed since it was embedded."""
    return F.sha2(trimmed(text), 256)


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


@lru_cache(maxsize=1)
def _marked() -> tuple[str, str]:
    """Characters that hold a mark, and what they are without it."""
    pairs = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        bare = unicodedata.normalize("NFC", "".join(p for p in parts if not unicodedata.category(p).startswith("M")))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """text in lower case and without accents and other marks, as words are compared."""
    before, after = _marked()
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, before, after), r"\p{M}+", "")).otherwise(low)


def words(text: Column) -> Column:
    """The words of a text in order: runs of letters and digits of any script, folded."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")


def words_of(text: str) -> tuple[str, ...]:
    """words() of a single text."""
    parts = unicodedata.normalize("NFD", text.lower())
    bare = unicodedata.normalize("NFC", "".join(c for c in parts if not unicodedata.category(c).startswith("M")))
    return tuple("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in bare).split())


def iso_of(ms: Column) -> Column:
    """An instant in milliseconds as ISO 8601 in UTC, the fraction only where there is one; '' for NULL."""
    whole = F.date_format(F.timestamp_seconds(F.floor(ms / 1000)), "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(ms, F.lit(1000))
    return F.when(ms.isNull(), "").otherwise(F.concat(whole, F.when(rest != 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"), F.lit("000"))).otherwise(""), F.lit("+00:00")))


def uri_path(uri: Column) -> Column:
    """The path of a file: URI, percent signs read; other texts stay."""
    body = F.regexp_replace(uri, "^file://", "")
    return F.when(uri.startswith("file://"), path(F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))))).otherwise(uri)


def remote_parts(uri: Column) -> Column:
    """Struct(kind, host, path) of a remote workspace's URI, NULL for another."""
    s = F.regexp_replace(uri, "%2B", "+")
    part = lambda i: F.regexp_extract(s, r"^vscode-remote://([A-Za-z-]+)\+([^/]+)(/.*)?$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("kind"), part(2).alias("host"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("/")).alias("path")))


def identity(folder: Column, id_: Column) -> Column:
    """The key by which workspaces are one: folder:<folder in one form>, else id:<id>."""
    s = F.lower(F.regexp_replace(F.replace(folder, F.lit("\\"), F.lit("/")), "/+$", ""))
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit("folder:"), s)).otherwise(F.concat(F.lit("id:"), id_))


def snippet(text: Column, size: int = 160) -> Column:
    """The first size characters on one line, with three dots where there is more."""
    s = F.regexp_replace(text, "[\\r\\n]+", " ")
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size), F.lit("..."))).otherwise(s)


def folder_id(p: Column) -> Column:
    """A folder as the id that logs are kept under: every separator a dash."""
    return F.regexp_replace(p, r"[:/\\.]", "-")
