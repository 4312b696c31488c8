"""Predicates over turns, sessions, paths and workspaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_role(roles: list[str] | None, column: str = "role") -> Column:
    """Rows of these roles, in any case; every row for no roles."""
    return F.lower(F.coalesce(column, F.lit(""))).isin([r.lower() for r in roles]) if roles else F.lit(True)


def of_agent(agent: str | None, match: str = "equals", column: str = "agent_used") -> Column:
    """Rows of an agent: equal, contained in a list a+b, or as part of the name; every row for none or 'all'."""
    if not agent or agent.lower() == "all":
        return F.lit(True)
    c = F.lower(F.coalesce(column, F.lit("")))
    if match == "contains":
        return c.contains(agent.lower())
    return F.array_contains(F.split(c, r"\+"), agent.lower()) if match == "member" else c == agent.lower()


def in_workspace(folder: str | None, ids: list[str], id_column: str = "workspace_id", folder_column: str = "workspace_folder") -> Column:
    """Rows of the related ids, or of the folder in one form."""
    by_id = F.coalesce(F.col(id_column).isin(ids), F.lit(False)) if ids else F.lit(False)
    return by_id | F.coalesce(plain_folder(F.col(folder_column)) == F.lit(folder.replace("\\", "/").lower()), F.lit(False)) if folder else by_id


def plain_folder(c: Column) -> Column:
    """A folder with forward slashes in lower case."""
    return F.lower(F.replace(c, F.lit("\\"), F.lit("/")))


def given(column: str, empty: tuple[str, ...] = ("",)) -> Column:
    """Neither NULL nor one of the texts that mean nothing ('' and, for lists, '[]')."""
    return F.col(column).isNotNull() & ~F.col(column).isin(*empty)


def changes_code(added: str = "total_lines_added", removed: str = "total_lines_removed") -> Column:
    return (F.coalesce(added, F.lit(0)) > 0) | (F.coalesce(removed, F.lit(0)) > 0)


def valid_session_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def home_or_root(path: Column) -> Column:
    """A root, a drive, the folder of all homes or one home: too wide to be a workspace."""
    return F.coalesce(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "").rlike(r"(?i)^$|^[a-z]:$|^(?:[a-z]:)?/(?:home|users)(?:/[^/]+)?$|^/root$|^/mnt/[a-z](?:/users(?:/[^/]+)?)?$"), F.lit(False))


def inside(path: Column, root: Column) -> Column:
    """A path that is a root or lies below it."""
    return (path == root) | path.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def bootstrap_only(turns: Column, parent: Column, title: Column) -> Column:
    """A session that was only opened: no parent, one turn at most, a caveat or /clear as title."""
    return parent.isNull() & (turns <= 1) & F.coalesce(F.lower(F.trim(title)).rlike("^(?:caveat:|/clear$)"), F.lit(False))
