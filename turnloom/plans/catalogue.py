"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from turnloom.plans import problems, registry
from turnloom.plans import turns as _turns  # noqa: F401, I001  before dashboards, which use its SQL
from turnloom.plans import dashboards as _dashboards  # noqa: F401
from turnloom.plans import edits as _edits  # noqa: F401
from turnloom.plans import basics as _basics  # noqa: F401, I001  after edits, whose SQL it uses
from turnloom.plans import lookups as _lookups  # noqa: F401
from turnloom.plans import relations as _relations  # noqa: F401
from turnloom.plans import sessions as _sessions  # noqa: F401
from turnloom.plans import streams as _streams  # noqa: F401
from turnloom.plans import texts as _texts  # noqa: F401

QUERIES = {**problems.QUERIES, **registry.QUERIES}
SQL = {**registry.SQL}
