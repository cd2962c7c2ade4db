"""Every query by name: a function of a session and a folder of tables, and the SQL for the same rows."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder) as the query ``name``, with its SQL if there is one."""

    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from . import search_plans  # noqa: E402, F401

from . import text_plans  # noqa: E402, F401

from . import audit_plans  # noqa: E402, F401

from . import page_plans  # noqa: E402, F401

from . import stream_plans  # noqa: E402, F401

from . import judgement_plans  # noqa: E402, F401

from . import decision_plans  # noqa: E402, F401

from . import source_plans  # noqa: E402, F401
from . import record_plans  # noqa: E402, F401
from . import console_plans  # noqa: E402, F401
