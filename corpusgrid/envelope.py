"""Results and errors as plain objects for callers at the edge."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from corpusgrid import __version__
from corpusgrid.errors import GridError

#: Rows that an envelope holds at most.
ROWS = 1000


def success(result: DataFrame | dict | list, rows: int = ROWS) -> dict:
    """A bounded result; frames are cut at ``rows`` and say so."""
    if isinstance(result, DataFrame):
        found = [r.asDict(recursive=True) for r in result.limit(rows + 1).collect()]
        result = {"rows": found[:rows], "truncated": len(found) > rows}
    return {"version": __version__, "ok": True, "result": result}


def failure(error: Exception) -> dict:
    code = error.code if isinstance(error, GridError) else "INTERNAL"
    return {"version": __version__, "ok": False, "error": {"code": code, "message": str(error)}}


def text(envelope: dict) -> str:
    return json.dumps(envelope, sort_keys=True, default=str, ensure_ascii=False)
