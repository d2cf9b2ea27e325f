"""Values as strict JSON."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import math
from typing import Any

from pyspark.sql import Row


def to_jsonable(v: Any) -> Any:
    """NaN and infinities become null, times ISO 8601, sets lists, keys strings; what is unknown its text."""
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, decimal.Decimal):
        return to_jsonable(float(v))
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, Row):
        return to_jsonable(v.asDict())
    if isinstance(v, dict):
        return {str(k): to_jsonable(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set, frozenset)):
        return [to_jsonable(x) for x in (sorted(v, key=str) if isinstance(v, (set, frozenset)) else v)]
    if dataclasses.is_dataclass(v) and not isinstance(v, type):
        return to_jsonable({f.name: getattr(v, f.name) for f in dataclasses.fields(v)})
    if hasattr(v, "tolist"):  # numpy
        return to_jsonable(v.tolist())
    return str(v)
