"""Python-side helpers for model code: times, matches with a baseline, agreement of labels, strftime formats."""

from __future__ import annotations

from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookups import known
from .timerange import parse

#: Strftime letters and the patterns they correspond to.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%b": "MMM", "%a": "EEE", "%p": "a", "%I": "hh", "%T": "HH:mm:ss", "%D": "MM/dd/yy"}


def seconds(text: str, now: datetime | None = None) -> tuple[float, float]:
    """Start and end of a time range text, in seconds since 1970."""
    r = parse(text, now or datetime.now(UTC))
    return r.start.timestamp(), r.end.timestamp()


def match(df: DataFrame, baseline: DataFrame, keys: list[str], most: int = 1_000_000) -> np.ndarray:
    """+2 or -2 for each record in order of autoid, for frames handed to model code; more than ``most`` rows are an error.

    Whole tables are matched by :func:`fluxmill.operators.lookups.known`, which stays distributed.
    """
    rows = known(df, baseline, keys).orderBy("autoid").select("match").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} records; use lookups.known")
    return rows["match"].to_numpy()


def critic(y_true: np.ndarray, y_pred: np.ndarray) -> float:
    """Mean absolute difference of two equally shaped arrays of scores; 0 for empty ones."""
    a, b = np.asarray(y_true, dtype=float), np.asarray(y_pred, dtype=float)
    if a.shape != b.shape:
        raise ValueError("shapes differ")
    return float(np.abs(a - b).mean()) if a.size else 0.0


def strftime(us: str | Column, form: str) -> Column:
    """Epoch microseconds in a strftime format ('%s' gives whole seconds)."""
    c = F.col(us) if isinstance(us, str) else us
    ts, out, literal, i = F.timestamp_micros(c), [], "", 0
    while i < len(form):
        two = form[i : i + 2]
        if two in STRFTIME or two in ("%s", "%%"):
            if literal:
                out.append(F.lit(literal))
                literal = ""
            out.append(F.lit("%") if two == "%%" else F.floor(c / 1_000_000).cast("string") if two == "%s" else F.date_format(ts, STRFTIME[two]))
            i += 2
        else:
            literal += form[i]
            i += 1
    return F.concat(*out, *([F.lit(literal)] if literal else []))
