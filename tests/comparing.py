"""Comparison of a Spark result with a DuckDB relation, by column name and as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return x
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def differences(df, relation) -> str:
    """What differs, or an empty string."""
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} and {sorted(relation.columns)}"
    mine = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [relation.columns.index(c) for c in names]
    other = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    kinds = [(c, t, str(relation.types[relation.columns.index(c)])) for c, t in sorted(df.dtypes)]
    odd = [k for k in kinds if not same_kind(k[1], k[2])]
    if mine != other:
        return f"rows {sum(mine.values())} and {sum(other.values())}; only here {list((mine - other).items())[:3]}; only there {list((other - mine).items())[:3]}"
    return f"types {odd}" if odd else ""


def same_kind(spark: str, duck: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    return spark not in pairs or pairs[spark] == duck or duck.startswith("TIMESTAMP") and spark.startswith("timestamp")
