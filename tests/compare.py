"""Order-free comparison of a Spark result with DuckDB's."""

import decimal
import math
import os


def plain(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(float(x)) else round(float(x), 5) + 0.0
    if isinstance(x, int):
        return float(x)
    return str(x)[:26] if hasattr(x, "isoformat") else x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda t: tuple((v is None, str(v)) for v in t))


def connect(folder):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c
