"""Row-by-row comparison of a Spark query with its SQL counterpart on DuckDB."""

import datetime
import decimal
import math
from pathlib import Path


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, (int, float)):
        return "None" if isinstance(v, float) and math.isnan(v) else repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None, or what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} and {sorted(names)}"
    want = rows_of(names, cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    differ = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(differ)} of {len(got)} rows differ; first: {differ[0][0]} and {differ[0][1]}" if differ else None if got else "no rows"
