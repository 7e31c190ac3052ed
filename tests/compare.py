"""Run a query and its SQL twin on the same tables and compare the rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def twin(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (decimal.Decimal, float, int)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, sf_dir, sql):
    """None, or what differs."""
    columns, data = twin(sf_dir, sql)
    got = df.collect()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = rows(df.columns, got), rows(columns, data)
    if a == b:
        return None
    only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"
