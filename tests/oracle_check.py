"""Compare a registered query with its DuckDB twin the way the driver does:
row count, column names and types, and an order-insensitive value hash."""

from __future__ import annotations

import hashlib
import math

import duckdb

from quire.plans.common import TABLES

_SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
    "float": "FLOAT",
}


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_df, con, sql: str) -> dict:
    srows = [tuple(r) for r in spark_df.collect()]
    scols = spark_df.columns
    stypes = {f.name: _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    drows = rel.fetchall()
    sh, sl = _digest(srows, scols)
    dh, dl = _digest(drows, dcols)
    out = {
        "rows": (len(srows), len(drows)),
        "cols_ok": sorted(scols) == sorted(dcols),
        "types_ok": stypes == dtypes,
        "hash_ok": sh == dh,
    }
    if not out["types_ok"]:
        out["types"] = (stypes, dtypes)
    if not out["cols_ok"]:
        out["cols"] = (scols, dcols)
    if not out["hash_ok"]:
        only_s = sorted(set(sl) - set(dl))[:3]
        only_d = sorted(set(dl) - set(sl))[:3]
        out["diff"] = ([x[:300] for x in only_s], [x[:300] for x in only_d])
    out["ok"] = out["rows"][0] == out["rows"][1] and out["cols_ok"] and out["types_ok"] and out["hash_ok"]
    return out
