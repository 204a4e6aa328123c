"""Run a registered query and its SQL and compare them strictly: names, row count, values without regard to order."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(directory):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return f"{type(value).__name__}:{value}"


def key(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(df, con, sql):
    """Empty when equal, else what differs."""
    mine_names, mine = key([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    their_names, theirs = key(cursor.fetchall(), names)
    if mine_names != their_names:
        return f"columns {mine_names} != {their_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return f"values: spark {sorted(a - b)[:3]} sql {sorted(b - a)[:3]}"
    return ""
