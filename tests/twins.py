"""Runs a query and its SQL twin over one scale and compares the rows, whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or value != value:
        return "~"
    return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame, columns):
    return sorted(tuple(map(shown, r)) for r in frame[columns].itertuples(index=False, name=None))


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    left, right = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    assert rows(left, columns) == rows(right, columns)
    return len(left)
