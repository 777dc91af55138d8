"""Compares a query's rows with its SQL's, in any order, floats to nine digits."""

import math


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(records, names):
    return sorted((tuple(norm(r[n]) for n in names) for r in records), key=repr)


def compare(df, con, sql):
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    expected = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    got = [r.asDict() for r in df.collect()]
    assert len(got) == len(expected)
    for a, b in zip(rows(got, names), rows(expected, names), strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)
