"""What the tests share."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"


def same_rows(df, con, sql: str) -> None:
    """The rows of a query and of its SQL, by column name, as a bag."""
    columns = sorted(df.columns)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(map(str, (row[i] for i in order))) for row in result.fetchall())
    got = sorted(tuple(str(row[c]) for c in columns) for row in df.collect())
    assert got == want
