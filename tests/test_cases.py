"""The worked cases, dealt out over the suppliers of the smallest tables, against their stated results."""

import pytest

from tests.cases import audits, model, readings  # noqa: F401
from tests.cases.golden import CASES, SQL
from tests.conftest import DATA
from tests.test_queries import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, duck, name):  # noqa: F811
    df, rel = CASES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted([repr(plain(r[i])) for i in order] for r in data)

    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
