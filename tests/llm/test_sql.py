"""Queries against their SQL, and that each one runs on the small tables."""

import pytest

from tenderlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    from check_oracles import compare, duck
    msg, ok = compare(spark, duck(SF), name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, msg


def test_every_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))
