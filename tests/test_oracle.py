"""Every query of the engine against its SQL, on the smallest tables; those without SQL must run."""

import oracle
import pytest

from forestflux.queries import ORACLE, QUERIES

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        assert not oracle.compare(spark, con, QUERIES[name], ORACLE[name], SF)
    else:
        assert QUERIES[name](spark, f"{oracle.ROOT}/{SF}").count() > 0
