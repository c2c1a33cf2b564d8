import pytest
from compare import duck, same

from loomgrid.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, name):
    assert same(Q.QUERIES[name](spark, SF), duck(SF), Q.ORACLES[name]) > 0
