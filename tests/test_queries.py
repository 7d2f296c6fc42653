"""Every graph query that SQL can say, against its twin."""

import pytest

from loomgraph.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(name, same):
    same(QUERIES[name], ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
