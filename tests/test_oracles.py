from pathlib import Path

import pytest

from compare import SF_DIR, check
from quern.plans.oracles import ORACLES
from quern.plans.queries import QUERIES

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


def test_the_rest_is_held_to_brute_force():
    """Queries without SQL: each has a test in test_scorers.py or test_pairwise.py."""
    rest = QUERIES.keys() - ORACLES.keys()
    said = "".join(Path(__file__).with_name(f).read_text() for f in ("test_scorers.py", "test_pairwise.py"))
    assert not [n for n in rest if f'"{n}"' not in said]
