from pathlib import Path

import pytest

from compare import SF_DIR, check
from quern.llm.queries import QUERIES
from quern.llm.sql import ORACLES

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])
