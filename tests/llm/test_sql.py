from pathlib import Path

import pytest

from tesserae.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF) == ""
