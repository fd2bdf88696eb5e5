"""Every registered query of the subpackage that has SQL, against it."""

import pytest

from bidlens.llm.queries import ORACLE_SQL, QUERIES

from .oracle import compare


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op1_warc", "op9_decontamination", "op11_hard_negatives"}))  # these have tests of their own
def test_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name])
