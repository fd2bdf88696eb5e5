"""Every registered query against its SQL."""

import pytest

from bidlens import registry

from .oracle import compare

SF = "/root/testdata/sf0.001"
#: Queries that data this small may leave without rows.
MAY_BE_EMPTY = {"notice_search_page", "library_search_category", "generated_queries", "outlines", "compliance_rows"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    n = compare(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() or name in MAY_BE_EMPTY


@pytest.mark.parametrize("module", ["bidlens.registry", "bidlens.queries.retrieval", "bidlens.queries.notices", "bidlens.queries.presented"])
def test_any_module_can_be_imported_first(module):
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", f"import {module}"], check=True, timeout=120, cwd=Path(__file__).parent.parent)
