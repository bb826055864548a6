"""The registered queries against their SQL, and the pipeline's stages one by one."""

import pytest
from oracle import DATA, same

from blockloom.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    ours, theirs = same(spark, QUERIES[name], ORACLE_SQL[name])
    assert ours == theirs


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_other_modules_do_not_import_llm():
    from pathlib import Path

    import blockloom

    root = Path(blockloom.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
