import subprocess
import sys

import pytest
from conftest import ROOT
from oracle import DATA, same

from blockloom.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = same(spark, QUERIES[name], ORACLE_SQL[name])
    assert ours and ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("missing", ["blockloom.llm", "blockloom.llm.queries", "zstandard", "xxhash", "corpus_pipeline"])
def test_queries_without_what_is_optional(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(QUERIES) and int(out[1]) >= len(ORACLE_SQL) and out[2] == "False"
