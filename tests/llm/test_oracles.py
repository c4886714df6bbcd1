"""Every query of the subpackage that SQL can state, on the smallest tables."""

import pytest

from logloom.llm.queries import QUERIES
from logloom.llm.queries_sql import SQL
from tests.helpers import duck_bag, spark_bag


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    want, columns = duck_bag(duck, SQL[name])
    assert sorted(df.columns) == columns
    assert spark_bag(df) == want


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[2]
    for f in (root / "logloom").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|\bllm\b.*import", f.read_text()), f
