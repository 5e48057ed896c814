import pytest

from tessera import plans

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", plans.ORACLES)
def test_query_has_the_rows_of_its_sql(spark, name):
    same(spark, plans.QUERIES[name], plans.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_subpackage():
    from pathlib import Path

    for p in (Path(__file__).parent.parent / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
