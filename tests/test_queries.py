import pytest

from millrace.plans import data_queries, environment_queries, function_queries, registry, rollout_queries, source_queries, stream_queries, text_queries  # noqa: F401

from oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    assert_same(registry.QUERIES[name](spark, data), registry.ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_survives_without_the_optional_parts(monkeypatch):
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def missing(name, *a):
        if name == "corpus_pipeline" or name.startswith("millrace.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(e.importlib, "import_module", missing)
    assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
    assert len(e.queries()) > 50
