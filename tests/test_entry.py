import inspect

import __spark_entry__ as entry


def test_names_and_oracles_fit():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 85
    assert all(callable(f) for f in q.values())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "code", "n"] and df.count() == 10


def test_nothing_outside_the_subpackage_imports_it():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "graphloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "graphloom.llm" not in p.read_text(encoding="utf8"), p


def test_every_query_reads_whole_tables():
    from graphloom.plans import registry

    for m in registry.MODULES:
        text = inspect.getsource(m)
        assert "sample(" not in text and "% 20" not in text and ".limit(" not in text and ".head(" not in text and ".take(" not in text
