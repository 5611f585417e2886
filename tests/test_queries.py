"""Every query of the core against its SQL on the smallest driver tables, and what the core may import."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import connect, same  # noqa: E402

from millrace.plans import registry  # noqa: E402

FOLDER = os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    same(spark, con, registry.queries()[name], registry.oracle_sql()[name], FOLDER)


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_optional_queries_that_cannot_be_imported_cost_no_other(monkeypatch):
    import __spark_entry__

    whole = set(__spark_entry__.queries())
    real = __spark_entry__.importlib.import_module

    def fails(name, *args):
        if name.startswith("millrace.llm"):
            raise ImportError("a library is missing")
        return real(name, *args)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", fails)
    assert set(registry.queries()) == set(__spark_entry__.queries()) <= whole


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from millrace import runtime

    empty = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: empty), getConf=lambda: SimpleNamespace(get=lambda _: None), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_folder(SimpleNamespace(sparkContext=context))


def test_core_does_not_import_the_text_operators():
    code = "import pkgutil, importlib, sys, millrace\nfor m in pkgutil.walk_packages(millrace.__path__, 'millrace.'):\n    if not m.name.startswith('millrace.llm'): importlib.import_module(m.name)\nassert not [m for m in sys.modules if m.startswith('millrace.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
