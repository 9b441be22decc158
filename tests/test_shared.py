import importlib
import sys
from types import SimpleNamespace

import pytest

from sparkloom.plans.shared import cut, discard, shared_dir


def session(master, where=None):
    kept = {"spark.checkpoint.dir": where} if where else {}
    conf = SimpleNamespace(get=kept.get, set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_is_asked_for_off_local_mode():
    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://a:7077", "k8s://b", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master))
    local = session("local[8]")
    assert shared_dir(local) == shared_dir(local)


def test_cut_and_discard(spark):
    rows = cut(spark.range(10).withColumnRenamed("id", "k"), "ten")
    assert rows.count() == 10 and rows.columns == ["k"]
    folder = rows.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    discard(rows)
    assert not importlib.import_module("pathlib").Path(folder).exists()


def test_entry_leaves_out_what_does_not_import(monkeypatch):
    import __spark_entry__

    whole = __spark_entry__.queries()
    for name in [m for m in sys.modules if m.startswith("sparkloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sparkloom.llm.registry", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.warns(UserWarning, match="left out"):
        left = __spark_entry__.queries()
        assert set(__spark_entry__.oracle_sql()) <= set(left)
    assert left and not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in left) and set(left) <= set(whole)
