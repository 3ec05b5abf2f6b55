import importlib
import sys

SMALL = "/root/testdata/sf0.001"


def test_registered_queries_run(spark):
    import __spark_entry__ as entry
    from leafmill.plans import registered

    for name in ("chunk_recursive", "code_evidence", "citation_check", "tolerant_json", "figure_box_dedupe", "word_lines"):
        assert registered()[name](spark, SMALL).count() > 0, name
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_imports_without_the_subpackage(monkeypatch):
    gone = [m for m in sys.modules if m.startswith("leafmill.llm") or m in ("corpus_pipeline", "__spark_entry__")]
    kept = {m: sys.modules.pop(m) for m in gone}

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("leafmill.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    parent = sys.modules.get("leafmill")
    if parent is not None and hasattr(parent, "llm"):
        monkeypatch.delattr(parent, "llm")
    names = set(importlib.import_module("__spark_entry__").queries())
    assert names and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
    del sys.modules["__spark_entry__"]
    sys.modules.update(kept)
