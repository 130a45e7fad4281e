"""The driver contract, with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "p"] and df.count() > 0


def test_import_without_the_optional_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("assay.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "judge_noul" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert e.oracle_sql().keys() <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_a_missing_library_is_an_error():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "ahocorasick" or name == "numpy":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
try:
    import __spark_entry__ as e
except ModuleNotFoundError as x:
    assert x.name in ("ahocorasick", "numpy")
else:
    assert not any(n.startswith("op") for n in e.queries()) and not e.llm
    import importlib.util
    assert importlib.util.find_spec("corpus_pipeline") is None
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_the_optional_operators():
    for file in (REPO / "assay").rglob("*.py"):
        if "llm" not in file.relative_to(REPO / "assay").parts:
            assert "assay.llm" not in file.read_text() and "corpus_pipeline" not in file.read_text(), file
