"""The engine and its queries stand without the corpus operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert names and names == set(e.oracle_sql()), names ^ set(e.oracle_sql())
assert not any(n.startswith("op") or n == "pipeline" for n in names if n[2:3].isdigit() or n == "pipeline")
import tidemark, bench
assert not any(m.startswith("tidemark.llm") for m in sys.modules)
"""


def test_without_the_operators():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})


def test_nothing_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidemark")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert "llm" not in text, f
