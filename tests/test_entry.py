import subprocess
import sys

from conftest import ROOT

import __spark_entry__ as e


def test_flagship_runs(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_names_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_llm_folders():
    code = "\n".join(
        [
            "import sys, importlib.util as u",
            "find = u.find_spec",
            "u.find_spec = lambda n, *a: None if n.startswith(('quillstream.llm', 'corpus_pipeline')) else find(n, *a)",
            "import __spark_entry__ as e",
            "assert len(e.queries()) > 80 and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']",
            "assert not [m for m in sys.modules if m.startswith(('quillstream.llm', 'corpus_pipeline'))]",
        ]
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
