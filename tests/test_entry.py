"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_llm_folders(tmp_path):
    shutil.copytree(os.path.join(ROOT, "symdex"), tmp_path / "symdex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hotspots_size' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_an_operator_that_lacks_a_library_is_left_out_aloud(tmp_path):
    shutil.copytree(os.path.join(ROOT, "symdex"), tmp_path / "symdex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "symdex" / "llm").mkdir()
    (tmp_path / "symdex" / "llm" / "__init__.py").write_text("")
    (tmp_path / "symdex" / "llm" / "queries.py").write_text("import no_such_module_at_all")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'hotspots_size' in e.queries()"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert not done.returncode and "no_such_module_at_all" in done.stderr
