import os
import shutil
import subprocess
import sys

from conftest import ROOT, SF


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["source", "documents", "emails", "cards"]
    assert e.queries()["email_hits"](spark, SF).columns == ["doc_id", "emails"]


def test_entry_without_the_llm_folders(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.queries()); print(len(e.queries()))"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_workers_need_no_path_to_the_package(tmp_path):
    """From another folder and without PYTHONPATH, as on a cluster whose workers don't have the repository."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from vaultlens.session import local_session; s = local_session(cores='2', partitions=2, memory='2g')\n"
        f"for n in ('det_inn', 'det_person_name'): assert e.queries()[n](s, {SF!r}).count() > 0"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
