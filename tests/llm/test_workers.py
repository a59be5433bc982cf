import os
import subprocess
import sys

from conftest import ROOT, SF

NAMES = ("op1_quality", "op3_token_store", "op4_exact_topk", "op5_source_mix", "op6_decontamination", "op8_suffix_dedup", "op9_chat_windows", "op10_simhash")


def test_workers_need_no_path_to_the_package(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from vaultlens.session import local_session; s = local_session(cores='2', partitions=2, memory='2g')\n"
        f"for n in {NAMES!r}: assert e.queries()[n](s, {SF!r}).count() > 0, n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
