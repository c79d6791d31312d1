"""The entry point without the training-data package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), any(k.startswith('op') for k in E.queries()))"


def copy_without(tmp_path, *left_out):
    names = set(left_out)
    dst = tmp_path / "copy"
    shutil.copytree(ROOT, dst, ignore=lambda d, found: [
        f for f in found if f in (".git", "__pycache__", ".pytest_cache")
        or os.path.relpath(os.path.join(d, f), ROOT) in names])
    return dst


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True,
                          env={**os.environ, "PYTHONPATH": str(folder)})


def test_entry_and_tests_without_the_package(tmp_path):
    from bayeslake.plans.catalog import QUERIES
    want = f"{len(QUERIES)} {len(QUERIES)} False"
    folder = copy_without(tmp_path, os.path.join("bayeslake", "llm"), os.path.join("tests", "llm"))
    out = run(folder, LIST)
    assert out.returncode == 0 and out.stdout.strip() == want, out.stderr
    listed = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"],
                            cwd=folder, capture_output=True, text=True)
    assert listed.returncode == 0, listed.stdout[-2000:]


def test_entry_without_the_pipeline_as_well(tmp_path):
    folder = copy_without(tmp_path, os.path.join("bayeslake", "llm"), os.path.join("tests", "llm"), "corpus_pipeline.py")
    out = run(folder, LIST)
    assert out.returncode == 0 and out.stdout.strip().endswith("False"), out.stderr


def test_other_import_errors_are_seen(tmp_path):
    folder = copy_without(tmp_path, os.path.join("tests", "llm"))
    if (folder / "corpus_pipeline.py").exists():
        (folder / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
        out = run(folder, LIST)
        assert out.returncode != 0 and "no_such_module_at_all" in out.stderr
