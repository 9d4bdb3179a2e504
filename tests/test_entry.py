"""The driver contract without the corpus operators: the entry module imports
and lists every other query when they, or packages they need, are missing."""

import os
import shutil
import subprocess
import sys

import pytest

from claimgeo.plans.catalog import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as E; print(*sorted(E.queries())); assert set(E.oracle_sql()) <= set(E.queries())"


def names(folder, code=CODE):
    env = {**os.environ, "PYTHONPATH": folder}
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def copy(tmp_path, without):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.md", "*.json", "*.txt")
    root = shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, n: skip(d, n) | {
        x for x in n if os.path.relpath(os.path.join(d, x), ROOT) in without})
    return str(root)


@pytest.mark.parametrize("without", [
    ("claimgeo/llm", "tests/llm"),
    ("claimgeo/llm", "tests/llm", "corpus_pipeline.py"),
])
def test_entry_without_the_corpus_folders(tmp_path, without):
    assert names(copy(tmp_path, without)) == set(QUERIES)


@pytest.mark.skipif(not os.path.exists(os.path.join(ROOT, "claimgeo/llm")), reason="corpus operators taken out")
def test_entry_without_the_pipeline_keeps_the_corpus_queries(tmp_path):
    got = names(copy(tmp_path, ("corpus_pipeline.py",)))
    assert set(QUERIES) < got and "pipeline" not in got


def test_entry_without_a_package_that_only_the_corpus_needs():
    block = "import sys; sys.modules['xxhash'] = None; " + CODE
    assert names(ROOT, block) == set(QUERIES)
