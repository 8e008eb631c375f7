"""The entry module in copies of the repository that lack the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TEXT = ("mediaspark/llm", "tests/llm")
SHOW = """
import __spark_entry__ as e, bench
q, o = e.queries(), e.oracle_sql()
print(len(q), set(o) <= set(q), "pipeline" in q, any(n.startswith("op") and n[2].isdigit() for n in q))
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_text_operators(tmp_path, pipeline):
    """Both folders left out, with and without the pipeline's file."""
    left_out = {str(ROOT / t) for t in TEXT} | (set() if pipeline else {str(ROOT / "corpus_pipeline.py")})
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__", "spark-warehouse") or str(Path(folder) / n) in left_out]
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=skip)
    assert (there / "corpus_pipeline.py").exists() == pipeline and not (there / "mediaspark/llm").exists()
    ran = subprocess.run([sys.executable, "-c", SHOW], cwd=there, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr
    number, covered, has_pipeline, has_text = ran.stdout.split()
    assert int(number) > 150 and covered == "True" and has_pipeline == "False" and has_text == "False"


def test_an_error_inside_the_text_operators_shows(tmp_path):
    """Only a missing package is forgiven."""
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__", "spark-warehouse")]
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=skip)
    package = there / "mediaspark/llm"
    package.mkdir(exist_ok=True)
    (package / "__init__.py").write_text("")
    (package / "queries.py").write_text("import a_module_that_is_not_there\n")
    ran = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=there, capture_output=True, text=True, timeout=300)
    assert ran.returncode != 0 and "a_module_that_is_not_there" in ran.stderr
