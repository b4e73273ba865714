"""What is left when the training-data folders and the pipeline are deleted: everything else imports, and broken ones hide nothing."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_a_subpackage_that_cannot_be_imported_takes_nothing_else_down(tmp_path):
    shutil.copytree(ROOT / "learnloom", tmp_path / "learnloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "learnloom" / "llm").mkdir()
    (tmp_path / "learnloom" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("import learnloom.llm\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
