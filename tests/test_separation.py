"""Nothing outside kartei/llm may need it."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_no_import_of_the_subpackage():
    for path in [*ROOT.glob("kartei/**/*.py"), *ROOT.glob("*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in path.relative_to(ROOT).parts or path.name in ("__spark_entry__.py", "test_separation.py"):
            continue
        assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['kartei.llm'] = None; import __spark_entry__ as e; assert 'folder_audit' in e.queries() and 'p1_found' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
