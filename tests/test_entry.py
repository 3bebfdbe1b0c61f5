"""The driver's contract: every SQL has its query, and the optional subpackage can be missing."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_part(tmp_path):
    for part in ("lodestone", "__spark_entry__.py"):
        source = REPO / part
        target = tmp_path / part
        if source.is_dir():
            target.mkdir()
            for file in source.rglob("*.py"):
                if "llm" not in file.relative_to(source).parts:
                    (target / file.relative_to(source)).parent.mkdir(parents=True, exist_ok=True)
                    (target / file.relative_to(source)).write_text(file.read_text())
        else:
            target.write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
