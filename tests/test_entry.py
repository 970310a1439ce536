import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['zenithal.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "zenithal").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|zenithal\.llm", p.read_text()), p


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["country", "conjunctions", "objects", "red", "yellow", "manoeuvres", "max_pc", "low_orbit"] and df.count() > 0
