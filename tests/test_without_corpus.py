import subprocess
import sys


def test_entry_imports_without_the_corpus_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['taxaflow.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
