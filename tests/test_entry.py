import subprocess
import sys

import __spark_entry__


def test_imports_need_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100, (len(q), set(o) - set(q))"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_without_the_optional_folders(tmp_path):
    """The rest imports, has its queries and runs one when the llm folders and the pipeline are gone."""
    import pathlib
    import shutil

    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "tracery", tmp_path / "tracery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'usage_daily' in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
    run = "from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.sql.shuffle.partitions', '1').config('spark.ui.enabled', 'false').getOrCreate(); import __spark_entry__ as e; assert e.entry(s).count() > 0"
    subprocess.run([sys.executable, "-c", run], check=True, timeout=300, cwd=tmp_path)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
