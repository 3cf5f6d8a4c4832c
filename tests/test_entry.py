import importlib
import os
import subprocess
import sys

from conftest import ROOT, SF


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_does_not_need_llm(tmp_path):
    """The engine without the llm folders and the pipeline still imports."""
    code = "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 100 and not any(k.startswith('op1_') for k in e.queries())"
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", ".git"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name) if name != "tidegate" else None
    os.mkdir(tmp_path / "tidegate")
    for name in os.listdir(f"{ROOT}/tidegate"):
        if name != "llm":
            os.symlink(f"{ROOT}/tidegate/{name}", tmp_path / "tidegate" / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, capture_output=True)


def test_nothing_else_imports_llm():
    import tidegate.plans

    for root, _, names in os.walk(f"{ROOT}/tidegate"):
        if "llm" not in root.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    text = open(f"{root}/{n}", encoding="utf-8").read()
                    assert "tidegate.llm" not in text and "from .llm" not in text and "import llm" not in text, n
    assert importlib.import_module("tidegate.plans").QUERIES


def test_oracles_of_a_few_queries(spark):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    for name in ("agg01_confusion_matrix", "smp01_group_split", "pol05_suspicion", "scr13_threshold_sweep", "prj14_hosts"):
        got, want = e.queries()[name](spark, SF).toPandas(), c.execute(e.oracle_sql()[name]).df()
        key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
        assert key(got) == key(want), name
