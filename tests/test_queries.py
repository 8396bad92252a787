"""Every query of the engine with SQL gives the rows of its SQL, at one and at several partitions."""

import os

import pytest

from srcatlas.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("~" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    want = rows(duck.sql(Q.ORACLE_SQL[name]).df())
    for n in ("4", "1") if name in ("closure_bounded", "chunk_greedy", "parallel_collapse", "interval_merge") else ("4",):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert rows(Q.QUERIES[name](spark, SF).toPandas()) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_without_llm(tmp_path):
    """On a copy of the repository with both folders of the subpackage deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_topk' in q and set(e.oracle_sql()) <= set(q); print(sorted(n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    for gone in ("srcatlas/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    for pipeline in (True, False):  # with corpus_pipeline.py left behind, and without
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = run()
        assert done.returncode == 0 and done.stdout.strip() == "[]", done.stderr
