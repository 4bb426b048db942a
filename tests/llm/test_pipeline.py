"""The pipeline's stages take effect."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("not round_trip").count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, ids that repeat or are missing, clashing names, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ("x", "place", "node", "digest", "found", "segment", "row", "kept")
    docs = docs.union(docs.limit(5)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(2).withColumn("text", F.lit("")))
    docs = docs.withColumns({n: F.lit(n) for n in names}).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.schema == docs.schema, name
        assert after.where(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0 and 0 < after.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert found.count() == docs.count() and found.where("not round_trip").count() == 0


def test_library_does_without(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "tallyloom"), tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert len(e.queries()) > 50"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    shutil.copytree(os.path.join(root, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "--collect-only"], cwd=tmp_path, check=True, env=env, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_operators.py", "-q", "-x"], cwd=tmp_path, check=True, env=env, stdout=subprocess.DEVNULL)
