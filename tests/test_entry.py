"""The entry module from a folder where the package is not found."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SF_DIR = "/root/testdata/sf0.001"

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_module", {str(REPO / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("parse_sentiment", "encoder_score"):
    print(name, entry.queries()[name](spark, {SF_DIR!r}).count())
import tonegrain.operators.encoder as module
def where(batches):
    import tonegrain.session
    for batch in batches:
        yield batch.assign(id=len(tonegrain.session.__file__))
print("found", spark.range(3).mapInPandas(where, "id long").count())
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not there")
def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "found 3" in done.stdout
