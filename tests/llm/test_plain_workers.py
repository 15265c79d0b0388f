"""Python workers that cannot import this package: everything they need is sent to them."""

import os
import subprocess
import sys

import billsift

CODE = """
import sys
sys.path.insert(0, {root!r})
from billsift.session import local_session
import pyspark
spark = local_session(2, partitions=2, settings={{"spark.sql.warehouse.dir": {warehouse!r}}})
from pyspark.sql import functions as F

def seen(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("billsift") is not None])], names=["seen"])

assert spark.range(1).mapInArrow(seen, "seen boolean").first()[0] is False
from billsift.llm import queries
for name in {names!r}:
    rows = getattr(queries, name)(spark, "/root/testdata/sf0.001").count()
    print(name, rows)
"""


def test_queries_without_the_package_on_the_path(tmp_path):
    root = os.path.dirname(os.path.dirname(billsift.__file__))
    names = ["op5_quality", "op7_langid", "op9_toxicity", "op10_bpe", "op11_alignment", "op12_negatives", "op13_packing"]
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=root, warehouse=f"file://{tmp_path}/warehouse", names=names)
    (tmp_path / "run.py").write_text(code)
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
