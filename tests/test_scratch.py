import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from filmloom.scratch import BROADCAST_BYTES, broadcast_bytes, cut, drop_cut, join_counted

SCRIPT = """
import sys
from filmloom.session import local_session
from filmloom.scratch import cut, join_counted, scratch_root
spark = local_session(1, 1, "1g")
kept = cut(spark.range(5).selectExpr("id", "'a' as x"))
assert join_counted(spark.range(9), kept, ["id"], "inner").count() == 5
root = scratch_root(spark)
print("root", root)
if sys.argv[1] == "stop":
    spark.stop()
    import os
    print("left", sum(len(f) for _, _, f in os.walk(root)))
"""


def run(how, **settings):
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])} | settings
    out = subprocess.run([sys.executable, "-c", SCRIPT, how], env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return dict(line.split(" ", 1) for line in out.stdout.splitlines() if line.startswith(("root ", "left ")))


def files_below(folder):
    return [name for _, _, files in os.walk(folder) for name in files]


def wait_for(condition):
    """The JVM ends a little later than the Python process."""
    for _ in range(100):
        if condition():
            return True
        time.sleep(0.1)
    return False


@pytest.mark.parametrize("how", ["stop", "leave"])
def test_nothing_is_left(tmp_path, how):
    out = run(how, PYSPARK_SUBMIT_ARGS=f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell")
    assert out["root"] == str(tmp_path) and out.get("left", "0") == "0"
    assert wait_for(lambda: not files_below(tmp_path))


def test_own_root_is_deleted(tmp_path):
    root = run("leave", SPARK_CONF_DIR=str(tmp_path))["root"]
    assert os.path.basename(root).startswith("filmloom-") and wait_for(lambda: not os.path.exists(root))


def test_dropped_at_once(spark):
    df = cut(spark.range(5))
    folder = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    drop_cut(df)
    assert not os.path.exists(folder)


def test_sizes_are_measured(spark):
    few = cut(spark.range(20).select("id", F.repeat(F.lit("long"), 200_000).alias("x")))  # compresses to a few bytes
    many = cut(spark.range(3000).select("id", F.array(F.col("id").cast("string")).alias("x")))
    assert broadcast_bytes(few) > BROADCAST_BYTES > broadcast_bytes(many) > 3000 * 8
    assert broadcast_bytes(cut(spark.range(0))) == 0
    for small, broadcast in [(few, False), (many, True)]:
        plan = join_counted(spark.range(9), small, ["id"], "left")._jdf.queryExecution().logical().toString()
        assert ("strategy=broadcast" in plan) == broadcast
