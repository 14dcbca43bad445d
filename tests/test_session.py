"""The shared folder, in processes of their own: this machine's defaults may set it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
PROGRAM = """
import sys
from pyspark.sql import SparkSession
from logquarry.session import materialize, shared_dir
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) == (sys.argv[2] if len(sys.argv) > 2 else None)
folder = shared_dir(spark)
assert folder == shared_dir(spark) and (len(sys.argv) < 3 or folder == sys.argv[2])
written = materialize(spark.range(5), "five")
assert sorted(r.id for r in written.collect()) == [0, 1, 2, 3, 4]
assert all(f.startswith("file:" + "//" + folder) for f in written.inputFiles())
print("folder", folder)
"""


def run(tmp_path, *args):
    conf = tmp_path / "conf"
    conf.mkdir(exist_ok=True)
    (conf / "spark-defaults.conf").write_text(f"spark.checkpoint.dir {args[1]}\n" if len(args) > 1 else "")
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(REPO)}
    return subprocess.run([sys.executable, "-c", PROGRAM, *args], env=env, capture_output=True, text=True, timeout=180)


def test_a_local_session_without_the_setting_gets_a_folder(tmp_path):
    done = run(tmp_path, "local[2]")
    assert done.returncode == 0 and "folder /" in done.stdout, done.stderr[-2000:]


def test_the_setting_is_taken(tmp_path):
    folder = str(tmp_path / "shared")
    done = run(tmp_path, "local[2]", folder)
    assert done.returncode == 0 and f"folder {folder}" in done.stdout, done.stderr[-2000:]
