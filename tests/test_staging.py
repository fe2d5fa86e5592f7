import os
import subprocess
import sys

SCRIPT = """
import sys
from tillroll.session import build_session
from tillroll.sources.staging import stage

spark = build_session("staging", "local[1]", spark__ui__enabled="false", spark__checkpoint__dir=sys.argv[1])
assert stage(spark.range(5), "numbers").count() == 5
spark.stop()
"""


def test_an_application_leaves_nothing(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=root, check=True, timeout=120)
    left = [name for _, _, files in os.walk(tmp_path) for name in files]
    assert left == []
