"""Python workers get the code with the job: nothing needs to be installed there."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys; sys.path.insert(0, {root!r})
from pyspark import cloudpickle
from guardlake.functions.decode import peel
from guardlake.streaming.redactor import Pieces, Redactor
from guardlake.catalog import RULES
redactor = Redactor(RULES)
def work(text):
    pieces = Pieces(redactor, 128)
    return peel(text)["decoded"], pieces.push(text)[0] + pieces.flush()[0]
open({path!r}, "wb").write(cloudpickle.dumps(work))
"""


def test_code_travels(tmp_path):
    path = str(tmp_path / "work.pkl")
    subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, path=path)], check=True)
    code = (f"import pickle; f = pickle.load(open({path!r}, 'rb')); "
            "print(f('a%20b x@example.com'))")
    out = subprocess.run([sys.executable, "-c", code], check=True, cwd=str(tmp_path),
                         capture_output=True, text=True).stdout
    assert out.strip() == "('a b xaexample.com', 'a%20b [EMAIL_REDACTED]')"
