from __future__ import annotations

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


def make_session():
    from codequarry.session import local_session

    spark = local_session(cpus=4, partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
