"""The benchmark prints one line of JSON with a positive time for every query."""

import json
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import bench

ROOT = Path(__file__).parents[1]


def test_one_line_of_json():
    names = ["leaderboard", "page_links"]
    env = os.environ | {
        "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_RUNS": "1", "BENCH_QUERIES": ",".join(names), "PYTHONPATH": str(ROOT),
    }
    said = subprocess.run([sys.executable, "bench.py"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300, check=True).stdout
    lines = [x for x in said.splitlines() if x.startswith("{")]
    found = json.loads(lines[-1])
    assert len(lines) == 1 and list(found["queries"]) == names and found["sf"] == 0.001
    assert all(x > 0 for x in found["queries"].values()) and found["value"] > 0 and found["unit"] == "sec"


def test_headline_is_registered():
    own = [n for n in bench.HEADLINE if not n.startswith("op") and n != "pipeline"]
    assert len(own) >= 20 and set(own) <= set(__spark_entry__.queries())
