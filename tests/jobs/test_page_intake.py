"""Intake of a folder that grows: runs take what is new, batches may be cut anyhow, repeated batches give the same ledger."""

import hashlib
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import page_intake
from jobs.queries import config

HTML = "<html><head><title>A page</title></head><body>" + "text " * 100 + "</body></html>"
ROWS = [
    (1, "http://m.example.com/a/b", HTML),
    (2, "https://example.com/a/../b", HTML),
    (3, "ftp://example.com/a", "<title></title>"),
    (4, None, None),
    (None, "https://th.example.com/x?y=..", HTML),
    (5, "http://example.com/a", ""),
    (1, "http://m.example.com/a/b", HTML),
]
MORE = [(6, "https://m.example.com/q", HTML + "6"), (1, "http://m.example.com/a/b", HTML), (1, "http://m.example.com/a/b", HTML + "changed"), (4, None, None)]


def add(spark, rows, path, files=1):
    spark.createDataFrame(rows, page_intake.PAGES).repartition(files).write.mode("append").parquet(path)


def by_hand(rows):
    owners = dict(map(tuple, config("page_intake")["rules"]))
    out = set()
    for page_id, url, html in rows:
        html = html or ""
        problems = ["no id"] * (page_id is None)
        parts = url.split("/", 3)[3].split("?")[0].split("/") if url and url.startswith("http") else [""]
        problems += ["bad url"] * (not (url or "").startswith("http"))
        problems += ["unsafe path"] * (url is None or any(p in ("", ".", "..") for p in parts))
        problems += ["no title"] * ("<title>A" not in html)
        problems += ["short"] * (len(html) < config("page_intake")["min_chars"])
        owner = max(((len(p), o) for p, o in owners.items() if url and url.startswith(p)), default=(0, None))[1]
        out.add((page_id, url, owner, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), ",".join(problems), not problems))
    return sorted(out, key=str)


def ledger(spark, path):
    return sorted(map(tuple, page_intake.contents(spark, path).collect()), key=str)


@pytest.mark.parametrize("most", [1, 64])
def test_two_runs_over_growing_input(spark, tmp_path, caplog, most):
    pages, out, mark = (f"file://{tmp_path}/{x}" for x in ("pages", "ledger", "mark"))
    settings = config("page_intake") | {"max_files_per_batch": most}
    caplog.set_level(logging.INFO, "page_intake")
    add(spark, ROWS, pages, 3)
    page_intake.run(spark, pages, out, mark, settings)
    assert ledger(spark, out) == by_hand(ROWS)
    assert sum(r.args[1] for r in caplog.records if r.msg.startswith("batch")) == len(ROWS)
    add(spark, MORE, pages, 2)
    caplog.clear()
    page_intake.run(spark, pages, out, mark, settings)
    assert ledger(spark, out) == by_hand(ROWS + MORE)
    assert sum(r.args[1] for r in caplog.records if r.msg.startswith("batch")) == len(MORE)  # only what is new was read
    assert sum(r.args[3] for r in caplog.records if r.msg.startswith("batch")) == 2
    caplog.clear()
    page_intake.run(spark, pages, out, mark, settings)
    assert not [r for r in caplog.records if r.msg.startswith("batch")] and ledger(spark, out) == by_hand(ROWS + MORE)
    parts = {(r["batch"] is not None, r["accepted"]) for r in spark.read.parquet(out).select("batch", "accepted").distinct().collect()}
    assert parts == {(True, "true"), (True, "false")}


def test_a_batch_that_is_repeated_gives_the_same_ledger(spark, tmp_path):
    """The last batch's commit is lost, as if the driver had gone between writing and noting it: it is done again."""
    pages, out, mark = (f"file://{tmp_path}/{x}" for x in ("pages", "ledger", "mark"))
    settings = config("page_intake")
    add(spark, ROWS, pages)
    page_intake.run(spark, pages, out, mark, settings)
    add(spark, MORE, pages)
    page_intake.run(spark, pages, out, mark, settings)
    want = ledger(spark, out)
    for name in ("1", ".1.crc"):
        (tmp_path / "mark" / "commits" / name).unlink()
    page_intake.run(spark, pages, out, mark, settings)
    assert ledger(spark, out) == want == by_hand(ROWS + MORE)


def test_a_single_file_and_settings(spark, tmp_path):
    spark.createDataFrame(ROWS, page_intake.PAGES).coalesce(1).write.parquet(f"file://{tmp_path}/pages")
    one = next((tmp_path / "pages").glob("*.parquet"))
    before = spark.conf.getAll
    page_intake.run(spark, f"file://{one}", f"file://{tmp_path}/ledger", f"file://{tmp_path}/mark", config("page_intake"))
    assert ledger(spark, f"file://{tmp_path}/ledger") == by_hand(ROWS) and spark.conf.getAll == before


def test_command_line(spark, tmp_path):
    root = Path(__file__).resolve().parents[2]
    add(spark, ROWS, f"file://{tmp_path}/pages")
    env = os.environ | {"PYTHONPATH": str(root), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.checkpoint.dir=file://{tmp_path}/shared --conf spark.ui.enabled=false pyspark-shell"}
    args = [sys.executable, "-m", "jobs.page_intake", *(f"file://{tmp_path}/{x}" for x in ("pages", "ledger", "mark")), "--config", "jobs/page_intake.json"]
    done = subprocess.run(args, cwd=root, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0 and "7 rows read" in done.stderr, done.stderr[-2000:]
    assert ledger(spark, f"file://{tmp_path}/ledger") == by_hand(ROWS)
