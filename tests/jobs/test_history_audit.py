"""Audit of a moved table: differences as multisets, trees, reruns."""

import hashlib

from jobs import history_audit

SETTINGS = {"key": "k", "text": "t", "fan": 4}
SCHEMA = "k long, t string"


def sha(text):
    return hashlib.sha256(b"null" if text is None else f"text:{text}".encode()).hexdigest()


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return path


def report(spark, path):
    return sorted((tuple(r) for r in history_audit.contents(spark, path).collect()), key=str)


def test_equal_tables(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(40)] + [(3, "text 3"), (None, None), (None, "x"), (7, None)]
    a, b, out = write(spark, rows, f"file://{tmp_path}/a"), write(spark, rows[::-1], f"file://{tmp_path}/b"), f"file://{tmp_path}/out"
    history_audit.run(spark, a, b, out, SETTINGS)
    got = report(spark, out)
    assert len(got) == 1 and got[0][2] == got[0][3] and got[0][4:] == ("node", "equal")
    history_audit.run(spark, a, b, out, SETTINGS)
    assert report(spark, out) == got


def test_differences(spark, tmp_path):
    one = [(i, f"text {i}") for i in range(40)] + [(5, "twice"), (5, "twice"), (None, "n"), (9, None)]
    two = [(i, f"text {i}") for i in range(40) if i not in (11, 12)] + [(5, "twice"), (None, "m"), (9, ""), (70, "new")]
    a, b, out = write(spark, one, f"file://{tmp_path}/a"), write(spark, two, f"file://{tmp_path}/b"), f"file://{tmp_path}/out"
    history_audit.run(spark, a, b, out, SETTINGS)
    records = [r for r in report(spark, out) if r[4] == "record"]
    assert sorted(records, key=str) == sorted(
        [
            (None, "11", sha("text 11"), None, "record", "missing"),
            (None, "12", sha("text 12"), None, "record", "missing"),
            (None, "5", sha("twice"), None, "record", "missing"),
            (None, None, sha("n"), sha("m"), "record", "changed"),
            (None, "9", sha(None), sha(""), "record", "changed"),
            (None, "70", None, sha("new"), "record", "added"),
        ],
        key=str,
    )
    assert {r[5] for r in report(spark, out) if r[4] == "node"} == {"changed"}


def test_one_change_is_one_node_a_level(spark, tmp_path):
    one = [(i, f"text {i}") for i in range(64)]
    two = [(i, t + "!" if i == 37 else t) for i, t in one]
    a, b, out = write(spark, one, f"file://{tmp_path}/a"), write(spark, two, f"file://{tmp_path}/b"), f"file://{tmp_path}/out"
    history_audit.run(spark, a, b, out, SETTINGS)
    assert sorted((r[0], r[1]) for r in report(spark, out) if r[4] == "node") == [(0, "9"), (1, "2"), (2, "0")]
    assert [r[1:] for r in report(spark, out) if r[4] == "record"] == [("37", sha("text 37"), sha("text 37!"), "record", "changed")]
    history_audit.run(spark, a, a, out, SETTINGS)  # problems that are gone leave nothing behind
    assert [r[4:] for r in report(spark, out)] == [("node", "equal")]


def test_empty_tables(spark, tmp_path):
    a, b, out = write(spark, [], f"file://{tmp_path}/a"), write(spark, [(1, "x")], f"file://{tmp_path}/b"), f"file://{tmp_path}/out"
    history_audit.run(spark, a, a, out, SETTINGS)
    assert report(spark, out) == []
    history_audit.run(spark, a, b, out, SETTINGS)
    assert sorted(r[4:] for r in report(spark, out)) == [("node", "changed"), ("record", "added")]
