"""Bootstrap intervals against the catalogue's statement, on marks with nulls and on
values of which most are distinct."""

import random

import duckdb
import pytest

from tidemark.operators import metrics
from tidemark.plans.oracles import ORACLES


def intervals(rows):
    """The oracle's statement over (lang, quality)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality DOUBLE)")
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR)")
    con.executemany("INSERT INTO labels VALUES (?, ?)", [(i, v) for i, (_, v) in enumerate(rows)])
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, g) for i, (g, _) in enumerate(rows)])
    return sorted(con.execute(ORACLES["bootstrap_ci"]).fetchall())


def made(spark, rows, **kw):
    df = metrics.bootstrap(spark.createDataFrame(rows, "lang string, quality double"), "lang", "quality", **kw)
    return sorted(map(tuple, df.collect())), df


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_bootstrap_of_marks_with_nulls_as_in_sql(spark, share):
    r = random.Random(5)
    rows = [(g, None if r.random() < share else float(r.random() < 0.6)) for g, n in (("a", 400), ("b", 1), ("c", 70), (None, 9)) for _ in range(n)]
    rows += [("void", None)] * 3
    assert made(spark, rows)[0] == intervals(rows)


@pytest.mark.parametrize("ranges", [7, 1 << 18])
def test_bootstrap_of_distinct_values_in_blocks(spark, ranges):
    r = random.Random(6)
    rows = [(g, r.randrange(-400, 400) / 4) for g, n in (("a", 300), ("b", 12)) for _ in range(n)] + [("a", None)] * 5
    assert made(spark, rows, ranges=ranges)[0] == intervals(rows)


def test_bootstrap_joins_no_draws(spark):
    """A row for each draw, taken for a small table, was broadcast through the driver."""
    _, df = made(spark, [("a", 0.0), ("a", 1.0)] * 50)
    assert "Join" not in df._jdf.queryExecution().toString()


def test_hits_are_all_draws():
    import numpy as np

    tos = np.array([3, 1000, 70_001])
    got = metrics._hits(70_001, 0, tos, np.arange(1990, 2000))
    want = [[0] * 3 for _ in got]
    for k, rep in enumerate(range(1990, 2000)):
        for d in range(70_001):
            at = (d * 48271 + rep * 69621 + 12345) % 2147483647 % 70_001
            want[k][0 if at < 3 else 1 if at < 1000 else 2] += 1
    assert got.tolist() == want


def test_paired_interval_with_nulls_as_in_sql(spark):
    from tidemark.operators import report

    r = random.Random(7)
    rows = [(i, g, r.choice([0, 1, 1, None]), r.choice([0, 0, 1])) for i, g in enumerate("a" * 150 + "b" * 40)] + [(900, "void", None, 1), (901, None, 1, 0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", [(i, a, b) for i, _, a, b in rows])
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, g) for i, g, _, _ in rows])
    df = report.paired_interval(spark.createDataFrame(rows, "doc_id bigint, lang string, quality int, toxic int"), "lang", "quality", "toxic")
    got = sorted(map(tuple, df.select("lang", "pairs", "diff", "low", "high").collect()))
    assert got == sorted(con.execute(ORACLES["paired_ci"]).fetchall())


def test_executors_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(metrics._draw))
    load = "import sys, pickle; sys.path = [p for p in sys.path if p]; f = pickle.load(open('f', 'rb')); assert list(f('g', 1, [])) == [] and 'tidemark' not in sys.modules"
    subprocess.run([sys.executable, "-c", load], cwd=tmp_path, check=True, env={})
