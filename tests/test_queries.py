"""Every query that has SQL gives the rows of that SQL; and the entry module stands without the training-data operators."""

import math
import subprocess
import sys

import duckdb
import pytest

from gleaner.plans import queries as plans
from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_rows_equal_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    assert ordered(tuple(plain(r[c]) for c in cols) for r in df.collect()) == ordered(want)


def test_entry_stands_alone():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('gleaner.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_geometry_rounds_ties_as_its_sql(spark, con, monkeypatch):
    boxes = "event_name string, image_id string, {0} int, bbox struct<x1:int,y1:int,x2:int,y2:int>"
    one = [spark.createDataFrame([("E0", "i", 0, b)], boxes.format(n)) for n, b in (("face_ord", (0, 0, 77, 110)), ("body_ord", (10, 87, 43, 120)))]
    monkeypatch.setattr(plans.X, "faces_and_bodies", lambda *_: one)
    (row,) = plans.QUERIES["fn_geometry"](spark, SF).collect()
    assert (row["face_area"], row["body_area"], row["overlap"]) == (8470, 1089, 759)
    assert row["iou"] == con.execute("select round(759 / (8470 + 1089 - 759), 4)").fetchone()[0] == 0.0862


def test_rounding_is_that_of_the_sql(spark, con):
    xs = [s * n / 20000 for n in range(1, 20000, 2) for s in (1, -1)] + [None, math.nan, math.inf, 0.0, 1e300]
    got = [tuple(r) for r in spark.createDataFrame(list(enumerate(xs)), "i long, x double").select("i", plans.r4("x"), plans.r8("x")).orderBy("i").collect()]
    con.execute("create or replace temp table ties as select unnest(range(len($1))) as i, unnest($1) as x", [xs])
    assert repr(got) == repr(con.execute("select i, round(x, 4), round(x, 8) from ties order by i").fetchall())
