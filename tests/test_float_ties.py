"""Equal means whose sums were made in another order are equal."""

import duckdb
import pytest

from tidewatch.operators import project as P
from tidewatch.operators import select as S
from tidewatch.plans import catalog
from tidewatch.plans import select as plans


def test_a_share_that_equals_the_screen_stays(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0)], "k int, a double")
    fr = spark.createDataFrame([(1, 0.0505), (2, 0.05050000000000003), (3, 0.050501)], "k int, ft double")
    assert {r.k for r in P.background_corrected(df, fr, "k", {}, ["a"], "ft", 0.0505).collect()} == {1, 2}


def test_colours_are_rounded_as_in_sql(spark, tmp_path):
    # 1282 / 1280 = 1.0015625, 2574 / 1280 = 2.0109375 and 1281 / 1280 = 1.00078125, of which the first two have doubles below themselves; suppliers 3 and 10 have no background
    rows = [(s, n, q, 0.05) for s, bands in ((3, (1280.0, 1282.0, 1300.0)), (10, (1280.0, 1280.0, 2574.0)), (17, (1280.0, 1281.0, 7.0))) for n, q in zip((1, 3, 5), bands, strict=True)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"select source_id, c1, c2, rms, state from ({catalog.ORACLE['p23_background_correction']}) order by 1").fetchall()
    got = catalog.QUERIES["p23_background_correction"](spark, str(tmp_path)).select("source_id", "c1", "c2", "rms", "state").orderBy("source_id").collect()
    assert [tuple(r) for r in got] == want


def test_equal_probabilities_tie_and_missing_classes_take_no_part(spark):
    df = spark.createDataFrame([(1, 0.3, 0.1 + 0.2, 0.1, 0.01, 0.02, 0.5), (2, None, 0.2, 0.5, None, None, 0.01), (3, None, 0.2, None, None, 0.1, None)],
                               "k int, pa double, pb double, pc double, sa double, sb double, sc double")
    got = {r.k: r for r in S.margin(df, {c: f"p{c}" for c in "abc"}, {c: f"s{c}" for c in "abc"}).collect()}
    assert (got[1].cls, got[1].lead, got[1].indeterminate) == ("a", 0.0, True)
    assert got[2].cls == "c" and got[2].lead == pytest.approx(0.3) and got[2].indeterminate is False
    assert (got[3].cls, got[3].lead, got[3].indeterminate) == ("b", None, None)


def test_a_lead_is_not_made_of_rounded_probabilities(spark):
    df = spark.createDataFrame([(0.1234567894996, 0.0, 0.01, 0.02)], "pa double, pb double, sa double, sb double")
    got = S.margin(df, {c: f"p{c}" for c in "ab"}, {c: f"s{c}" for c in "ab"}).selectExpr("lead", "round(lead, 9) AS shown").first()
    assert got == (0.1234567894996, 0.123456789)


def test_equal_halves_tie(spark, monkeypatch):
    # sources of equal cents, whose sums differ in the last bits
    rows = [(s, 2 * i + 1, x) for s in range(0, 40, 4) for i, x in enumerate([0.1, 0.2, 0.3] if s % 8 else [0.3, 0.2, 0.1])]
    rows += [(s, 2 * i, float(s)) for s in range(0, 40, 4) for i in range(2)] + [(40, 1, 9.0), (40, 2, 50.0)]
    monkeypatch.setattr(plans, "observations", lambda *a: spark.createDataFrame(rows, "source_id int, obs_id int, rate double").coalesce(1))
    got = plans.w11(spark, "").first()
    # ten sources tie at the smallest odd mean: rho of ranks (5.5 x 10, 11) and (1 to 11)
    assert got.n == 11 and got.rho == pytest.approx(0.5, abs=1e-9)
