"""Operators on tables, tasks, questionnaires and models against small fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from somaframe.config import Scale
from somaframe.operators import beats as B
from somaframe.operators import cleaning as C
from somaframe.operators import frequency as Q
from somaframe.operators import mixed_model as M
from somaframe.operators import scoring as S
from somaframe.operators import tables as T


def test_collapsed_compares_all_times(spark):
    rows = spark.createDataFrame([(1, 1.0, None, 2.0, None, 7.0, None, 7.0), (2, 3.0, None, 4.0, None, None, 5.0, None)], "id int, x_T1 double, x_T2 double, x_T3 double, x_T4 double, y_T1 double, y_T2 double, y_T10 double")
    got = T.collapsed(rows)
    assert got.columns == ["id", "x_T1", "x_T2", "x_T3", "x_T4", "y"]
    assert [(r.x_T1, r.x_T3, r.y) for r in got.orderBy("id").collect()] == [(1.0, 2.0, 7.0), (3.0, 4.0, 5.0)]
    assert T.collapsed(rows.limit(0)).columns == ["id", "x", "y"]


def test_questionnaires_with_several_answers(spark):
    long = spark.createDataFrame([(1, 1), (1, 2), (2, None)], "subject_id int, t_id int")
    psycho = spark.createDataFrame([(1, 1, 4.0), (1, 1, 2.0), (1, 1, None), (2, 1, 9.0)], "subject_id int, time int, q double")
    got = {(r.subject_id, r.t_id): r.q for r in T.with_questionnaires(long, psycho, ["q"]).collect()}
    assert got == {(1, 1): 2.0, (1, 2): None, (2, None): None}


def test_breath_peak_without_a_rate(spark):
    """Two windows with different sampling: each is told in its own unit."""
    grid = spark.range(2048).select(F.col("id").alias("seq")).crossJoin(spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2)], "subject_id string, w_id int, dt double"))
    resp = grid.select("subject_id", "w_id", "seq", (F.col("seq") * F.col("dt")).alias("time_s"), F.sin(2 * F.pi() * 0.25 * F.col("seq") * F.col("dt")).alias("value"))
    got = {r.subject_id: r.f0 for r in Q.breath_peak(resp).collect()}
    assert got["a"] == pytest.approx(0.25, abs=0.02) and got["b"] == pytest.approx(0.25, abs=0.01)


def test_chosen_without_a_device_series(spark):
    device = spark.createDataFrame([("a", 1.0, 800.0)], "subject_id string, t_s double, rr_ms double")
    ecg = spark.createDataFrame([("a", 1.0, 801.0), ("b", 1.0, 802.0), ("c", 1.0, 803.0)], device.schema)
    decisions = spark.createDataFrame([("a", "device_rr"), ("b", "device_rr"), ("c", "ecg_rr")], "subject_id string, choice string")
    assert {(r.subject_id, r.source, r.rr_ms) for r in B.chosen(device, ecg, decisions).collect()} == {("a", "device_rr", 800.0), ("b", "ecg_rr", 802.0), ("c", "ecg_rr", 803.0)}


def test_tasks(spark):
    decisions = spark.createDataFrame([(" a ", "Device_RR"), ("b", "none"), ("c", " ecg_rr"), ("", "ecg_rr"), (None, "ecg_rr"), ("d", None)], "subject_id string, choice string")
    assert {(r.subject_id, r.choice) for r in B.cleaning_tasks(decisions).collect()} == {("a", "device_rr"), ("c", "ecg_rr")}
    assert {r.subject_id for r in B.cleaning_tasks(decisions, ["c", " ", "x"]).collect()} == {"c"}
    allowed = spark.createDataFrame([("c",), ("b",), ("x",), ("x",), ("",)], "subject_id string")
    assert sorted(r.subject_id for r in B.not_cleaned(decisions, allowed).collect()) == ["b", "x"]


def test_ectopic_refill_by_hand(spark):
    values = [800.0, 1200.0, 810.0, 300.0, 820.0, 1100.0, 1500.0, 830.0, 3000.0]
    df = spark.createDataFrame([("a", i, float(i), v, i not in (5,)) for i, v in enumerate(values)], "subject_id string, seq int, t_s double, rr_ms double, bad boolean")
    got = [r.rr_ms for r in C.ectopic_refilled(df).orderBy("seq").collect()]
    # 1200 is ectopic, 810 after it counts as normal; 300 is out of bounds; of 820, 1100 and 1500 every other one goes
    # (their predecessors are missing or far), and 1100 is not marked; behind the last value its value stands
    assert got[0] == 800 and got[1] == pytest.approx(805) and got[2] == 810 and got[5] == 1100
    assert got[8] == got[7] or got[8] == pytest.approx(830)


SCALES = {"a": Scale(("i", "j")), "b": Scale(("k",)), "total": Scale(("a", "b")), "grand": Scale(("total", "absent"))}


def test_totals(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, "4", 9.0), (2, 1, None, "4", 9.0)], "subject_id int, time int, a double, b string, total double")
    got = {r.subject_id: (r.total, r.grand) for r in S.totals_updated(rows, SCALES).collect()}
    assert got == {1: (3.0, None), 2: (None, None)}
    assert S.totals(SCALES) == ["total", "grand"]
    assert S.shown(["a", "b", "total", "i"], SCALES) == ["total", "i"]
    assert S.shown(["a", "total"], SCALES, only_totals=False) == ["a", "total"]
    assert S.variable_sets({2: ["x"], 0: ["x", "y"]}) == ([0, 2], ["x"], ["x", "y"])


def test_all_tables_of_a_balanced_design(spark):
    """With all cells full, the marginal means are the plain means."""
    rows = [(f"P{s:02d}", s % 2, t, float(10 * (s % 2) + t + (s * 7 % 5) + (s * t) % 3), float(s)) for s in range(20) for t in (1, 2, 3)] + [("X01", 0, 1, 500.0, 1.0)]
    df = spark.createDataFrame(rows, "subject_id string, task int, t_id int, y double, z double")
    got = M.all_tables(df, ["y", "absent", "z"], ["X"])
    assert tuple(got) == M.TABLES and all(set(t["dv"]) == {"y", "z"} for t in got.values())
    plain = {str(r.task): r.m for r in df.where("subject_id <> 'X01'").groupBy("task").agg(F.avg("y").alias("m")).collect()}
    means = got["emmeans_condition"].query("dv == 'y'").set_index("name")["estimate"]
    assert means.to_dict() == pytest.approx(plain)
    assert len(got["pairs_time"].query("dv == 'y'")) == 3 and len(got["fixed_effects"].query("dv == 'y'")) == 6
    assert M.prepared(df, ["y"], ["P0", "X"]).select("subject_id").distinct().count() == 10
