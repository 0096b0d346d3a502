from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark.functions.hashing import (
    gold_fingerprint,
    gold_fingerprint_of,
    row_digest,
    silver_fingerprint,
    silver_fingerprint_of,
)
from tallymark.functions.ordering import number_by_cuts, number_in_buckets
from tallymark.functions.skew import attach_group_facts
from tallymark.functions.text import is_known_definition, is_string_array, string_array


def test_string_arrays(spark):
    texts = ['["a","b"]', "[]", None, '["a",null]', "[1,2]", '{"a":1}', "x", '"a"', ' [ "q\\"" ] ', '["a",]']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    rows = frame.selectExpr("i", f"{string_array('t')} AS a", f"{is_string_array('t')} AS ok").orderBy("i").collect()
    assert [r.a for r in rows] == [["a", "b"], [], [], None, None, None, None, None, ['q"'], None]
    assert [r.ok for r in rows] == [True, True, True, False, False, False, False, False, True, False]


def test_definitions_with_nulls_follow_three_valued_logic(spark):
    frame = spark.sql(
        """SELECT * FROM VALUES ('H01', 'Total income', 'Financial performance', 'Dollars (millions)'),
           ('H01', NULL, 'Financial performance', 'Dollars (millions)'),
           ('ZZZ', NULL, 'Financial performance', 'Dollars (millions)'),
           ('h01', 'Total income', 'Financial performance', 'Dollars (millions)') AS t(a, b, c, d)"""
    )
    known = [r[0] for r in frame.selectExpr(is_known_definition("a", "b", "c", "d")).collect()]
    assert known == [True, None, False, False]


def test_fingerprints_match_plain_hashing(spark):
    artifacts = [("B", "b"), ("A", "a"), ("B", "b")]
    frame = spark.createDataFrame(artifacts, "ingestion_id STRING, source_sha256 STRING")
    expected = hashlib.sha256(b"A:a\nB:b").hexdigest().upper()
    assert silver_fingerprint(frame).first().fingerprint == expected
    assert silver_fingerprint_of(artifacts) == expected
    prints = spark.createDataFrame([("F2",), ("F1",)], "silver_input_fingerprint STRING")
    assert gold_fingerprint(prints).first().fingerprint == gold_fingerprint_of(["F1", "F2"])


def test_row_digest_marks_nulls(spark):
    frame = spark.createDataFrame([("a", None), ("a", "")], "x STRING, y STRING")
    found = [r[0] for r in frame.select(row_digest(["x", "y"])).collect()]
    assert found == [hashlib.sha256(t.encode()).hexdigest() for t in ("a\u001f<null>", "a\u001f")]


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("required", [True, False])
@pytest.mark.parametrize("hot_min_rows", [1, 50, 1_000_000])
def test_group_facts_do_not_depend_on_the_hot_threshold(spark, null_safe, required, hot_min_rows):
    # One key owns most rows, some of them exact copies.
    rows = spark.range(400).selectExpr(
        "CASE WHEN id < 300 THEN 'hot' WHEN id < 310 THEN NULL ELSE concat('k', id % 20) END AS k",
        "id % 7 AS v",
    )
    facts = rows.where("k IS NULL OR k <> 'k3'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = attach_group_facts(
        rows, facts, ["k"], "n", null_safe=null_safe, required=required, hot_min_rows=hot_min_rows
    ).groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    found = {r.k: (r.rows, r.n) for r in out.collect()}
    assert found["hot"] == (300, 300)
    assert found.get("k3", (0, None))[1] is None and ("k3" in found) == (not required)
    assert found.get(None, (0, None))[1] == (10 if null_safe else None)
    assert (None in found) == (null_safe or not required)


def test_numbering_matches_a_plain_window(spark):
    from pyspark.sql import Window

    rows = spark.range(500).selectExpr("id % 3 AS g", "CAST((id * 37) % 101 AS INT) AS v", "id")
    window = Window.partitionBy("g").orderBy("v", "id")
    expected = {(r.id, r.p) for r in rows.select("id", F.row_number().over(window).alias("p")).collect()}
    texts = rows.withColumn("t", F.expr("lpad(CAST(id AS STRING), 3, '0')"))
    far = number_by_cuts(texts, ["g"], "-v", ["t"], "p", 1_000)
    assert {(r.id, r.p) for r in far.collect()} == expected
    near = number_in_buckets(
        rows.withColumn("b", F.floor(F.col("v") / 10)), ["g"], ["b"], ["v", "id"], position="p", total="n"
    )
    assert {(r.id, r.p) for r in near.collect()} == expected
    assert {(r.g, r.n) for r in near.collect()} == {(0, 167), (1, 167), (2, 166)}


def test_cuts_follow_ties_nulls_and_the_bound(spark):
    """Half of a group on one score, decimals that doubles cannot hold, missing texts, a group of one."""
    rows = spark.range(3_000).selectExpr(
        "if(id = 7, 'one', if(id % 3 = 0, NULL, 'g')) AS g",
        "CAST(CASE WHEN id % 2 = 0 THEN 5 ELSE pmod(xxhash64(id), 97) / 7 END AS DECIMAL(38,18)) + CAST(id % 2 AS DECIMAL(38,18)) * 0.000000000000000001 AS s",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('C', id % 400) END AS code", "CAST(id AS STRING) AS id")
    order = [F.desc("s"), F.asc("code"), F.asc("id")]
    numbered = rows.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    for most in (1, 600, 10**9):
        expected = {tuple(r) for r in numbered.where(F.col("p") <= most).select("g", "id", "p").collect()}
        found = number_by_cuts(rows, ["g"], "s", ["code", "id"], "p", most)
        assert {tuple(r) for r in found.select("g", "id", "p").collect()} == expected


def test_cuts_are_searched_in_generated_code(spark):
    """A lambda over every cut is interpreted, for each row as often as there are cuts."""
    rows = spark.range(10).selectExpr("id % 2 AS g", "CAST(id AS DECIMAL(38,18)) AS s", "CAST(id AS STRING) AS t")
    plan = number_by_cuts(rows, ["g"], "s", ["t"], "p", 10**9)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
