from payscope.operators.rules.places import nearby


def test_places_are_judged_once(spark):
    """Whole parts, single places and cut cells are told apart in one stored pass, not in a join for each."""
    rows = [("x", 48.0 + i / 500, 16.0 + i / 700) for i in range(40)]
    places = spark.createDataFrame(rows, "acct string, lat double, lon double")
    parts = nearby(places, places, ["acct"], 5.0)
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert parts.select("lat", "lon").distinct().count() == len(rows)
