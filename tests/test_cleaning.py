import pytest
from pyspark.sql import functions as F

from incidentlake import clean_incidents, read_incidents, read_incidents_csv, select_incidents, trainable, write_incidents
from incidentlake.functions import columns as C
from incidentlake.schema import INCIDENT_SCHEMA


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_bins(spark):
    aboard = [-1.0, 0.0, 4.0, 5.0, 19.0, 20.0, 99.0, 100.0]
    df = spark.createDataFrame([(float(a),) for a in aboard], "a double")
    assert values(df, C.aboard_bin(F.col("a"))) == [None, 3.0, 3.0, 2.0, 2.0, 1.0, 1.0, 0.0]
    years = [1939, 1940, 1957, 1958, 1969, 1970, 1989, 1990, None]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    assert values(df, C.era_bin(F.col("y"))) == [0, 1, 1, 2, 2, 3, 3, 4, 2]


def test_dates(spark):
    df = spark.createDataFrame(
        [("1977-03-27",), ("9/17/1908",), ("02/30/1950",), ("1997-02-29",), ("about 1933",), ("n/a",), (None,)], "d string"
    )
    assert [str(v) if v else None for v in values(df, C.as_date(F.col("d")))] == [
        "1977-03-27", "1908-09-17", None, None, None, None, None]
    assert values(df, C.year_of(F.col("d"))) == [1977, 1908, 1950, 1997, 1933, None, None]
    assert values(df, C.month_of(F.col("d"))) == [3, 9, 6, 6, 6, 6, 6]


def test_severity_and_rate(spark):
    rows = [("248", "248"), ("109", "113"), ("165", "0"), ("307", "3"), ("296", "111"), ("0", "0"), ("x", "5"), ("10", None)]
    df = clean_incidents(spark.createDataFrame(
        [(str(i), a, f) for i, (a, f) in enumerate(rows)], "id string, aboard string, fatalities string"))
    got = {r["id"]: (r["severity_label"], r["fatality_rate"], r["survival_count"]) for r in df.collect()}
    assert [got[i][0] for i in range(len(rows))] == [
        "Fatal", "Fatal", "Minor", "Moderate", "Severe", "Unknown", "Unknown", "Unknown"]
    assert got[1][1] > 1 and got[1][2] == -4.0
    assert got[5][1] is None and got[6][1] is None
    other = clean_incidents(spark.createDataFrame([("1", "100", "20")], "id string, aboard string, fatalities string"), (0.3, 0.9))
    assert values(other, "severity_label") == ["Moderate"]


def test_operator_categories(spark):
    names = ["Royal Air Force", "Armée de l'Air", "Executive Jets", "Private Charter Co", "Lufthansa", "", None, "Air Charter Military"]
    df = spark.createDataFrame([(n,) for n in names], "o string")
    assert values(df, C.operator_category(F.col("o"))) == [
        "Military", "Military", "Private", "Private", "Commercial", "Commercial", "Commercial", "Military"]
    assert values(df, C.operator_category(F.col("o"), "short")) == [
        "Commercial", "Commercial", "Commercial", "Private", "Commercial", "Commercial", "Commercial", "Military"]


def test_first_value(spark):
    df = spark.createDataFrame([("Weather | Fire",), (" Fire ",), ("|x",), (None,)], "c string")
    assert values(df, C.first_value(F.col("c"))) == ["Weather", " Fire ", "", None]


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,Date,Operator,Type,Flight #,Aboard,Fatalities,Ground,Summary\n'
        '1,09/17/1908,"Military - ""U.S."" Army",Wright Flyer III,,2,1,0,"Crashed\non landing."\n'
        "2,1912-07-12,,,NA-3,five,5,,\n"
    )
    df = clean_incidents(read_incidents_csv(spark, str(tmp_path), multi_line=True))
    one, two = df.orderBy("id").collect()
    assert (one["operator"], one["summary"], one["year"], one["aircraft_type"]) == (
        'Military - "U.S." Army', "Crashed\non landing.", 1908, "Wright Flyer III")
    assert one["severity_label"] == "Fatal" and one["fatality_rate"] == 0.5
    assert (two["operator"], two["aboard"], two["flight_number"], two["severity_label"]) == (None, None, "NA-3", "Unknown")
    assert df.schema["fatalities"].dataType.simpleString() == "double"


def test_stored_incidents_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([], INCIDENT_SCHEMA).write.parquet(path)
    plan = trainable(read_incidents(spark, path), ["id", "year"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(severity_label)]" in plan
    assert "ReadSchema: struct<id:bigint,year:int,severity_label:string>" in plan


def test_stored_by_decade(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, 1980 + i % 10 if i < 900 else (1950 if i < 990 else None), "Fatal") for i in range(1000)]
    write_incidents(spark.createDataFrame(rows, "id long, year int, severity_label string"), path)
    stored = spark.read.parquet(path)
    found = select_incidents(stored, decade="1950s")
    assert found.count() == 90 and stored.where("year is null").count() == 10 and stored.count() == 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(decade" in plan and "rebalance" not in plan.lower()
    assert select_incidents(stored, decade="1985s").count() == stored.where("year between 1985 and 1994").count()
    full = read_incidents(spark, path)
    assert full.where("year = 1950").count() == 90


def test_phrase_guards_do_not_change_matches(spark):
    from incidentlake.functions import vocab
    texts = [
        "there were no survivors", "none of the 12 people survived", "all 40 passengers were killed", "both pilots died",
        "all on the plane perished", "a fire broke out", "fired upon", "struck the ground", "struck a\ntree", "the wing then separated",
        "in-flight breakup", "no one was killed", "no deaths", "hospitalised", "non-fatal", "without fatality", "hospital", "",
        "killing all aboard", "no loss of life", "nonefatal", "killed all", "struck by a tree",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, pattern in vocab.SUMMARY_PATTERNS.items():
        fast = C.matches(F.col("t"), pattern, vocab.PHRASE_NEEDS.get(name, ()))
        plain = F.col("t").rlike("(?dU)" + pattern)
        assert values(df, fast) == values(df, plain), name


def test_another_header_order_is_no_swap(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,aboard,fatalities\n1,10,5\n")
    (tmp_path / "b.csv").write_text("id,fatalities,aboard\n2,5,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_incidents_csv(spark, str(tmp_path)).collect()
