import pytest
from pyspark.sql import functions as F

from incidentlake import lookup, page_info, pending_extraction, search_incidents, select_incidents
from incidentlake.operators import search as S

SCHEMA = (
    "id long, date string, location string, operator string, aircraft_type string, fatalities double,"
    " severity_label string, cluster_id int, aboard double, summary string, year int"
)


@pytest.fixture(scope="module")
def df(spark):
    rows = []
    for i in range(400):
        rows.append((
            i, f"{1950 + i % 50}-01-{1 + i % 28:02d}", None if i % 11 == 0 else f"Town {i % 13}",
            "50%_off" if i == 7 else (None if i % 9 == 0 else f"Operator {i % 5}"), "Boeing" if i % 2 else None,
            None if i % 10 == 0 else float(i % 17), "Fatal" if i % 3 else "Minor", i % 4, float(i % 6),
            None if i % 8 == 0 else f"Text {i}", 1950 + i % 50,
        ))
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_decade(df):
    assert select_incidents(df, decade="abc").count() == 400
    assert select_incidents(df, decade="All", severity="All").count() == 400
    assert {r["year"] for r in select_incidents(df, decade="1960s").collect()} == set(range(1960, 1970))


def test_unknown_sort_key_means_date(df):
    assert ids(search_incidents(df, sort_key="nothing")) == ids(search_incidents(df, sort_key="date"))


def test_page_past_the_end_is_empty(df):
    assert ids(search_incidents(df, page=99, page_size=100)) == []
    assert page_info(df, 100).first().asDict() == {"total": 400, "total_pages": 4}
    assert page_info(df.where("id < 0")).first().asDict() == {"total": 0, "total_pages": 1}


@pytest.mark.parametrize("key", ["date", "operator", "fatalities"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_all_ways_to_a_page_agree(df, monkeypatch, key, direction):
    seen = []
    for reach in (10_000, 0):
        monkeypatch.setattr(S, "HEAP_REACH", reach)
        pages = [ids(search_incidents(df, sort_key=key, sort_dir=direction, page=p, page_size=90)) for p in (1, 3, 5)]
        seen.append(pages)
    assert seen[0] == seen[1]
    assert len(seen[0][2]) == 40


def test_pages_cover_everything_once(df):
    got = [i for p in range(1, 5) for i in ids(search_incidents(df, sort_key="operator", page=p, page_size=100))]
    assert sorted(got) == list(range(400))


def test_term(df):
    assert ids(search_incidents(df, term="50%_OFF", escape=True)) == [7]
    assert ids(search_incidents(df, term="5__")) != []
    assert select_incidents(df, term="  ").count() == 400
    assert select_incidents(df, term="back\\slash").count() == 0


def test_bounds(df):
    for bad in ({"page": 0}, {"page_size": 101}, {"page_size": 0}, {"sort_dir": "up"}):
        with pytest.raises(ValueError):
            search_incidents(df, **bad)
    for limit in (99, 5001):
        with pytest.raises(ValueError):
            S.projection_points(df, limit)


def test_lookup(df):
    assert ids(lookup(df, "id", 17)) == [17]
    assert ids(lookup(df, "id", 1717)) == []


@pytest.mark.parametrize("reach", [200, 0])
def test_queue(df, monkeypatch, reach):
    monkeypatch.setattr(S, "HEAP_REACH", reach)
    queue = df.withColumn("extracted_cause_category", F.when(F.col("id") % 2 == 0, "Fire"))
    waiting = [r for r in queue.collect() if r["summary"] is not None and r["extracted_cause_category"] is None]
    assert pending_extraction(queue).count() == len(waiting)
    assert pending_extraction(queue, 0).count() == 0
    best = sorted(waiting, key=lambda r: (-(r["fatalities"] if r["fatalities"] is not None else -1), r["id"]))[:20]
    assert sorted(ids(pending_extraction(queue, 20))) == sorted(r["id"] for r in best)
