"""Structured search: request → predicate, paging, name scoring, batch requests."""

import pytest
from pyspark.sql import functions as F

from firmscope.operators.search import SearchRequest, batch_search, name_index, search, search_predicate

COMPANIES = [
    ("1", "ibm", "technology", "10001+", "us", 1911, ["priority", "vip"]),
    ("2", "acme widgets", "technology", "51-200", "us", 1990, ["vip"]),
    ("3", "beta foods", "food", "11-50", "uk", 2005, []),
    ("4", "gamma tech", "technology", "51-200", "uk", None, None),
    ("5", "ibm consulting", "consulting", "1001-5000", "us", 2015, ["priority"]),
]
SCHEMA = ("company_id string, name string, industry string, size_range string, country string, "
          "year_founded int, tags array<string>")


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame(COMPANIES, SCHEMA)


def ids(df):
    return [r["company_id"] for r in df.orderBy("rank").collect()]


def test_empty_request_matches_all(companies):
    assert ids(search(companies, SearchRequest())) == ["1", "2", "3", "4", "5"]


def test_filters_lowercase_argument(companies):
    assert ids(search(companies, SearchRequest(industry="Technology", country="US"))) == ["1", "2"]


def test_size_range(companies):
    assert ids(search(companies, SearchRequest(size_range="51-200"))) == ["2", "4"]


def test_all_tags_required(companies):
    assert ids(search(companies, SearchRequest(tags=["priority", "vip"]))) == ["1"]
    assert ids(search(companies, SearchRequest(tags=["vip"]))) == ["1", "2"]


def test_one_sided_years_and_falsy_zero(companies):
    assert ids(search(companies, SearchRequest(year_from=2000))) == ["3", "5"]
    assert ids(search(companies, SearchRequest(year_to=1990))) == ["1", "2"]
    # 0 is falsy: no bound; NULL year never matches a bound
    assert ids(search(companies, SearchRequest(year_from=0, year_to=2000))) == ["1", "2"]


def test_paging_offsets_and_disjoint_pages(companies):
    p1 = ids(search(companies, SearchRequest(page=1, size=2)))
    p2 = ids(search(companies, SearchRequest(page=2, size=2)))
    p3 = ids(search(companies, SearchRequest(page=3, size=2)))
    assert p1 == ["1", "2"] and p2 == ["3", "4"] and p3 == ["5"]
    assert SearchRequest(page=3, size=20).offset() == 40
    with pytest.raises(ValueError):
        SearchRequest(page=0).offset()


def test_name_match_scores_and_orders(companies):
    idx = name_index(companies)
    res = search(companies, SearchRequest(name="IBM"), idx).orderBy("rank").collect()
    assert [r["company_id"] for r in res] == ["1", "5"]  # shorter name scores higher (length norm)
    assert res[0]["score"] > res[1]["score"] > 0


def test_no_match_is_empty_with_schema(companies):
    res = search(companies, SearchRequest(name="zzzznonexistent9999"))
    assert res.count() == 0 and "company_id" in res.columns


def test_predicate_true_when_empty(spark):
    assert spark.range(3).where(search_predicate(SearchRequest())).count() == 3


def test_batch_equals_single(spark, companies):
    reqs = [
        (1, None, "technology", None, None, None, None, None, 1, 10),
        (2, None, None, None, "uk", None, None, None, 1, 1),
        (3, None, None, None, "uk", None, None, None, 2, 1),
        (4, "ibm", None, None, None, None, None, None, 1, 10),
        (5, None, None, None, None, 1950, None, ["vip"], 1, 10),
        (6, None, None, None, None, None, None, None, 2, 2),
    ]
    df = spark.createDataFrame(reqs, "request_id long, name string, industry string, size_range string, "
                                     "country string, year_from int, year_to int, tags array<string>, page int, "
                                     "size int")
    idx = name_index(companies)
    out = batch_search(companies, df, idx)
    got = {}
    for r in out.orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["company_id"])
    singles = {
        1: SearchRequest(industry="technology"), 2: SearchRequest(country="uk", size=1),
        3: SearchRequest(country="uk", page=2, size=1), 4: SearchRequest(name="ibm"),
        5: SearchRequest(year_from=1950, tags=["vip"]), 6: SearchRequest(page=2, size=2),
    }
    for rid, req in singles.items():
        assert got.get(rid, []) == ids(search(companies, req, idx)), rid


def test_batch_equals_single_with_year_zero(spark):
    """Data ingested with missing_year=0: year_to alone also returns the companies of year 0."""
    zero = spark.createDataFrame([(*c[:5], c[5] or 0, c[6]) for c in COMPANIES] + [("6", "delta", "food", "11-50", "uk", None, None)], SCHEMA)
    years = [(None, 1990), (0, 2010), (1950, None), (-3, 1920), (None, -1), (1, 1990)]
    reqs = spark.createDataFrame([(i, None, None, None, None, a, b, None, 1, 10) for i, (a, b) in enumerate(years)],
                                 "request_id long, name string, industry string, size_range string, country string, "
                                 "year_from int, year_to int, tags array<string>, page int, size int")
    got = {}
    for r in batch_search(zero, reqs).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["company_id"])
    for i, (a, b) in enumerate(years):
        assert got.get(i, []) == ids(search(zero, SearchRequest(year_from=a, year_to=b))), years[i]
    assert "4" in got[0]
    no_year = zero.withColumn("year_founded", F.lit(None).cast("int"))
    assert batch_search(no_year, reqs).count() == 0


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    from firmscope.sources.tables import companies_from_part
    co = companies_from_part(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "co")
    co.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = stored.where(search_predicate(SearchRequest(industry="ECONOMY", year_from=1990)))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(industry,economy)" in plan
    assert F  # keep import used


def test_batch_search_without_broadcast_equals_with(spark, companies):
    reqs = spark.createDataFrame([(i, None, "technology" if i % 2 else None, None, None, None, None, None, 1 + i % 2, 2)
                                  for i in range(12)],
                                 "request_id long, name string, industry string, size_range string, country string, "
                                 "year_from int, year_to int, tags array<string>, page int, size int")
    a = sorted(tuple(r) for r in batch_search(companies, reqs).select("request_id", "rank", "company_id").collect())
    b = sorted(tuple(r) for r in batch_search(companies, reqs, max_broadcast_requests=0)
               .select("request_id", "rank", "company_id").collect())
    # odd ids: technology (3 companies), page 2 of size 2 → 1 row; even ids: all, page 1 → 2 rows
    assert a == b and len(a) == 6 * 1 + 6 * 2
