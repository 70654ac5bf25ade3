import pytest

from ratelathe.operators import lenient_load as ll

GOOD = [
    ("ratings.csv", "1,2,3.5,9"),
    ("ratings.csv", '"1","2","4","9"\r'),
    ("ratings.csv", "007,2,5.0,0"),
    ("ratings.dat", "1::2::0.5::9"),
    ("movies.csv", '3,"A ""b"", c",'),
    ("movies.csv", "3,x,Drama|Comedy"),
    ("movies.csv", '3,"",a'.replace('""', '"t"')),
    ("movies.dat", '4::Say "hi": now::Drama'),
    ("movies.dat", "4::t::"),
]
BAD = [
    ("ratings.csv", "1,2,3.5", "wrong column count"),
    ("ratings.csv", "1,2,3.5,9,", "wrong column count"),
    ("ratings.csv", '1,2,"3.5,9', "broken quoting"),
    ("ratings.csv", '1,2,3"5,9', "broken quoting"),
    ("ratings.csv", "0,2,3.5,9", "invalid user id"),
    ("ratings.csv", "+1,2,3.5,9", "invalid user id"),
    ("ratings.csv", " 1,2,3.5,9", "invalid user id"),
    ("ratings.csv", "1,-2,3.5,9", "invalid movie id"),
    ("ratings.csv", "1,2,0,9", "invalid rating"),
    ("ratings.csv", "1,2,5.5,9", "invalid rating"),
    ("ratings.csv", "1,2,3.50,9", "invalid rating"),
    ("ratings.csv", "1,2,3.5,", "invalid timestamp"),
    ("ratings.csv", "1,2,3.5,1e9", "invalid timestamp"),
    ("ratings.csv", "1,2,3.5,9\r\r", "invalid timestamp"),
    ("ratings.csv", "", "blank line"),
    ("movies.csv", "  \r", "blank line"),
    ("movies.csv", '3,"",a', "blank title"),
    ("movies.csv", "3,  ,a", "blank title"),
    ("movies.csv", '3,"a" ,b', "broken quoting"),
    ("movies.csv", '3,x "y",b', "broken quoting"),
    ("movies.csv", "x,t,b", "invalid movie id"),
    ("movies.dat", "4::t", "wrong column count"),
    ("movies.dat", "4::a::b::c", "wrong column count"),
    ("movies.dat", '"4"::t::a', "invalid movie id"),
    ("other.csv", "1,2,3.5,9", "unknown file"),
    (None, "1,2,3.5,9", "unknown file"),
    ("ratings.csv", None, "missing line"),
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, f, t) for k, (f, t, *_) in enumerate(GOOD + BAD)]
    return spark.createDataFrame(rows, "line_id bigint, file_name string, line_text string")


def test_reasons(lines):
    found = {r["line_id"]: r["reason"] for r in ll.rejected(lines).collect()}
    assert found == {k + len(GOOD): reason for k, (_, _, reason) in enumerate(BAD)}


def test_records(lines):
    ratings = [tuple(r) for r in ll.rating_records(lines).orderBy("line_id").collect()]
    assert ratings == [(0, 1, 2, 3.5, 9), (1, 1, 2, 4.0, 9), (2, 7, 2, 5.0, 0), (3, 1, 2, 0.5, 9)]
    movies = [tuple(r) for r in ll.movie_records(lines).orderBy("line_id").collect()]
    assert movies == [(4, 3, 'A "b", c', ""), (5, 3, "x", "Drama|Comedy"), (6, 3, "t", "a"), (7, 4, 'Say "hi": now', "Drama"), (8, 4, "t", "")]


def test_long_lines_and_huge_numbers(spark):
    long = '3,"' + 'a""' * 50_000 + '",x'
    rows = [(0, "movies.csv", long, "c"), (1, "ratings.csv", "9" * 30 + ",1,3,1", "c"), (2, "movies.csv", '"' * 99_999, "c")]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_text string, kind string")
    assert len(ll.movie_records(df).first()["title"]) == 100_000
    assert ll.rating_records(df).first()["raw_user_id"] is None
    assert [r["line_id"] for r in ll.rejected(df).collect()] == [2]


def test_no_lines(spark):
    df = spark.createDataFrame([], "line_id bigint, file_name string, line_text string")
    assert ll.rejected(df).count() == 0 and ll.loaded(df).count() == 0
