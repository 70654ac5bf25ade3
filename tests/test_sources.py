import json
import os

import pytest
from pyspark.sql import functions as F

from ratelathe.plans import prepare
from ratelathe.sources import artifacts, processed, raw

GENRES = ["unknown", "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western"]


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, lines in files.items():
        with open(os.path.join(folder, name), "w", encoding="latin-1") as file:
            file.write("".join(f"{x}\n" for x in lines))
    return str(folder)


def item(number, title, *active):
    return "|".join([str(number), title, "01-Jan-1995", "", "url", *("1" if g in active else "0" for g in GENRES)])


@pytest.fixture
def modern(tmp_path):
    return write(tmp_path / "modern", {
        "ratings.csv": ["userId,movieId,rating,timestamp", "10,2,4.0,1000", "10,5,3.5,1001", "11,2,5.0,1002"],
        "movies.csv": ["movieId,title,genres", '2,"Movie, ""Two""",Drama', "5,Movie Five,Comedy", "8,Movie Eight,Action"],
        "links.csv": ["movieId,imdbId,tmdbId", "2,0002,200", "5,0005,", "8,0008,800"],
        "tags.csv": ["userId,movieId,tag,timestamp", "10,2,good,1100", "12,8,unrated-user-tag,1101"],
    })


@pytest.fixture
def hundred(tmp_path):
    folds = {f"u{k}.{p}": [] for k in range(2, 6) for p in ("base", "test")}
    return write(tmp_path / "hundred", folds | {
        "u.data": ["1\t10\t4\t874965758", "1\t20\t5\t874965759", "2\t10\t3\t874965760"],
        "u.genre": [f"{g}|{k}" for k, g in enumerate(GENRES)] + ["", "broken"],
        "u.item": [item(10, "Toy", "Action", "Drama"), item(20, "Sérieux", "Comedy", "Drama"), item(30, "None")],
        "u1.base": ["1\t10\t4\t874965758", "2\t10\t3\t874965760"],
        "u1.test": ["1\t20\t5\t874965759"],
    })


@pytest.fixture
def million(tmp_path):
    return write(tmp_path / "million", {
        "ratings.dat": ["1::10::4::978300760", "1::20::5::978302109", "2::10::3::978301968", ""],
        "movies.dat": ["10::Toy: Movie (1995)::Animation|Children's", "20::Sérieux (1994)::Drama", "30::Unrated (1993)::Comedy"],
        "users.dat": ["1::F::1::10::48067", "2::M::56::16::70072"],
    })


@pytest.fixture
def ten_million(tmp_path):
    return write(tmp_path / "ten", {
        "ratings.dat": ["1::10::4::1112486027", "1::20::5::1112484676", "2::10::3.5::1112484819"],
        "movies.dat": ["10::Toy::Animation", "20::Serious::Drama"],
        "tags.dat": ["1::10::animated::1112486100", "3::30::unrated-user-tag::1112486200"],
    })


def made(spark, folder, tmp_path, short="toy", **options):
    out = str(tmp_path / "out")
    return prepare.prepare_dataset(spark, folder, out, dataset_name="Toy", dataset_short_name=short, split_family="benchmark_random_v1", **options)


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_modern_layout(spark, modern, tmp_path):
    manifest = made(spark, modern, tmp_path)
    x = processed.load_table(spark, manifest, "interactions")
    assert column(x, "user_idx", "row_id") == [0, 0, 1] and column(x, "item_idx", "row_id") == [0, 1, 0]
    movies = processed.load_table(spark, manifest, "movies")
    assert column(movies, "item_idx", "raw_item_id") == [0, 1, None]
    assert column(movies, "title", "raw_item_id")[0] == 'Movie, "Two"'
    assert column(processed.load_table(spark, manifest, "tags"), "user_idx", "raw_user_id") == [0, None]
    assert column(processed.load_table(spark, manifest, "links"), "tmdb_id", "raw_item_id") == ["200", None, "800"]
    m = processed.read_json(manifest)
    assert m["counts"] == {"interactions": 3, "users": 2, "rated_items": 2, "catalog_items": 3, "tags": 2, "links": 3}
    assert m["rating_range"] == {"min": 3.5, "max": 5.0} and m["validation"]["counts"]["ratings"] == 3
    data = processed.load_ratings(spark, manifest)
    assert (data.n_users, data.n_items, data.rows.columns) == (2, 2, ["row_id", "user_idx", "item_idx", "rating"])
    with pytest.raises(FileExistsError):
        made(spark, modern, tmp_path)
    made(spark, modern, tmp_path, overwrite=True, dtype="float64")
    assert dict(processed.load_table(spark, manifest, "interactions").dtypes)["rating"] == "double"


def test_hundred_layout_with_folds(spark, hundred, tmp_path):
    manifest = made(spark, hundred, tmp_path, "ml100k")
    movies = processed.load_table(spark, manifest, "movies")
    assert column(movies, "genres", "raw_item_id") == ["Action|Drama", "Comedy|Drama", raw.NO_GENRES]
    assert column(movies, "title", "raw_item_id")[1] == "Sérieux"
    assert processed.load_table(spark, manifest, "tags").count() == 0 == processed.load_table(spark, manifest, "links").count()
    folds = processed.load_table(spark, manifest, "official_folds")
    assert column(folds.filter("part = 'train'"), "row_id", "row_id") == [0, 2] and column(folds.filter("part = 'test'"), "row_id", "row_id") == [1]


def test_million_and_ten_million_layouts(spark, million, ten_million, tmp_path):
    assert raw.validate_folder(spark, million) == {"raw_dir": million, "format_family": "legacy_1m", "counts": {"links": 0, "tags": 0, "ratings": 3, "movies": 3, "users": 2}}
    movies = raw.read_movies(spark, million, "legacy_1m")
    assert column(movies, "title", "raw_item_id") == ["Toy: Movie (1995)", "Sérieux (1994)", "Unrated (1993)"]
    manifest = made(spark, ten_million, tmp_path)
    tags = processed.load_table(spark, manifest, "tags")
    assert column(tags, "user_idx", "raw_user_id") == [0, None] and column(tags, "item_idx", "raw_user_id") == [0, None]
    assert [f.simpleString() for f in processed.load_table(spark, manifest, "links").schema] == ["raw_item_id:int", "item_idx:int", "imdb_id:string", "tmdb_id:string"]


def test_wrong_input(spark, modern, tmp_path):
    with pytest.raises(FileNotFoundError):
        raw.detect_layout(spark, str(tmp_path))
    with pytest.raises(ValueError, match="format_family"):
        raw.validate_folder(spark, modern, "other")
    bad = write(tmp_path / "bad", {"ratings.csv": ["userId,movieId,score,timestamp", "1,2,3,4"]})
    with pytest.raises(ValueError, match="header"):
        raw.check_header(spark, f"{bad}/ratings.csv", raw.HEADERS["ratings"])
    short = write(tmp_path / "short", {"ratings.dat": ["1::2::3"]})
    with pytest.raises(Exception, match="(?i)malformed"):
        raw.read_double_colon(spark, f"{short}/ratings.dat", raw.HEADERS["ratings"]).collect()
    empty = write(tmp_path / "empty", {"ratings.dat": [], "movies.dat": [], "users.dat": []})
    with pytest.raises(ValueError, match="no ratings"):
        made(spark, empty, tmp_path)
    assert raw.read_folds(spark, modern) is None


def test_plan_reads_four_columns(spark, modern, tmp_path, capsys):
    manifest = made(spark, modern, tmp_path)
    processed.load_ratings(spark, manifest).rows.filter("rating > 4").select("user_idx").explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<user_idx:int,rating:float>" in plan and "PushedFilters: [IsNotNull(rating), GreaterThan(rating,4.0)]" in plan


def test_artifacts(spark, tmp_path):
    from datetime import datetime, timezone

    now = datetime(2026, 1, 31, 23, 59, 59, tzinfo=timezone.utc)
    first, second = (artifacts.reserve_folder(str(tmp_path), "x", now) for _ in range(2))
    assert os.path.basename(first) == "2026-01-31T235959Z_x" and os.path.basename(second) == "2026-02-01T000000Z_x"
    processed.write_json(f"{first}/run_manifest.json", {"b": 1, "a": [2]})
    assert json.load(open(f"{first}/run_manifest.json")) == {"a": [2], "b": 1}
    assert [r["run_dir"] for r in artifacts.scan_documents(spark, str(tmp_path), "run_manifest.json").collect()] == [os.path.basename(first)]
    artifacts.write_yaml(f"{first}/c.yaml", {"z": 1, "a": {"b": [1, 2]}})
    assert artifacts.read_yaml(f"{first}/c.yaml") == {"z": 1, "a": {"b": [1, 2]}} and open(f"{first}/c.yaml").read().startswith("z")
    with open(f"{first}/l.json", "w") as file:
        file.write("[1]")
    with pytest.raises(ValueError):
        processed.read_json(f"{first}/l.json")
    assert artifacts.render_markdown(["a"], [["1"]]) == "| a |\n| --- |\n| 1 |\n"
    assert artifacts.render_csv(["a", "b"], [[None, "x,y"]]) == 'a,b\n,"x,y"\n'


def test_genre_flags(spark):
    df = spark.createDataFrame([(["1", "0", "1"],), (["0", "0", "0"],)], "f array<string>")
    assert [r[0] for r in df.select(raw.genres_of_flags(F.col("f"), ["A", "B", "C"])).collect()] == ["A|C", raw.NO_GENRES]
