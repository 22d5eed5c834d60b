"""Row-wise rules against hand-checked values and Python's own rounding."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tunewright.functions import fixed, scalars
from tunewright.operators import profiles
from tunewright.sources import catalog


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "n int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], names).select(column.alias("v")).first()["v"]


def test_round_half_even_equals_python_round(spark):
    rng = random.Random(3)
    numbers = [0.125, 0.375, 0.295, 0.475, 2.5, 3.5, -2.5, -0.5, 0.12345, 1e-9, 0.0, 123456.789]
    numbers += [rng.uniform(-3, 300) for _ in range(2000)] + [rng.randrange(-40000, 40000) / 2000 for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    for digits in (0, 2, 3, 4):
        got = [r["v"] for r in rows.select("x", scalars.round_half_even("x", digits).alias("v")).collect()]
        assert got == [round(x, digits) for x in numbers]


@pytest.mark.parametrize("raw, value", [
    ("1.5", 1.5), (" 2 ", 2.0), ("-3e2", -300.0), (".5", 0.5), ("", 0.0), (None, 0.0), ("abc", 0.0), ("1d", 0.0), ("5-LOW", 0.0),
])
def test_safe_float(spark, raw, value):
    assert one(spark, scalars.safe_float("c"), c=("string", raw)) == value


@pytest.mark.parametrize("raw, day", [
    ("2020-01-05", "2020-01-05"), (" 2020-1-5 ", "2020-01-05"), ("2020-01-05 10:00", None), ("2020-13-01", None),
    ("2021-02-30", None), ("", None), (None, None),
])
def test_parse_release(spark, raw, day):
    shown = F.date_format(scalars.parse_release("c"), "yyyy-MM-dd")
    assert one(spark, shown, c=("string", raw)) == day


@pytest.mark.parametrize("released, value", [
    ("2024-01-01", 1.0), ("2023-09-23", math.exp(-1.0)), ("2023-01-01", math.exp(-3.65)), ("2024-05-01", 1.0), ("bad", 0.0),
])
def test_freshness(spark, released, value):
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = one(spark, scalars.freshness(scalars.parse_release("c"), as_of), c=("string", released))
    assert got == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize("moods, targets", [
    (["Energetic", "Upbeat"], (0.7, 0.775)), (["Calm", "Melancholic"], (0.3, 0.35)),
    (["Energetic", "Calm", "Melancholic"], (0.467, 0.467)), ([], (0.5, 0.5)), (None, (0.5, 0.5)), (["Dreamy"], None),
])
def test_mood_targets(spark, moods, targets):
    got = one(spark, profiles.mood_targets("c"), c=("array<string>", moods))
    assert (tuple(got) if got else None) == targets


def test_genre_vector_and_similarity(spark):
    hot = one(spark, scalars.genre_multi_hot("c"), c=("array<string>", ["alternative", "classical", "country", "edm"]))
    assert [i for i, x in enumerate(hot) if x] == [1, 6, 7, 9] and len(hot) == 30
    for genre, value in ((" EDM ", 1.0), ("jazz", 0.0), ("lofi", 0.0), (None, 0.0)):
        got = one(spark, scalars.genre_similarity("v", "g"), v=("array<double>", hot), g=("string", genre))
        assert got == value


@pytest.mark.parametrize("energy, valence, value", [
    ("0.8", "0.5", 0.7), ("", "0.9", 0.95), (None, None, 0.75), ("loud", "0.5", 0.0), ("0", "0.9", 0.7),
])
def test_mood_compatibility(spark, energy, valence, value):
    got = one(spark, scalars.mood_compatibility(scalars.mood_level("e"), scalars.mood_level("v"), F.lit(0.6), F.lit(0.9)),
              e=("string", energy), v=("string", valence))
    assert got == value


def test_discovery_score(spark):
    assert one(spark, scalars.discovery_score(F.lit(1.0), F.lit(0.7), F.lit(0.4))) == 0.745


@pytest.mark.parametrize("key, weight", [("familiar", 0.1), ("mixed", 0.5), ("discover", 0.9), ("other", 0.5), (None, 0.5)])
def test_exploration_weight(spark, key, weight):
    assert one(spark, scalars.exploration_weight("c"), c=("string", key)) == weight


@pytest.mark.parametrize("raw, era", [("1999-05-01", "1990s"), ("2004", "2000s"), ("", ""), (None, ""), ("May 2004", "")])
def test_release_era(spark, raw, era):
    assert one(spark, scalars.release_era("c"), c=("string", raw)) == era


def test_description_of_a_sparse_row(spark):
    row = {c: "" for c in catalog.TEXT_COLUMNS}
    row.update(song_id="1", title="Sunrise City", artist_name="Neon Echo;Other", genre="pop", mood="happy",
               energy="0.82", tempo_bpm="118", valence="0.84")
    schema = ", ".join(f"{c} string" for c in catalog.TEXT_COLUMNS)
    raw = spark.createDataFrame([tuple(row.values())], schema).withColumn("song_ord", F.lit(0))
    got = catalog.type_catalog(raw).select(scalars.song_description().alias("t")).first()["t"]
    assert got == ('"Sunrise City" by Neon Echo — pop happy. very high energy 118 BPM very upbeat valence 0.84. '
                   "niche underground. Good for uplifting happy cheerful party dancing social.")


def test_fixed_values_agree():
    assert fixed.GENRES == sorted(fixed.GENRES) and len(fixed.GENRES) == 30
    assert sum(fixed.FALLBACK_WEIGHTS.values()) == pytest.approx(1.0)


def test_validation_reasons(spark):
    rows = spark.createDataFrame(
        [(1, "Ann", ["a", "b", "c"], ["d", "e"], ["pop"], ["Calm"]), (2, " ", ["a"], [], [], ["Dreamy"])],
        "user_id int, name string, favorite_artists array<string>, recent_artists array<string>, "
        "favorite_genres array<string>, moods array<string>")
    good, bad = profiles.validate_profiles(rows).orderBy("user_id").collect()
    assert good["valid"] and not bad["valid"]
    assert len(bad["problems"]) == 5


@pytest.mark.parametrize("raw", ["\tAnn;Bob\n", "  Ann  ;　Bob", "Ann\r;Bob\x0b"])
def test_strip_and_artists(spark, raw):
    assert one(spark, scalars.split_artists("c"), c=("string", raw)) == [x.strip() for x in raw.split(";")] == ["Ann", "Bob"]
    assert one(spark, scalars.primary_artist("c"), c=("string", raw)) == "Ann"
