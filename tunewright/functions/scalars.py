"""Column expressions over single rows: parsing, bands, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunewright.functions import fixed

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without whitespace of any kind at its ends (``trim`` alone removes only blanks)."""
    return F.trim(col(c), F.lit(fixed.WHITESPACE))


def number_or_null(c: Column | str) -> Column:
    """Double value of a numeric text, null for anything else."""
    c = col(c).cast("string")
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def safe_float(c: Column | str) -> Column:
    """Double value of a numeric text, 0.0 for anything else."""
    return F.coalesce(number_or_null(c), F.lit(0.0))


def round_half_even(c: Column | str, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    ``bround`` decides ties on the shortest decimal text, so 0.475 (stored a
    little below the tie) would go up. Here the product with 10**digits is held
    as an exact pair of doubles and compared with the midpoint.
    """
    x = col(c).cast("double")
    scale = F.lit(float(10**digits))
    below = F.floor(x * scale).cast("double")
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    side = (high * scale - (below + F.lit(0.5))) + (x - high) * scale
    odd = F.pmod(below, F.lit(2.0)) == F.lit(1.0)
    step = F.when((side > 0) | ((side == 0) & odd), F.lit(1.0)).otherwise(F.lit(0.0))
    return (below + step) / scale


def round_once(c: Column, digits: int) -> Column:
    """``round_half_even`` for an expensive input: the value is computed once and then named."""
    return F.transform(F.array(c), lambda x: round_half_even(x, digits))[0]


def split_artists(c: Column | str) -> Column:
    """Distinct trimmed names of a ``;`` list."""
    return F.array_distinct(F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda name: strip(name)))


def primary_artist(c: Column | str) -> Column:
    return strip(F.split_part(strip(col(c)), F.lit(";"), F.lit(1)))


def parse_release(c: Column | str) -> Column:
    """Midnight of a ``YYYY-MM-DD`` text (padding optional), else null."""
    text = strip(col(c))
    shape = text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    return F.when(shape, F.try_to_timestamp(text, F.lit("yyyy-M-d")))


def freshness(released: Column | str, as_of: Column) -> Column:
    """exp(-0.01 * whole days since release), 1.0 for future dates, 0.0 for none."""
    day = col(released).cast("timestamp")
    micros = F.unix_micros(as_of) - F.unix_micros(day)
    days = F.greatest(F.lit(0.0), F.floor(micros / F.lit(86_400_000_000.0)).cast("double"))
    return F.when(day.isNotNull(), F.exp(F.lit(-fixed.FRESHNESS_DECAY) * days)).otherwise(0.0)


def energy_band(c: Column | str) -> Column:
    e = col(c)
    return (
        F.when(e >= 0.8, "very high energy")
        .when(e >= 0.6, "high energy")
        .when(e >= 0.4, "moderate energy")
        .when(e >= 0.2, "low energy")
        .otherwise("very calm")
    )


def valence_band(c: Column | str) -> Column:
    v = col(c)
    return (
        F.when(v >= 0.7, "very upbeat")
        .when(v >= 0.5, "positive")
        .when(v >= 0.3, "neutral")
        .otherwise("melancholy")
    )


def popularity_band(c: Column | str) -> Column:
    p = col(c)
    return (
        F.when(p >= 0.8, "very popular")
        .when(p >= 0.6, "popular")
        .when(p >= 0.4, "moderately popular")
        .otherwise("niche underground")
    )


def use_case_tags(energy="energy", tempo="tempo_bpm", valence="valence",
                  instrumental="instrumentalness", speech="speechiness") -> Column:
    """Use-case phrases whose thresholds the song meets, in a fixed order."""
    e, t, v, i, s = (col(c) for c in (energy, tempo, valence, instrumental, speech))
    phrases = F.array_compact(F.array(
        F.when((e >= 0.7) & (t >= 120), "working out exercise gym"),
        F.when((e <= 0.5) & (i >= 0.4) & (s < 0.1), "studying focus concentration"),
        F.when((v >= 0.6) & (e >= 0.5), "uplifting happy cheerful"),
        F.when((v <= 0.35) & (e <= 0.5), "melancholy sad reflection emotional"),
        F.when((e <= 0.35) & (i >= 0.5), "sleeping relaxing meditation calm"),
        F.when((e >= 0.6) & (v >= 0.5), "party dancing social"),
    ))
    return F.when(F.size(phrases) > 0, F.array_join(phrases, " ")).otherwise("general listening")


def release_era(c: Column | str) -> Column:
    """Decade such as ``1990s`` from the leading year, empty when there is none."""
    head = strip(F.left(col(c), F.lit(4)))
    year = F.when(head.rlike(r"^[+-]?[0-9]+$"), head.try_cast("int"))
    decade = F.floor(year / F.lit(10)) * F.lit(10)
    return F.coalesce(F.concat(decade.cast("string"), F.lit("s")), F.lit(""))


def song_description() -> Column:
    """Searchable one-line description of a typed catalog row."""
    def tail(c: Column, lead: str) -> Column:
        return F.when(c != "", F.concat(F.lit(lead), c)).otherwise("")

    title = F.coalesce(strip("title"), F.lit("Unknown"))
    artist = F.coalesce(primary_artist("artist_name"), F.lit("Unknown"))
    genre = F.coalesce(strip("genre"), F.lit(""))
    mood = F.coalesce(strip("mood"), F.lit(""))
    era = release_era(strip(F.coalesce(F.col("release_date"), F.lit(""))))
    tempo = F.format_string("%.0f", round_half_even("tempo_bpm", 0))
    valence = F.format_string("%.2f", round_half_even("valence", 2))
    lyrics = F.when(F.col("instrumentalness") >= 0.5, " instrumental no lyrics").otherwise("")
    return F.concat(
        F.lit('"'), title, F.lit('" by '), artist,
        tail(genre, " — "), tail(mood, " "), tail(era, " "), F.lit(". "),
        energy_band("energy"), F.lit(" "), tempo, F.lit(" BPM "),
        valence_band("valence"), F.lit(" valence "), valence, lyrics, F.lit(". "),
        popularity_band("popularity_norm"), F.lit(". Good for "), use_case_tags(), F.lit("."),
    )


def genre_multi_hot(genres: Column | str, vocabulary=fixed.GENRES) -> Column:
    chosen = F.coalesce(col(genres), F.array().cast("array<string>"))
    words = F.array(*[F.lit(g) for g in vocabulary])
    return F.transform(words, lambda g: F.when(F.array_contains(chosen, g), 1.0).otherwise(0.0))


def genre_key(genre: Column | str, vocabulary=fixed.GENRES) -> Column:
    """Position of the lower-cased genre in the vocabulary (1-based), 0 when outside."""
    words = F.array(*[F.lit(g) for g in vocabulary])
    name = F.lower(strip(F.coalesce(col(genre), F.lit(""))))
    return F.array_position(words, name).cast("int")


def genre_similarity(genre_vector: Column | str, genre: Column | str,
                     vocabulary=fixed.GENRES) -> Column:
    """Weight the user placed on the song's genre, 0.0 outside the vocabulary."""
    place = genre_key(genre, vocabulary)
    weight = F.try_element_at(col(genre_vector), F.when(place > 0, place))
    return F.coalesce(weight, F.lit(0.0))


def mood_level(c: Column | str) -> Column:
    """Energy or valence text as used by the mood score: blank is 0.5, no number is null."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(text == "", F.lit(0.5)).otherwise(number_or_null(text))


def mood_compatibility(energy, valence, target_energy, target_valence) -> Column:
    """1 - mean absolute distance to the targets, rounded to 4 decimals; null level -> 0.0."""
    te = F.coalesce(col(target_energy), F.lit(0.5))
    tv = F.coalesce(col(target_valence), F.lit(0.5))
    distance = (F.abs(col(energy) - te) + F.abs(col(valence) - tv)) / F.lit(2.0)
    return F.coalesce(round_half_even(F.lit(1.0) - distance, 4), F.lit(0.0))


def exploration_weight(key: Column | str) -> Column:
    pairs = [F.lit(x) for kv in fixed.EXPLORATION.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), F.lit(0.5))


def name_match(artists: Column | str, favourites: Column | str, recent: Column | str) -> Column:
    """1.0 for a favourite artist, 0.7 for a recent one, else 0.0."""
    a = col(artists)
    return (
        F.when(F.arrays_overlap(a, col(favourites)), fixed.FAVOURITE_MATCH)
        .when(F.arrays_overlap(a, col(recent)), fixed.RECENT_MATCH)
        .otherwise(0.0)
    )


def familiar_score(artist: Column, genre: Column, popularity: Column) -> Column:
    a, g, p = fixed.FAMILIAR_WEIGHTS
    return F.lit(a) * artist + F.lit(g) * genre + F.lit(p) * popularity


def discovery_score(genre: Column, mood: Column, popularity: Column) -> Column:
    g, m, p = fixed.DISCOVERY_WEIGHTS
    return round_half_even(F.lit(g) * genre + F.lit(m) * mood + F.lit(p) * popularity, 4)


def fallback_score() -> Column:
    """Weighted feature sum used when no model is given; the penalty takes no part."""
    total = None
    for name, weight in fixed.FALLBACK_WEIGHTS.items():
        term = F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
        total = term if total is None else total + term
    return total


def weighted_score(weights: dict[str, float], genre: str | None = None, mood: str | None = None,
                   genre_weight: float = 0.0, mood_weight: float = 0.0) -> Column:
    """Static content score with caller-supplied weights."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    if genre is not None:
        total = total + F.when(F.lower(strip("genre")) == genre.lower(), float(genre_weight)).otherwise(0.0)
    if mood is not None:
        total = total + F.when(F.lower(strip("mood")) == mood.lower(), float(mood_weight)).otherwise(0.0)
    return total
