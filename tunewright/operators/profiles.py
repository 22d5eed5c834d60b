"""Survey answers to profiles, and the checks a survey makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.functions import fixed, scalars
from tunewright.functions.scalars import col


def unknown_moods(moods: Column | str) -> Column:
    known = F.array(*[F.lit(m) for m in fixed.MOODS])
    return F.array_except(F.coalesce(col(moods), F.array().cast("array<string>")), known)


def mood_targets(moods: Column | str) -> Column:
    """Mean energy and valence of the chosen moods, 3 decimals; 0.5 each for none.

    Null when a mood is outside the vocabulary: such rows are set aside, see
    ``validate_profiles``.
    """
    chosen = F.coalesce(col(moods), F.array().cast("array<string>"))

    def mean(which: int) -> Column:
        pairs = [F.lit(x) for m, t in fixed.MOODS.items() for x in (m, t[which])]
        values = F.transform(chosen, lambda m: F.try_element_at(F.create_map(*pairs), m))
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        value = scalars.round_once(total / F.size(chosen), 3)
        return F.when(F.size(chosen) == 0, 0.5).otherwise(value)

    valid = F.size(unknown_moods(moods)) == 0
    return F.when(valid, F.struct(mean(0).alias("target_energy"), mean(1).alias("target_valence")))


def build_profile(answers: DataFrame, vocabulary: list[str] = fixed.GENRES,
                  keep_ids: bool = False, at: Column | None = None) -> DataFrame:
    """Survey answers to profile rows; a fresh id per survey unless ``keep_ids``."""
    empty = F.array().cast("array<string>")
    user_id = F.col("user_id") if keep_ids else F.uuid()
    stamp = F.current_timestamp() if at is None else at
    return answers.select(
        user_id.alias("user_id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        F.coalesce("favorite_artists", empty).alias("favorite_artists"),
        F.coalesce("recent_artists", empty).alias("recent_artists"),
        F.coalesce("favorite_genres", empty).alias("favorite_genres"),
        F.coalesce("moods", empty).alias("selected_moods"),
        scalars.genre_multi_hot("favorite_genres", vocabulary).alias("genre_vector"),
        mood_targets("moods").alias("mood_targets"),
        F.coalesce("purpose", F.lit("relax")).alias("purpose"),
        scalars.exploration_weight(F.coalesce("exploration", F.lit("mixed"))).alias("exploration_weight"),
        F.coalesce("popularity", F.lit("mixed")).alias("popularity_preference"),
    )


def validate_profiles(answers: DataFrame) -> DataFrame:
    """Adds ``problems``, the list of unmet survey rules, and ``valid``."""
    name = scalars.strip(F.coalesce("name", F.lit("")))

    def count(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0))

    problems = F.array_compact(F.array(
        F.when(F.length(name) == 0, "name is blank"),
        F.when(F.length(name) > 60, "name is longer than 60"),
        F.when(~count("favorite_artists").between(3, 5), "favorite_artists needs 3 to 5"),
        F.when(~count("recent_artists").between(2, 3), "recent_artists needs 2 to 3"),
        F.when(count("favorite_genres") < 1, "favorite_genres needs 1"),
        F.when(count("moods") < 1, "moods needs 1"),
        F.when(F.size(unknown_moods("moods")) > 0, "moods holds an unknown mood"),
    ))
    return answers.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0)


def validate_seed_picks(picks: DataFrame) -> DataFrame:
    """Whether each user's seed set holds 2 to 5 distinct songs."""
    counts = picks.select("user_id", "song_id").distinct().groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_seeds"))
    return counts.withColumn("valid", F.col("n_seeds").between(2, 5))
