"""Award badges per user: computed from visits, then merged into the stored award table.

Visits carry ``visit_id``, ``user_id``, ``place_name``, ``date_start`` and ``attrs_json`` (JSON by attribute id).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.attributes import with_json_attrs
from ..operators.aggregate import count_if, exact_sum
from ..operators.sync import merge_awards
from ..operators.windows import longest_run
from ..session import settle


@dataclass(frozen=True)
class Badge:
    """One award rule: a measure reaching a threshold (or passing it, with ``above``)."""

    name: str
    description: str
    measure: str
    threshold: float
    meaning: str
    icon: str
    above: bool = False


# Ids of the attributes the rules read.
ATTRS = {
    "start": ("1715", "string"),
    "duration": ("1717", "string"),
    "km": ("1718", "double"),
    "litter": ("1722", "string"),
}
CLEAN = ("Spotless", "Mostly Clean")

# Award rules of a user's own totals.
BADGES = [
    Badge("Early Bird", "5 walks started before 08:00", "early", 5, "Total number of walks started before 08:00", "alarm"),
    Badge("Sperm Whale migration", "Walked as far as a Sperm Whale migrates", "km", 4000, "Total distance walked in km", "whale", above=True),
    Badge("Porpoise", "Walked the same beach at least twice, the pod Size for Harbour Porpoise", "same_place", 2, "Maximum number of walks on the same beach", "porpoise"),
    Badge("Bottlenose Dolphin", "Walked the same beach at least 10 times, the pod size for Bottlenose Dolphin", "same_place", 10, "Maximum number of walks on the same beach", "dolphin"),
    Badge("Short-beaked Common Dolphin", "Walked the same beach at least 100 times, the pod size for Common Dolphin", "same_place", 100, "Maximum number of walks on the same beach", "dolphin"),
    Badge("Going the distance", "A single track of at least 5km", "longest_km", 5, "Maximum distance of a single track for this user", "backpack"),
    Badge("Time to Track", "At least one month with at least 10 hours tracked", "month_hours", 10, "Maximum number of hours tracked in a month", "time"),
    Badge("Beachmaster", "At least 10 records on a single beach", "place_records", 10, "Maximum number of records on a single beach", "anchor"),
    Badge("Clean Conscience", "Recorded at least 15 clean beach conditions", "clean", 15, "Number of times a clean beach has been recorded", "cld-cloud-phone"),
    Badge("Four week streak", "Recorded a track for 4 weeks in a row.", "weeks_in_a_row", 4, "Maximum weeks in a row this user has recorded a track", "date-check"),
]
# The four quarters as the quarterly rules word them.
QUARTERS = {
    1: ("January to March", "Maximum number of miles January to March for the current year"),
    2: ("April to June", "Maximum number of miles April to June for the current year"),
    3: ("July to September", "Maximum number of miles July to September for the current year"),
    4: ("October to December", "Maximum number of miles walked October to December for the current year"),
}
QUARTER_MILES = 50
#: Factor the rules apply to kilometres and call miles. The true factor would be 0.621371.
MILE_FACTOR = 1.604

# Named days (month * 100 + day), award name, day as text, icon.
NAMED_DAYS = [
    (227, "Polar Bear Day", "27th February", "polar-bear"),
    (322, "International Seal Day", "22nd March", "seal"),
    (414, "Dolphin Day", "14th April", "dolphin"),
    (425, "World Penguin Day", "25th April", "penguin"),
    (427, "Marine Mammal Rescue Day", "27th April", "first-aid-kit"),
    (608, "World Oceans Day", "8th June", "wave"),
    (616, "World Sea Turtle Day", "16th June", "turtle"),
    (714, "World Orca Day", "14th July", "orca"),
    (830, "Whale Shark Day", "30th August", "shark"),
    (917, "World Manta Day", "17th September", "sea-ray"),
    (1008, "World Octopus Day", "8th October", "octopus"),
    (1103, "World Jellyfish Day", "3rd November", "shark"),
    (1103, "World Basking Shark Day", "3rd November", "shark"),
    (1124, "World Walrus Day", "24th November", "walrus"),
]

COLUMNS = ["user_id", "badge", "description", "metric", "metric_meaning", "awarded", "icon"]


def visit_facts(visits: DataFrame) -> DataFrame:
    """Visits with the attributes the rules need, parsed once."""
    doc = with_json_attrs(visits, "attrs_json", ATTRS, ["visit_id", "user_id", "place_name", "date_start"])
    return doc.select(
        "visit_id",
        "user_id",
        "place_name",
        "date_start",
        "km",
        dates.duration_seconds("duration").alias("seconds"),
        (F.substring("start", 12, 5) <= "08:00").alias("early"),
        F.col("litter").isin(*CLEAN).alias("clean"),
    )


def weekly_streak(visits: DataFrame, user: str = "user_id", day: str = "date_start") -> DataFrame:
    """Longest run of consecutive weeks with a visit, per user."""
    return longest_run(visits, user, day)


def calendar_day_awards(visits: DataFrame, named_days: list[tuple] = NAMED_DAYS) -> DataFrame:
    """One award per user and named day on which the user was ever out. The day table decides which days count."""
    spark = visits.sparkSession
    days = spark.createDataFrame(named_days, "month_day int, badge string, day_text string, icon string")
    active = visits.select("user_id", dates.month_day("date_start").alias("month_day")).distinct()
    # The day table is a literal of a few rows.
    return active.join(F.broadcast(days), "month_day").select(
        "user_id",
        "badge",
        F.concat(F.lit("Walk a beach on "), F.col("day_text"), F.lit(" in any year")).alias("description"),
        F.lit(None).cast("double").alias("metric"),
        F.lit(None).cast("string").alias("metric_meaning"),
        F.lit(True).alias("awarded"),
        "icon",
    )


def _rows(measures: DataFrame, badges: list[Badge]) -> DataFrame:
    """Measures of a user, one row, to one row per badge."""

    def row(b: Badge) -> Column:
        value = F.col(b.measure).cast("double")
        return F.struct(
            F.lit(b.name).alias("badge"),
            F.lit(b.description).alias("description"),
            value.alias("metric"),
            F.lit(b.meaning).alias("metric_meaning"),
            F.coalesce(value > b.threshold if b.above else value >= b.threshold, F.lit(False)).alias("awarded"),
            F.lit(b.icon).alias("icon"),
        )

    return measures.select("user_id", F.inline(F.array(*[row(b) for b in badges])))


def _quarterly(days: DataFrame, as_of, factor: float, old_quarters: bool) -> DataFrame:
    year_now = F.year(dates.as_date(as_of))
    year = F.year("date_start")
    km = exact_sum("km")
    quarters = days.groupBy("user_id", year.alias("year"), F.quarter("date_start").alias("quarter")).agg(km.alias("km"))

    # Current year: one row per user with four sums; quarters without a visit count as 0.
    current = quarters.where(F.col("year") == year_now).groupBy("user_id")
    sums = current.agg(*[F.coalesce(F.sum(F.when(F.col("quarter") == q, F.col("km"))), F.lit(0.0)).alias(f"q{q}") for q in QUARTERS])
    items = []
    for q, (months, meaning) in QUARTERS.items():
        miles = F.col(f"q{q}") * factor
        items.append(
            F.struct(
                F.concat(F.lit(f"Quarterly Track {q} ("), year_now.cast("string"), F.lit(")")).alias("badge"),
                F.lit(f"At least {QUARTER_MILES} miles walked {months} in the current year").alias("description"),
                miles.alias("metric"),
                F.lit(meaning).alias("metric_meaning"),
                (miles >= QUARTER_MILES).alias("awarded"),
                F.lit("road-sign").alias("icon"),
            )
        )
    per_quarter = sums.select("user_id", F.inline(F.array(*items)))

    buckets = quarters
    if old_quarters:
        buckets = days.groupBy("user_id", year.alias("year"), dates.old_quarter("date_start").alias("quarter")).agg(km.alias("km"))
    reached = count_if(F.col("km") * factor >= QUARTER_MILES)
    all_four = buckets.groupBy("user_id", "year").agg(reached.cast("double").alias("metric")).select(
        "user_id",
        F.concat(F.lit("Ultimate Tracker ("), F.col("year").cast("string"), F.lit(")")).alias("badge"),
        F.lit("All Quarterly Track badges completed in a given year").alias("description"),
        "metric",
        F.lit("Number of Quarterly Track badges completed in the year").alias("metric_meaning"),
        (F.col("metric") >= 4).alias("awarded"),
        F.lit("medal-gold-winner").alias("icon"),
    )
    return per_quarter.unionByName(all_four)


def badges_build(visits: DataFrame, records: DataFrame, as_of, factor: float = MILE_FACTOR, old_quarters: bool = False) -> DataFrame:
    """All award rules for all users, one row per user and badge.

    ``records`` has one row per record with the ``visit_id`` of its top visit. Visits are read and their JSON
    parsed once: they are brought to one narrow row per (user, place, day), which is written and serves
    all rules. Records are counted per visit before they are joined.
    """
    per_visit = records.groupBy("visit_id").agg(F.count(F.lit(1)).alias("n_records"))
    walks = visit_facts(visits).join(per_visit, "visit_id", "left")
    days = settle(
        walks.groupBy("user_id", "place_name", "date_start").agg(
            F.count(F.lit(1)).alias("walks"),
            F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"),
            exact_sum("km").alias("km"),
            F.max("km").alias("longest_km"),
            exact_sum("seconds").alias("seconds"),
            count_if(F.col("early")).alias("early"),
            count_if(F.col("clean")).alias("clean"),
        )
    )
    by_place = days.groupBy("user_id", "place_name").agg(
        F.sum("walks").alias("walks"),
        F.sum("n_records").alias("n_records"),
        exact_sum("km").alias("km"),
        F.max("longest_km").alias("longest_km"),
        F.sum("early").alias("early"),
        F.sum("clean").alias("clean"),
    )
    totals = by_place.groupBy("user_id").agg(
        F.sum("early").alias("early"),
        exact_sum("km").alias("km"),
        F.max("walks").alias("same_place"),
        F.max("longest_km").alias("longest_km"),
        F.max("n_records").alias("place_records"),
        F.sum("clean").alias("clean"),
    )
    hours = (
        days.groupBy("user_id", F.trunc("date_start", "month").alias("month"))
        .agg(exact_sum("seconds").alias("seconds"))
        .groupBy("user_id")
        .agg(F.floor(F.max("seconds") / 3600).alias("month_hours"))
    )
    measures = totals.join(hours, "user_id", "left").join(weekly_streak(days), "user_id", "left")
    rules = [_rows(measures, BADGES), _quarterly(days, as_of, factor, old_quarters), calendar_day_awards(days)]
    return reduce(DataFrame.unionByName, [r.select(*COLUMNS) for r in rules])


def drop_expired(awards: DataFrame, as_of) -> DataFrame:
    """Stored awards without the quarterly ones of other years."""
    this_year = F.concat(F.lit("("), F.year(dates.as_date(as_of)).cast("string"), F.lit(")"))
    return awards.where(~F.col("badge").startswith("Quarterly Track") | F.col("badge").endswith(this_year))


def badges_merge(current: DataFrame, build: DataFrame, as_of) -> DataFrame:
    """The award table after a run; running it twice with the same input changes nothing."""
    return merge_awards(drop_expired(current, as_of), build, as_of)


def badges_of(awards: DataFrame, user_id: int | None = None, updated_since=None) -> DataFrame:
    """Read side: awards of a user, or those changed since a time."""
    out = awards if user_id is None else awards.where(F.col("user_id") == user_id)
    return out if updated_since is None else out.where(F.col("updated_on") > F.lit(updated_since))
