"""Jobs, each over the stand-in frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions.text import recode
from ..operators.attributes import unpivot
from ..operators.hierarchy import paths
from ..plans import awards, exports, history, people, summaries, taxonomy
from ..session import scratch_path
from .building_blocks import TREE_SQL, WEEKLY_SQL, taxon_tree, weekly_series
from .projection import grid_sql
from .registry import query
from .standin import AS_OF


def values(rows) -> str:
    """Python tuples as a SQL VALUES list."""

    def item(v):
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(item(v) for v in row) + ")" for row in rows)


# ---- awards --------------------------------------------------------------------------


def walks(t):
    """Visits with the JSON attributes the award rules read."""
    v = F.col("visit_id")
    doc = F.struct(
        F.format_string("2001-01-01T%02d:%02d", v % 24, v % 60).alias("1715"),
        F.format_string("%02d:%02d:00", v % 7, v % 60).alias("1717"),
        ((v % 200) / 10).cast("string").alias("1718"),
        recode("status", {"F": "Spotless", "O": "Mostly Clean"}, "Dirty").alias("1722"),
    )
    return t.visits.select(
        "visit_id", "user_id", F.col("priority").alias("place_name"), "date_start", F.to_json(doc).alias("attrs_json")
    )


_BADGE_ROWS = values([(b.name, b.description, b.measure, b.threshold, int(b.above), b.meaning, b.icon) for b in awards.BADGES])
_DAY_ROWS = values(awards.NAMED_DAYS)

WALKS_SQL = """walks AS (SELECT visit_id, user_id, priority AS place_name, date_start,
    lpad(CAST(visit_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(visit_id % 60 AS VARCHAR), 2, '0') <= '08:00' AS early,
    (visit_id % 7) * 3600 + (visit_id % 60) * 60 AS seconds, CAST((visit_id % 200) / 10.0 AS DECIMAL(18,3)) AS km, status IN ('F', 'O') AS clean
    FROM visits)"""

BUILD_SQL = f"""WITH {WALKS_SQL},
  n_rec AS (SELECT visit_id, count(*) AS n FROM records GROUP BY 1),
  by_place AS (SELECT user_id, place_name, count(*) AS walks, coalesce(sum(n), 0) AS n FROM walks LEFT JOIN n_rec USING (visit_id) GROUP BY 1, 2),
  streak AS (SELECT user_id, max(n) AS v FROM (SELECT user_id, g, count(*) AS n FROM
     (SELECT user_id, w - CAST(7 * row_number() OVER (PARTITION BY user_id ORDER BY w) AS INTEGER) AS g FROM
       (SELECT DISTINCT user_id, CAST(date_trunc('week', date_start) AS DATE) AS w FROM walks)) GROUP BY 1, 2) GROUP BY 1),
  hours AS (SELECT user_id, max(s) // 3600 AS v FROM (SELECT user_id, date_trunc('month', date_start) AS m, sum(seconds) AS s FROM walks GROUP BY 1, 2) GROUP BY 1),
  measures AS (
    SELECT user_id, 'early' AS measure, CAST(count(CASE WHEN early THEN 1 END) AS DOUBLE) AS metric FROM walks GROUP BY 1
    UNION ALL SELECT user_id, 'km', CAST(sum(km) AS DOUBLE) FROM walks GROUP BY 1
    UNION ALL SELECT user_id, 'same_place', CAST(max(walks) AS DOUBLE) FROM by_place GROUP BY 1
    UNION ALL SELECT user_id, 'longest_km', CAST(max(km) AS DOUBLE) FROM walks GROUP BY 1
    UNION ALL SELECT user_id, 'month_hours', CAST(v AS DOUBLE) FROM hours
    UNION ALL SELECT user_id, 'place_records', CAST(max(n) AS DOUBLE) FROM by_place GROUP BY 1
    UNION ALL SELECT user_id, 'clean', CAST(count(CASE WHEN clean THEN 1 END) AS DOUBLE) FROM walks GROUP BY 1
    UNION ALL SELECT user_id, 'weeks_in_a_row', CAST(v AS DOUBLE) FROM streak),
  rules(badge, description, measure, threshold, above, meaning, icon) AS (VALUES {_BADGE_ROWS}),
  quarters AS (SELECT user_id, year(date_start) AS y, quarter(date_start) AS q, CAST(sum(km) AS DOUBLE) * 1.604 AS miles FROM walks GROUP BY 1, 2, 3),
  q_names(q, months, meaning) AS (VALUES (1, 'January to March', 'Maximum number of miles January to March for the current year'),
    (2, 'April to June', 'Maximum number of miles April to June for the current year'),
    (3, 'July to September', 'Maximum number of miles July to September for the current year'),
    (4, 'October to December', 'Maximum number of miles walked October to December for the current year')),
  days(month_day, badge, day_text, icon) AS (VALUES {_DAY_ROWS})
  SELECT user_id, badge, description, metric, meaning AS metric_meaning,
    CASE above WHEN 1 THEN metric > threshold ELSE metric >= threshold END AS awarded, icon FROM measures JOIN rules USING (measure)
  UNION ALL
  SELECT u.user_id, 'Quarterly Track ' || n.q || ' (2001)', 'At least 50 miles walked ' || n.months || ' in the current year',
    coalesce(s.miles, 0), n.meaning, coalesce(s.miles, 0) >= 50, 'road-sign'
  FROM (SELECT DISTINCT user_id FROM quarters WHERE y = 2001) u CROSS JOIN q_names n
  LEFT JOIN quarters s ON s.user_id = u.user_id AND s.q = n.q AND s.y = 2001
  UNION ALL
  SELECT user_id, 'Ultimate Tracker (' || y || ')', 'All Quarterly Track badges completed in a given year',
    CAST(count(CASE WHEN miles >= 50 THEN 1 END) AS DOUBLE), 'Number of Quarterly Track badges completed in the year',
    count(CASE WHEN miles >= 50 THEN 1 END) >= 4, 'medal-gold-winner' FROM quarters GROUP BY user_id, y
  UNION ALL
  SELECT DISTINCT user_id, badge, 'Walk a beach on ' || day_text || ' in any year', CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), TRUE, icon
  FROM walks JOIN days ON month_day = month(date_start) * 100 + day(date_start)"""


@query("badges_build", "job:badges_build U1 A2 A9 E2 W4", BUILD_SQL)
def _(t):
    return awards.badges_build(walks(t), t.records, AS_OF)


@query(
    "badges_merge",
    "job:badges_merge S4",
    """WITH old AS (SELECT user_id, count(*) AS metric FROM visits WHERE date_start < DATE '2000-01-01' GROUP BY 1),
    new AS (SELECT user_id, count(*) AS metric FROM visits WHERE date_start >= DATE '1999-01-01' GROUP BY 1)
    SELECT coalesce(o.user_id, n.user_id) AS user_id, 'Walker' AS badge, 'At least five walks' AS description,
      CAST(coalesce(n.metric, o.metric) AS DOUBLE) AS metric, 'walks' AS metric_meaning, 'boot' AS icon,
      coalesce(o.metric >= 5, FALSE) OR coalesce(n.metric >= 5, FALSE) AS awarded,
      CASE WHEN coalesce(o.metric >= 5, FALSE) THEN '2000-01-01 00:00:00' WHEN n.metric >= 5 THEN '2001-06-15 00:00:00' END AS awarded_on,
      CASE WHEN n.user_id IS NULL OR o.metric = n.metric THEN '2000-01-01 00:00:00' ELSE '2001-06-15 00:00:00' END AS updated_on
    FROM old o FULL JOIN new n ON n.user_id = o.user_id
    UNION ALL SELECT DISTINCT user_id, 'Quarterly Track 2 (2001)', 'q', 1.0, 'miles', 'road-sign', TRUE, '2000-01-01 00:00:00', '2000-01-01 00:00:00'
    FROM visits WHERE priority = '5-LOW'""",
)
def _(t):
    then, v = F.lit("2000-01-01").cast("timestamp"), t.visits

    def walkers(df):
        per = df.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("metric"))
        return per.select(
            "user_id",
            F.lit("Walker").alias("badge"),
            F.lit("At least five walks").alias("description"),
            "metric",
            F.lit("walks").alias("metric_meaning"),
            (F.col("metric") >= 5).alias("awarded"),
            F.lit("boot").alias("icon"),
        )

    def stored(df):
        return df.withColumn("awarded_on", F.when(F.col("awarded"), then)).withColumn("updated_on", then)

    quarterly = v.where("priority = '5-LOW'").select("user_id").distinct().select(
        "user_id",
        F.explode(F.array(F.lit("Quarterly Track 2 (2001)"), F.lit("Quarterly Track 2 (2000)"))).alias("badge"),
        F.lit("q").alias("description"),
        F.lit(1.0).alias("metric"),
        F.lit("miles").alias("metric_meaning"),
        F.lit(True).alias("awarded"),
        F.lit("road-sign").alias("icon"),
    )
    current = stored(walkers(v.where(F.col("date_start") < "2000-01-01")).unionByName(quarterly))
    build = walkers(v.where(F.col("date_start") >= "1999-01-01"))
    return awards.badges_merge(current, build, AS_OF)


@query(
    "weekly_streak",
    "job:weekly_streak W4",
    """WITH weeks AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS w FROM events WHERE event_type = 'purchase'),
    runs AS (SELECT user_id, w - CAST(7 * row_number() OVER (PARTITION BY user_id ORDER BY w) AS INTEGER) AS g FROM weeks)
    SELECT user_id, max(n) AS weeks_in_a_row FROM (SELECT user_id, g, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return awards.weekly_streak(t.events.where("event_type = 'purchase'"), "user_id", "ts")


@query(
    "calendar_day_awards",
    "job:calendar_day_awards C2 C4 D1",
    f"""WITH days(month_day, badge, day_text, icon) AS (VALUES {_DAY_ROWS})
    SELECT DISTINCT user_id, badge, 'Walk a beach on ' || day_text || ' in any year' AS description, icon, TRUE AS awarded
    FROM visits JOIN days ON month_day = month(date_start) * 100 + day(date_start)""",
)
def _(t):
    return awards.calendar_day_awards(t.visits).select("user_id", "badge", "description", "icon", "awarded")


# ---- recorders -----------------------------------------------------------------------


@query(
    "leaderboard",
    "job:leaderboard A1 A3 W2 F5",
    """WITH v AS (SELECT *, visit_id % 240 AS minutes FROM visits WHERE date_start >= DATE '1996-01-01' AND date_start <= DATE '2000-12-31'),
    effort AS (SELECT user_id, count(*) AS visits, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS distance,
      CAST(sum(minutes) AS BIGINT) AS minutes FROM v GROUP BY 1),
    found AS (SELECT v.user_id, count(*) AS records, count(DISTINCT r.taxon_id) AS species, count(DISTINCT a.taxon_group) AS "groups"
      FROM v JOIN records r ON r.visit_id = v.visit_id LEFT JOIN taxa a ON a.taxon_id = r.taxon_id GROUP BY 1)
    SELECT e.*, coalesce(records, 0) AS records, coalesce(species, 0) AS species, coalesce("groups", 0) AS "groups",
      row_number() OVER (ORDER BY visits DESC, e.user_id) AS position FROM effort e LEFT JOIN found f ON f.user_id = e.user_id""",
)
def _(t):
    visits = t.visits.withColumn("distance", F.col("total")).withColumn("minutes", F.col("visit_id") % 240)
    return people.leaderboard(visits, t.records, t.taxa, "1996-01-01", "2000-12-31")


@query(
    "user_totals",
    "job:leaderboard A7",
    """SELECT user_id, count(*) AS records, count(DISTINCT taxon_id) AS species, count(DISTINCT taxon_id) * 100 // 500 AS pct_of_list
    FROM visits JOIN records USING (visit_id) GROUP BY 1""",
)
def _(t):
    rows = t.records.select("visit_id", "taxon_id").join(t.visits.select("visit_id", "user_id"), "visit_id")
    return people.user_totals(rows, 500)


@query(
    "challenge_score",
    "job:challenge_score A9 A3",
    """WITH per AS (SELECT v.user_id, a.taxon_group, least(20, count(DISTINCT r.taxon_id)) AS n FROM visits v
      JOIN records r ON r.visit_id = v.visit_id AND r.record_status = 'A' JOIN taxa a ON a.taxon_id = r.taxon_id GROUP BY 1, 2)
    SELECT p.user_id, CAST(least(100, coalesce(sum(n), 0)) AS BIGINT) AS species_score, CAST(least(10, count(n)) AS BIGINT) AS groups_score
    FROM people p LEFT JOIN per ON per.user_id = p.user_id WHERE p.role <> 'HOUSEHOLD' GROUP BY 1""",
)
def _(t):
    accepted = t.records.where("record_status = 'A'").select("visit_id", "taxon_id")
    rows = accepted.join(t.visits.select("visit_id", "user_id"), "visit_id")
    return people.challenge_score(rows, t.taxa, t.people.where("role <> 'HOUSEHOLD'").select("user_id"))


@query(
    "award_matrix",
    "job:filtered_listing T1 J2 C4",
    """SELECT p.user_id, p.nation_id AS group_id, CAST(l.level AS INTEGER) AS level,
    CASE WHEN EXISTS (SELECT 1 FROM visits v WHERE v.user_id = p.user_id AND CAST(substr(v.priority, 1, 1) AS INTEGER) = l.level) THEN 'Yes' ELSE 'No' END AS reached
    FROM people p CROSS JOIN (SELECT unnest(range(1, 6)) AS level) l""",
)
def _(t):
    won = t.visits.select("user_id", F.substring("priority", 1, 1).cast("int").alias("level"))
    return people.award_matrix(t.people.select("user_id", F.col("nation_id").alias("group_id")), won, 5)


@query(
    "activity_by_form",
    "job:leaderboard A3",
    """SELECT user_id, priority AS form, strftime(min(date_start), '%Y-%m-%d') AS first_use, strftime(max(date_start), '%Y-%m-%d') AS last_use, count(*) AS records
    FROM visits GROUP BY 1, 2""",
)
def _(t):
    return people.activity_by_form(t.visits.select("user_id", F.col("priority").alias("form"), F.col("date_start").alias("created_on")))


@query(
    "records_by_date_basis",
    "job:leaderboard F2 A1",
    """SELECT 'field' AS basis, user_id, count(*) AS records FROM visits JOIN records USING (visit_id) WHERE seen_on BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 2
    UNION ALL SELECT 'input', user_id, count(*) FROM visits JOIN records USING (visit_id) WHERE date_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 2
    UNION ALL SELECT 'total', count(DISTINCT user_id), count(*) FROM visits JOIN records USING (visit_id) WHERE date_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
)
def _(t):
    rows = t.records.select("visit_id", "seen_on").join(
        t.visits.select("visit_id", "user_id", F.col("date_start").alias("created_on")), "visit_id"
    )
    span = ("1998-01-01", "1998-12-31")
    field = people.records_by_date_basis(rows, "field", *span).select(F.lit("field").alias("basis"), "user_id", "records")
    typed = people.records_by_date_basis(rows, "input", *span).select(F.lit("input").alias("basis"), "user_id", "records")
    total = people.records_by_date_basis(rows, "input", *span, by_user=False)
    return field.unionByName(typed).unionByName(
        total.select(F.lit("total").alias("basis"), F.col("recorders").alias("user_id"), "records")
    )


ACCOUNTS_SQL = """persons AS (SELECT user_id, user_id AS person_id, user_name AS surname, user_id % 17 = 0 AS deleted FROM people),
    users AS (SELECT user_id, user_id AS person_id, user_id % 13 = 0 AS deleted FROM people WHERE user_id % 11 <> 0),
    allocations AS (SELECT user_id, priority AS place_name, visit_id % 50 AS approved_by_id, date_start AS approved_on FROM visits WHERE date_start < DATE '1997-01-01')"""

LAST_SQL = "last AS (SELECT user_id, max(date_start) AS d FROM visits GROUP BY 1)"


def accounts(t):
    k = F.col("user_id")
    persons = t.people.select(k, k.alias("person_id"), F.col("user_name").alias("surname"), (k % 17 == 0).alias("deleted"))
    users = t.people.where(k % 11 != 0).select(k, k.alias("person_id"), (k % 13 == 0).alias("deleted"))
    allocations = t.visits.where(F.col("date_start") < "1997-01-01").select(
        "user_id",
        F.col("priority").alias("place_name"),
        (F.col("visit_id") % 50).alias("approved_by_id"),
        F.col("date_start").alias("approved_on"),
    )
    return persons, users, allocations


@query(
    "inactive_or_orphaned_users",
    "job:inactive_or_orphaned_users J5 A4",
    f"""WITH {ACCOUNTS_SQL}, {LAST_SQL}
    SELECT p.user_id, 'lapsed' AS problem FROM persons p
      WHERE EXISTS (SELECT 1 FROM allocations a WHERE a.user_id = p.user_id AND a.approved_by_id <> a.user_id AND a.approved_on < DATE '2000-06-01')
      AND NOT EXISTS (SELECT 1 FROM last l WHERE l.user_id = p.user_id AND l.d >= DATE '2000-06-01')
    UNION ALL SELECT user_id, 'unallocated' FROM persons p WHERE NOT EXISTS (SELECT 1 FROM allocations a WHERE a.user_id = p.user_id)
    UNION ALL SELECT DISTINCT user_id, 'deleted but allocated' FROM allocations a
      WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = a.user_id AND NOT u.deleted)
    UNION ALL SELECT DISTINCT v.user_id, 'broken account' FROM visits v LEFT JOIN users u ON u.user_id = v.user_id
      LEFT JOIN persons p ON p.person_id = u.person_id WHERE u.user_id IS NULL OR u.deleted OR p.person_id IS NULL OR p.deleted""",
)
def _(t):
    persons, users, allocations = accounts(t)
    return people.inactive_or_orphaned_users(persons, allocations, t.visits, users, "2000-06-01")


@query(
    "lapsed_users",
    "job:inactive_or_orphaned_users J5 A4 C2",
    f"""WITH {ACCOUNTS_SQL}, {LAST_SQL}
    SELECT user_id, surname, page, string_agg(place_name, ', ' ORDER BY place_name) AS places, strftime(max(d), '%d/%m/%Y') AS last_visit FROM (
      SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY place_name) - 1) // 2 AS page FROM (SELECT DISTINCT p.user_id, p.surname, a.place_name, l.d
        FROM persons p JOIN allocations a ON a.user_id = p.user_id AND a.approved_by_id <> a.user_id AND a.approved_on < DATE '2000-06-01'
        LEFT JOIN last l ON l.user_id = p.user_id WHERE l.d IS NULL OR l.d < DATE '2000-06-01')) GROUP BY 1, 2, 3""",
)
def _(t):
    persons, _, allocations = accounts(t)
    return people.lapsed_users(persons, allocations, t.visits, "2000-06-01", size=2).select("user_id", "surname", "page", "places", "last_visit")


@query(
    "broken_accounts",
    "job:inactive_or_orphaned_users C4",
    f"""WITH {ACCOUNTS_SQL}
    SELECT * FROM (SELECT DISTINCT v.user_id, coalesce(p.surname, 'Person name not found') AS surname,
      CASE WHEN NOT u.deleted THEN 'OK' WHEN u.deleted THEN 'Warehouse User Account Present But Deleted' ELSE 'Warehouse User Account Missing' END AS account_state,
      CASE WHEN NOT p.deleted THEN 'OK' WHEN p.deleted THEN 'Warehouse Person Account Present But Deleted' ELSE 'Warehouse Person Account Missing' END AS person_state
    FROM visits v LEFT JOIN users u ON u.user_id = v.user_id LEFT JOIN persons p ON p.person_id = u.person_id)
    WHERE account_state <> 'OK' OR person_state <> 'OK'""",
)
def _(t):
    persons, users, _ = accounts(t)
    return people.broken_accounts(t.visits, users, persons)


OWNERS_SQL = """owners AS (SELECT user_id, lower(user_name) || '@example.org' AS email, user_name AS surname, role AS first_name FROM people),
    imported AS (SELECT visit_id AS record_id, user_id, CASE visit_id % 3 WHEN 0 THEN upper('customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.org')
      WHEN 1 THEN 'Customer#' || lpad(CAST((user_id + 700) AS VARCHAR), 9, '0') || '@example.org' ELSE 'nobody' || visit_id || '@example.org' END AS stated_email,
      'S' || user_id AS stated_surname, CASE WHEN visit_id % 2 = 0 THEN priority END AS stated_first_name FROM visits)"""


@query(
    "owner_mismatch",
    "job:owner_mismatch J9 J2 C1",
    f"""WITH {OWNERS_SQL}
    SELECT record_id, o.surname || coalesce(', ' || o.first_name, '') AS current_owner, o.email AS current_email,
      i.stated_surname || coalesce(', ' || i.stated_first_name, '') AS proposed_owner, i.stated_email AS proposed_email,
      CASE WHEN EXISTS (SELECT 1 FROM owners k WHERE k.email = lower(i.stated_email)) THEN 'Yes' ELSE 'No' END AS person_exists
    FROM imported i JOIN owners o ON o.user_id = i.user_id WHERE lower(i.stated_email) <> lower(o.email)""",
)
def _(t):
    def mail(name):
        return F.concat(name, F.lit("@example.org"))

    owners = t.people.select(
        "user_id", mail(F.lower("user_name")).alias("email"), F.col("user_name").alias("surname"), F.col("role").alias("first_name")
    )
    v, u = F.col("visit_id"), F.col("user_id")
    stated = (
        F.when(v % 3 == 0, F.upper(mail(F.format_string("customer#%09d", u))))
        .when(v % 3 == 1, mail(F.format_string("Customer#%09d", u + 700)))
        .otherwise(mail(F.concat(F.lit("nobody"), v.cast("string"))))
    )
    imported = t.visits.select(
        v.alias("record_id"),
        "user_id",
        stated.alias("stated_email"),
        F.concat(F.lit("S"), u.cast("string")).alias("stated_surname"),
        F.when(v % 2 == 0, F.col("priority")).alias("stated_first_name"),
    )
    return people.owner_mismatch(imported, owners, owners.select("email"))


@query(
    "visible_plots",
    "job:visible_plots A5",
    """WITH allocations AS (SELECT user_id % 400 AS square_id FROM people WHERE role = 'BUILDING'),
    n AS (SELECT square_id, count(*) AS allocations FROM allocations GROUP BY 1)
    SELECT v.visit_id AS plot_id, v.visit_id % 400 AS square_id, v.user_id AS created_by_id, coalesce(n.allocations, 0) AS allocations
    FROM visits v LEFT JOIN n ON n.square_id = v.visit_id % 400 WHERE v.user_id = 7 OR coalesce(n.allocations, 0) < 2""",
)
def _(t):
    plots = t.visits.select(
        F.col("visit_id").alias("plot_id"), (F.col("visit_id") % 400).alias("square_id"), F.col("user_id").alias("created_by_id")
    )
    allocations = t.people.where("role = 'BUILDING'").select((F.col("user_id") % 400).alias("square_id"))
    return people.visible_plots(plots, allocations, user_id=7).select("plot_id", "square_id", "created_by_id", "allocations")


@query(
    "allocation_status",
    "job:allocation_status F4",
    """SELECT v.visit_id AS allocation_id, v.user_id, p.user_name AS person_name, v.priority AS place_name,
      CASE WHEN p.role = 'BUILDING' THEN p.user_name || '@example.org' END AS email,
      CASE WHEN v.visit_id % 3 = 0 THEN 'Awaiting approval' ELSE 'Approved' END AS status, CASE WHEN v.visit_id % 3 = 0 THEN 0 ELSE 1 END AS status_int
    FROM visits v LEFT JOIN people p ON p.user_id = v.user_id""",
)
def _(t):
    allocations = t.visits.select(
        F.col("visit_id").alias("allocation_id"),
        "user_id",
        F.col("priority").alias("place_name"),
        F.when(F.col("visit_id") % 3 == 0, F.col("user_id")).otherwise(-1).alias("updated_by_id"),
    )
    persons = t.people.select(
        "user_id",
        F.col("user_name").alias("person_name"),
        # The viewer's rights differ from row to row here, so the mask is a column.
        F.when(F.col("role") == "BUILDING", F.concat("user_name", F.lit("@example.org"))).alias("email"),
    )
    out = people.allocation_status(allocations, persons, F.col("email").isNotNull())
    return out.drop("updated_by_id")


@query(
    "latest_per_email",
    "job:latest_per_email W1 J9",
    """SELECT email, arg_max(event_id, event_id) AS visit_id, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS created_on FROM
    (SELECT lower(CASE WHEN event_id % 2 = 0 THEN 'User' ELSE 'user' END || (user_id % 40) || '@Example.org') AS email, event_id, ts
     FROM events WHERE event_type <> 'error') GROUP BY 1""",
)
def _(t):
    name = F.when(F.col("event_id") % 2 == 0, "User").otherwise("user")
    signups = t.events.select(
        F.col("event_id").alias("visit_id"),
        F.concat(name, (F.col("user_id") % 40).cast("string"), F.lit("@Example.org")).alias("email"),
        F.col("ts").alias("created_on"),
        (F.col("event_type") != "error").alias("opted_in"),
    )
    return people.latest_per_email(signups)


@query(
    "user_id_remap",
    "job:user_id_remap J5 S4",
    """WITH lookup AS (SELECT user_id AS old_id, user_id + 100000 AS new_id, CASE WHEN user_id % 2 = 0 THEN 118 ELSE 164 END AS website_id FROM people WHERE role <> 'MACHINERY'),
    old_map AS (SELECT user_id AS old_id, user_id + 200000 AS new_id, CASE WHEN user_id % 2 = 0 THEN 118 ELSE 164 END AS website_id FROM people WHERE role = 'BUILDING'),
    mapped AS (SELECT * FROM old_map UNION ALL SELECT * FROM lookup l WHERE NOT EXISTS
      (SELECT 1 FROM old_map m WHERE m.old_id = l.old_id AND m.website_id = l.website_id)),
    vals AS (SELECT v.visit_id AS value_id, v.place_id, CASE WHEN v.visit_id % 2 = 0 THEN 389 ELSE 1 END AS attribute_id, v.user_id AS int_value,
      CASE p.place_id % 5 WHEN 0 THEN 777 WHEN 1 THEN 778 WHEN 2 THEN 24286 WHEN 3 THEN 24287 ELSE 9 END AS place_type
      FROM visits v LEFT JOIN places p ON p.place_id = v.place_id)
    SELECT value_id, vals.place_id, CAST(CASE WHEN m.new_id IS NULL THEN attribute_id ELSE 234 END AS INTEGER) AS attribute_id,
      coalesce(m.new_id, int_value) AS int_value
    FROM vals LEFT JOIN mapped m ON attribute_id = 389 AND m.old_id = int_value
      AND ((place_type IN (777, 778) AND website_id = 118) OR (place_type IN (24286, 24287) AND website_id = 164))""",
)
def _(t):
    u = F.col("user_id")
    site = F.when(u % 2 == 0, 118).otherwise(164).cast("long").alias("website_id")
    lookup = t.people.where("role <> 'MACHINERY'").select(u.alias("old_id"), (u + 100000).alias("new_id"), site)
    old = t.people.where("role = 'BUILDING'").select(u.alias("old_id"), (u + 200000).alias("new_id"), site)
    rows = t.visits.select(
        F.col("visit_id").alias("value_id"),
        "place_id",
        F.when(F.col("visit_id") % 2 == 0, 389).otherwise(1).alias("attribute_id"),
        u.alias("int_value"),
    )
    kinds = recode(F.col("place_id") % 5, {0: 777, 1: 778, 2: 24286, 3: 24287}, 9).cast("long").alias("place_type")
    pairs = {118: (777, 778), 164: (24286, 24287)}
    return people.user_id_remap(lookup, old, rows, t.places.select("place_id", kinds), pairs, 389, 234)[1]


# ---- summaries -----------------------------------------------------------------------


@query(
    "species_summary",
    "job:species_summary A1 A3 C1",
    """SELECT a.taxon_id, a.name, a.taxon_group || '::' || a.family AS path, count(*) AS records, CAST(sum(r.quantity) AS DOUBLE) AS individuals,
    strftime(min(seen_on), '%Y-%m-%d') AS first_date, strftime(max(seen_on), '%Y-%m-%d') AS last_date
    FROM records r JOIN taxa a ON a.taxon_id = r.taxon_id GROUP BY 1, 2, 3""",
)
def _(t):
    return summaries.species_summary(t.records, t.taxa)


@query(
    "species_per_visit",
    "job:species_summary A1",
    "SELECT visit_id, count(DISTINCT taxon_id) AS species, count(*) AS records FROM records GROUP BY 1",
)
def _(t):
    return summaries.species_per(t.records, "visit_id")


@query(
    "taxonomy_breakdown",
    "job:taxonomy_breakdown A1",
    """SELECT taxon_group, family, count(*) AS records, count(DISTINCT r.taxon_id) AS species
    FROM records r JOIN taxa a ON a.taxon_id = r.taxon_id GROUP BY 1, 2""",
)
def _(t):
    return summaries.taxonomy_breakdown(t.records, t.taxa, ["taxon_group", "family"])


@query(
    "breakdown_with_total",
    "job:breakdown_with_total A8",
    """SELECT CASE WHEN grouping(y) = 1 THEN 'Total' ELSE y END AS label, CAST(grouping(y) AS INTEGER) AS is_total, count(*) AS records,
    count(DISTINCT taxon_id) AS species FROM (SELECT CAST(year(seen_on) AS VARCHAR) AS y, taxon_id FROM records) GROUP BY ROLLUP (y)""",
)
def _(t):
    return summaries.breakdown_with_total(t.records, F.year("seen_on"))


@query(
    "two_level_counts",
    "job:two_level_counts U1 J7",
    """WITH r AS (SELECT p.place_name, n.parent_name, r.taxon_id, a.name AS taxon FROM records r JOIN places p ON p.place_id = r.place_id
      JOIN parents n ON n.parent_id = p.parent_id JOIN taxa a ON a.taxon_id = r.taxon_id)
    SELECT 'square' AS level, parent_name AS plot, taxon, taxon_id, count(*) AS records FROM r GROUP BY ALL
    UNION ALL SELECT 'plot', place_name, taxon, taxon_id, count(*) FROM r GROUP BY ALL""",
)
def _(t):
    return summaries.two_level_counts(t.records, t.places.select("place_id", "place_name", "parent_id"), t.parents, t.taxa)


@query(
    "visits_and_sites_per_species",
    "job:visits_and_sites_per_species A1 F2",
    """SELECT taxon_id, count(DISTINCT visit_id) AS visits, count(DISTINCT place_id) AS sites FROM records WHERE year(seen_on) = 2000 GROUP BY 1""",
)
def _(t):
    return summaries.visits_and_sites_per_species(t.records, AS_OF, "last")


@query(
    "verification_counts",
    "job:verification_counts A2",
    """SELECT *, verified || ' (' || human || ' human, ' || machine || ' machine)' AS verified_text FROM
    (SELECT place_id, CAST(year(seen_on) AS INTEGER) AS year, count(CASE WHEN record_status IN ('N', 'A') THEN 1 END) AS untouched,
      count(CASE WHEN record_status = 'R' THEN 1 END) AS verified,
      count(CASE WHEN record_status = 'R' AND discount <= 0.05 THEN 1 END) AS human,
      count(CASE WHEN record_status = 'R' AND discount > 0.05 THEN 1 END) AS machine FROM records GROUP BY 1, 2)""",
)
def _(t):
    source = F.when(F.col("discount") > 0.05, "M").when(F.col("discount") > 0.02, "H")
    return summaries.verification_counts(t.records.withColumn("decision_source", source), ("N", "A"), "R")


@query(
    "trait_counts",
    "job:trait_counts A2",
    """SELECT count(DISTINCT CASE WHEN rank_order < 10 THEN r.taxon_id END) AS woodland,
    count(DISTINCT CASE WHEN taxon_group IN ('PROMO', 'SMALL') THEN r.taxon_id END) AS wetland,
    count(DISTINCT CASE WHEN name LIKE '%bolt' AND rank_order > 20 THEN r.taxon_id END) AS heath
    FROM records r JOIN taxa a ON a.taxon_id = r.taxon_id WHERE record_status <> 'R'""",
)
def _(t):
    flags = {
        "woodland": F.col("rank_order") < 10,
        "wetland": F.col("taxon_group").isin("PROMO", "SMALL"),
        "heath": F.col("name").endswith("bolt") & (F.col("rank_order") > 20),
    }
    return summaries.trait_counts(t.records.where("record_status <> 'R'"), t.taxa, flags)


@query(
    "guild_share",
    "job:guild_share A7 F2",
    """WITH s AS (SELECT DISTINCT taxon_id FROM records)
    SELECT taxon_group, family, count(DISTINCT s.taxon_id) AS species, count(DISTINCT s.taxon_id) * 100 // (SELECT count(*) FROM s) AS pct
    FROM s JOIN taxa USING (taxon_id) GROUP BY 1, 2""",
)
def _(t):
    species = summaries.sample_species(t.records, t.taxa, "sample")
    return summaries.guild_share(species, t.taxa, ["taxon_group", "family"])


@query(
    "guild_share_all",
    "job:guild_share A7 F2",
    """WITH s AS (SELECT DISTINCT taxon_id FROM records)
    SELECT taxon_group, family, count(DISTINCT s.taxon_id) AS species, count(DISTINCT s.taxon_id) * 100 // (SELECT count(*) FROM s) AS pct
    FROM s JOIN taxa USING (taxon_id) GROUP BY 1, 2""",
)
def _(t):
    species = summaries.sample_species(t.records, t.taxa, "sample")
    return summaries.guild_share(species, t.taxa, ["taxon_group", "family"])


@query(
    "list_overview",
    "job:list_overview A1 A7",
    """SELECT place_id, count(DISTINCT r.taxon_id) AS species, count(*) - count(DISTINCT r.taxon_id) AS duplicates,
    count(DISTINCT a.taxon_id) AS analysed, count(DISTINCT r.taxon_id) - count(DISTINCT a.taxon_id) AS not_analysed,
    CAST(round(count(DISTINCT a.taxon_id) * 100.0 / count(DISTINCT r.taxon_id)) AS BIGINT) AS pct_return
    FROM records r LEFT JOIN taxa a ON a.taxon_id = r.taxon_id AND a.rank_order > 25 GROUP BY 1""",
)
def _(t):
    return summaries.list_overview(t.records, t.taxa.where("rank_order > 25"), by="place_id")


@query(
    "list_overview_total",
    "job:list_overview A1 A7",
    """SELECT count(DISTINCT r.taxon_id) AS species, count(*) - count(DISTINCT r.taxon_id) AS duplicates,
    count(DISTINCT a.taxon_id) AS analysed, count(DISTINCT r.taxon_id) - count(DISTINCT a.taxon_id) AS not_analysed,
    CAST(round(count(DISTINCT a.taxon_id) * 100.0 / count(DISTINCT r.taxon_id)) AS BIGINT) AS pct_return
    FROM records r LEFT JOIN taxa a ON a.taxon_id = r.taxon_id AND a.rank_order > 25""",
)
def _(t):
    return summaries.list_overview(t.records, t.taxa.where("rank_order > 25"))


@query(
    "stat_panel",
    "job:stat_panel A6 U1",
    """SELECT 1 AS position, 'visits' AS item, count(*) AS value FROM visits
    UNION ALL SELECT 2, 'recorders', count(DISTINCT user_id) FROM visits
    UNION ALL SELECT 3, 'species', count(DISTINCT taxon_id) FROM records
    UNION ALL SELECT 4, 'individuals', CAST(sum(quantity) AS BIGINT) FROM records
    UNION ALL SELECT 5, 'sites with rejected records', count(*) FROM places p WHERE EXISTS
      (SELECT 1 FROM records r WHERE r.place_id = p.place_id AND r.record_status = 'R')""",
)
def _(t):
    rejected = t.places.join(t.records.where("record_status = 'R'").select("place_id"), "place_id", "left_semi")
    figures = {
        "visits": t.visits.agg(F.count(F.lit(1))),
        "recorders": t.visits.agg(F.countDistinct("user_id")),
        "species": t.records.agg(F.countDistinct("taxon_id")),
        "individuals": t.records.agg(F.sum("quantity")),
        "sites with rejected records": rejected.agg(F.count(F.lit(1))),
    }
    return summaries.stat_panel(**figures)


@query(
    "record_totals",
    "job:stat_panel A1",
    """SELECT count(*) AS records, CAST(sum(quantity) AS BIGINT) AS individuals, count(DISTINCT visit_id) AS visits,
    count(DISTINCT taxon_id) AS species FROM records""",
)
def _(t):
    return summaries.record_totals(t.records)


@query(
    "data_accumulation",
    "job:data_accumulation J3 A5 W3",
    """WITH v AS (SELECT month, count(*) AS n FROM (SELECT strftime(seen_on, '%Y-%m') AS month, visit_id FROM records GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
    l AS (SELECT month, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m') AS month, user_id FROM events GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
    SELECT coalesce(v.month, l.month) AS month, coalesce(v.n, 0) AS visits, coalesce(l.n, 0) AS lists,
    CAST(sum(coalesce(v.n, 0) + coalesce(l.n, 0)) OVER (ORDER BY coalesce(v.month, l.month) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
    FROM v FULL JOIN l ON l.month = v.month""",
)
def _(t):
    rows = t.records.select("visit_id", F.col("seen_on").alias("created_on"))
    entries = t.events.select(F.col("user_id").alias("list_id"), F.col("ts").alias("created_on"))
    return summaries.data_accumulation(rows, entries, at_least=2)


@query(
    "seasonal_taxon_flower_counts",
    "job:seasonal_taxon_flower_counts J2 C2 F7 E2",
    """SELECT v.visit_id, a.name AS taxon, v.priority AS flower, coalesce(CAST(r.quantity AS INTEGER), 0) AS n FROM visits v
    LEFT JOIN records r ON r.visit_id = v.visit_id LEFT JOIN taxa a ON a.taxon_id = r.taxon_id
    WHERE month(v.date_start) BETWEEN 4 AND 9 AND list_has_any([v.place_id % 10, 10 + v.place_id % 7], [3, 12])""",
)
def _(t):
    p = F.col("place_id")
    visits = t.visits.select(
        "visit_id",
        F.col("date_start").alias("date_end"),
        F.array(p % 10, p % 7 + 10).alias("location_ids"),
        F.to_json(F.struct(F.col("priority").alias("1050"))).alias("attrs_json"),
    )
    rows = t.records.select(
        "visit_id", "taxon_id", F.to_json(F.struct(F.col("quantity").cast("int").cast("string").alias("666"))).alias("attrs_json")
    )
    return summaries.seasonal_taxon_flower_counts(visits, rows, t.taxa, [3, 12])


@query(
    "timed_count_species",
    "job:timed_count_species A2 J8 E2",
    """SELECT v.visit_id, CAST(v.visit_id % 3 AS INTEGER) AS survey_id, r.taxon_id,
    CAST(CASE v.visit_id % 3 WHEN 0 THEN sum(r.quantity) WHEN 1 THEN count(*) END AS BIGINT) AS n
    FROM visits v JOIN records r ON r.visit_id = v.visit_id GROUP BY v.visit_id, r.taxon_id""",
)
def _(t):
    visits = t.visits.select("visit_id", (F.col("visit_id") % 3).cast("int").alias("survey_id"))
    # Odd lines hang on the visit itself, even ones on a child visit.
    direct = F.col("record_id") % 2 == 1
    rows = t.records.select(
        F.when(direct, F.col("visit_id")).otherwise(-F.col("record_id") - 1).alias("sample_id"),
        F.when(~direct, F.col("visit_id")).alias("parent_sample_id"),
        "taxon_id",
        F.col("quantity").cast("long").alias("n"),
    )
    return summaries.timed_count_species(visits, rows, summed=[0], counted=[1])


@query(
    "top_n_with_other",
    "job:top_n_with_other W6",
    """WITH base AS (SELECT family, count(*) AS records, count(DISTINCT r.taxon_id) AS species FROM records r
      JOIN taxa a ON a.taxon_id = r.taxon_id GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (ORDER BY species DESC, family) AS rn, count(*) OVER () AS c FROM base)
    SELECT CASE WHEN c > 7 AND rn > 6 THEN 'Other' ELSE family END AS family, CAST(sum(records) AS BIGINT) AS records,
      CAST(sum(species) AS BIGINT) AS species FROM ranked GROUP BY 1""",
)
def _(t):
    return summaries.top_n_with_other(t.records, t.taxa.select("taxon_id", "family"), "family")


@query(
    "associated_species",
    "job:associated_species J8 O2 W2",
    """WITH links AS (SELECT visit_id AS a, visit_id // 2 AS b FROM visits),
    ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links WHERE a <> b),
    per AS (SELECT o.user_id AS taxon_id, p.user_name AS name, count(*) AS records FROM ends e JOIN visits f ON f.visit_id = e.a AND f.priority = '1-URGENT'
      JOIN visits o ON o.visit_id = e.b JOIN people p ON p.user_id = o.user_id GROUP BY 1, 2),
    head AS (SELECT * FROM per ORDER BY records DESC, name, taxon_id LIMIT 15)
    SELECT *, CAST(rank() OVER (ORDER BY records DESC) AS INTEGER) AS rank,
      round(24 - (rank() OVER (ORDER BY records DESC) - 1) * 15.0 / count(*) OVER (), 6)::DOUBLE AS font_size FROM head""",
)
def _(t):
    v = F.col("visit_id")
    edges = t.visits.select(v.alias("from_id"), F.floor(v / 2).alias("to_id"))
    rows = t.visits.select(v.alias("record_id"), F.col("user_id").alias("taxon_id"))
    focal = t.visits.where("priority = '1-URGENT'").select(v.alias("record_id"))
    taxa = t.people.select(F.col("user_id").alias("taxon_id"), F.col("user_name").alias("name"))
    out = summaries.associated_species(focal, edges, rows, taxa)
    return out.withColumn("font_size", F.round("font_size", 6))


@query(
    "missing_from_list",
    "job:missing_from_list J5",
    """SELECT a.taxon_id, a.name, CAST(a.rank_order * 10 AS INTEGER) AS rank_order, strftime(max(seen_on), '%Y-%m-%d') AS last_recorded
    FROM records r JOIN taxa a ON a.taxon_id = r.taxon_id AND a.rank_order >= 30
    WHERE record_status = 'A' AND NOT EXISTS (SELECT 1 FROM taxa l WHERE l.taxon_id = a.taxon_id AND l.taxon_group IN ('PROMO', 'LARGE')) GROUP BY 1, 2, 3""",
)
def _(t):
    taxa = t.taxa.select("taxon_id", "name", (F.col("rank_order") * 10).alias("rank_order"))
    listed = t.taxa.where("taxon_group IN ('PROMO', 'LARGE')")
    return summaries.missing_from_list(t.records.where("record_status = 'A'"), taxa, listed, "species_and_lower")


# ---- exports -------------------------------------------------------------------------


@query(
    "attribute_pivot_export",
    "job:attribute_pivot_export E1 E3",
    """WITH vals AS (SELECT visit_id, max(price) AS top_price, max(discount) AS top_discount, CAST(max(place_id) AS BIGINT) AS place_id FROM records GROUP BY 1)
    SELECT v.visit_id, v.priority, top_price, top_discount, p.place_name FROM visits v LEFT JOIN vals USING (visit_id)
    LEFT JOIN places p ON p.place_id = vals.place_id""",
)
def _(t):
    rows = unpivot(t.records, ["visit_id"], {"price": 10, "discount": 11, "place_id": 12})
    wanted = {10: ("top_price", "value"), 11: ("top_discount", "value"), 12: ("place", "value")}
    terms = t.places.select(F.col("place_id").cast("double").alias("term_id"), F.col("place_name").alias("term"))
    return exports.attribute_pivot_export(
        t.visits.select("visit_id", "priority"), rows, "visit_id", wanted, terms, {"place": "place_name"}
    )


@query(
    "json_attribute_export",
    "job:json_attribute_export E2",
    """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'none' AS flower FROM events""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", "props")
    return exports.json_attribute_export(rows, "props", {"k": ("k", "int"), "flower": ("1050", "string")}, {"flower": "none"})


@query(
    "attributes_as_list",
    "job:attributes_as_list E4",
    """WITH vals AS (SELECT DISTINCT visit_id, record_status, substatus FROM records)
    SELECT v.visit_id, coalesce('[' || string_agg('{"record_status":"' || record_status || '","substatus":"' || substatus || '"}', ',' ORDER BY record_status, substatus) || ']', '[]') AS attrs
    FROM visits v LEFT JOIN vals USING (visit_id) GROUP BY 1""",
)
def _(t):
    out = exports.attributes_as_list(t.visits.select("visit_id"), t.records, "visit_id", ["record_status", "substatus"])
    return out.select("visit_id", F.to_json("attrs").alias("attrs"))


@query(
    "visit_documents",
    "job:visit_documents E4 S2",
    """WITH paged AS (SELECT *, (row_number() OVER (PARTITION BY visit_id ORDER BY record_id, taxon_id, record_status) - 1) // 5 AS page FROM records),
    docs AS (SELECT visit_id, page, count(*) AS n_records,
      string_agg('{"record_id":' || record_id || ',"taxon_id":' || taxon_id || ',"record_status":"' || record_status || '"}', ',' ORDER BY record_id, taxon_id, record_status) AS items
      FROM paged GROUP BY 1, 2)
    SELECT v.visit_id, coalesce(page, 0) AS page, CAST(coalesce(n_records, 0) AS INTEGER) AS n_records,
      '{"visit_id":' || v.visit_id || ',"priority":"' || v.priority || '","records":[' || coalesce(items, '') || ']}' AS doc
    FROM visits v LEFT JOIN docs USING (visit_id)""",
)
def _(t):
    rows = t.records.select("visit_id", "record_id", "taxon_id", "record_status")
    return exports.visit_documents(t.visits.select("visit_id", "priority"), rows, ["taxon_id", "record_status"], page_size=5)


@query(
    "explode_weekly_estimates",
    "job:explode_weekly_estimates T2",
    f"""WITH {WEEKLY_SQL} SELECT user_id, period, CASE WHEN n >= 5 THEN CAST(n AS DOUBLE) END AS summary, v AS estimate FROM weekly""",
)
def _(t):
    return exports.explode_weekly_estimates(weekly_series(t))


@query(
    "year_index",
    "job:year_index A4 J2",
    """WITH idx AS (SELECT place_id, taxon_id, CAST(year(seen_on) AS INTEGER) AS year, count(*) AS value FROM records GROUP BY 1, 2, 3),
    common AS (SELECT taxon_id // 4 * 4 AS taxon_id, string_agg(name, ',' ORDER BY taxon_id) AS common_names FROM taxa
      WHERE taxon_id % 4 <> 0 AND rank_order % 2 = 0 GROUP BY 1)
    SELECT i.place_id, i.taxon_id, i.year, i.value, coalesce(c.common_names, p.name) AS common, p.name AS preferred_name
    FROM idx i JOIN taxa p ON p.taxon_id = i.taxon_id AND p.taxon_id % 4 = 0 LEFT JOIN common c ON c.taxon_id = i.taxon_id""",
)
def _(t):
    index = t.records.groupBy("place_id", "taxon_id", F.year("seen_on").alias("year")).agg(F.count(F.lit(1)).alias("value"))
    k = F.col("taxon_id")
    names_ = t.taxa.select(
        k.alias("name_id"),
        (k - k % 4).alias("taxon_id"),
        "name",
        F.when(F.col("rank_order") % 2 == 0, "eng").otherwise("deu").alias("language"),
        (k % 4 == 0).alias("preferred"),
    )
    return exports.year_index(index, names_, "eng")


@query(
    "gis_export",
    "job:gis_export G5 G6 G8 S2",
    f"""WITH s AS (SELECT user_id, x * 100 - 200000 AS mx, y * 100 + 6800000 AS my FROM people WHERE role <> 'BUILDING'),
    pts AS (SELECT user_id AS id, k, mx + 700 * k AS mx, my + 400 * k AS my FROM s, range(0, 2) AS r(k)), {grid_sql("pts")},
    m AS (SELECT a.id AS user_id, sqrt((a.east - b.east) ** 2 + (a.north - b.north) ** 2) AS len FROM grid a JOIN grid b ON a.id = b.id AND a.k = 0 AND b.k = 1)
    SELECT user_id, 'LINESTRING' AS geom_type, round(len, 6) AS length_m, round(degrees(2 * atan(exp((my + 200) / 6378137.0)) - pi() / 2), 6) AS lat,
    round(degrees((mx + 350) / 6378137.0), 6) AS lon FROM s JOIN m USING (user_id)""",
)
def _(t):
    x, y = F.col("x") * 100 - 200000, F.col("y") * 100 + 6800000
    line = F.format_string("LINESTRING(%d %d,%d %d)", x, y, x + 700, y + 400)
    shape = F.when(F.col("role") == "BUILDING", geo.point_wkt("x", "y")).otherwise(line)
    out = exports.gis_export(t.people.select("user_id", shape.alias("geom")), "geom", "line")
    return out.select("user_id", "geom_type", F.round("length_m", 6).alias("length_m"), "lat", "lon")


@query(
    "media_list",
    "job:media_list U1 A4",
    """SELECT place_id AS owner_id, 'place' AS level, 'p/' || place_name AS path, 'https://example.org/m/p/' || place_name AS url, CAST(NULL AS VARCHAR) AS caption FROM places
    UNION ALL SELECT visit_id, 'visit', 'v/' || visit_id, 'https://example.org/m/v/' || visit_id, priority FROM visits
    UNION ALL SELECT record_id, 'record', 'r/' || record_id, 'https://example.org/m/r/' || record_id, NULL FROM records""",
)
def _(t):
    return _media(t, t.visits, t.records)


@query(
    "media_list_all",
    "job:media_list U1 A4",
    """SELECT place_id AS owner_id, 'place' AS level, 'p/' || place_name AS path, 'https://example.org/m/p/' || place_name AS url, CAST(NULL AS VARCHAR) AS caption FROM places
    UNION ALL SELECT visit_id, 'visit', 'v/' || visit_id, 'https://example.org/m/v/' || visit_id, priority FROM visits
    UNION ALL SELECT record_id, 'record', 'r/' || record_id, 'https://example.org/m/r/' || record_id, NULL FROM records""",
)
def _(t):
    return _media(t, t.visits, t.records)


def _media(t, visits, records):
    def media(df, key, prefix, suffix):
        return df.select(F.col(key).alias("owner_id"), F.concat(F.lit(prefix), F.col(suffix).cast("string")).alias("path"), *[c for c in ("caption",) if c in df.columns])

    levels = [
        ("place", media(t.places, "place_id", "p/", "place_name")),
        ("visit", media(visits.withColumn("caption", F.col("priority")), "visit_id", "v/", "visit_id")),
        ("record", media(records, "record_id", "r/", "record_id")),
    ]
    return exports.media_list(levels, "https://example.org/m/")


@query(
    "media_per_visit",
    "job:media_list A4",
    """SELECT v.visit_id, a.t AS visit_media, b.t AS record_media FROM visits v
    LEFT JOIN (SELECT visit_id, 'v/' || priority AS t FROM visits WHERE status = 'F') a USING (visit_id)
    LEFT JOIN (SELECT visit_id, string_agg(DISTINCT 'r/' || record_status || substatus, ',' ORDER BY 'r/' || record_status || substatus) AS t FROM records GROUP BY 1) b USING (visit_id)""",
)
def _(t):
    own = t.visits.where("status = 'F'").select("visit_id", F.concat(F.lit("v/"), F.col("priority")).alias("path"))
    theirs = t.records.select("visit_id", F.concat(F.lit("r/"), "record_status", "substatus").alias("path"))
    return exports.media_per_visit(t.visits.select("visit_id"), own, theirs).drop("page")


@query(
    "filtered_listing",
    "job:filtered_listing S1 F1 F3 J1 J2 J7 E1 E3 O1",
    """SELECT v.visit_id, strftime(v.date_start, '%Y-%m-%d') AS date_start, p.user_name, n.parent_name AS nation, v.priority,
    v.total > 250000 AS large FROM visits v LEFT JOIN people p ON p.user_id = v.user_id LEFT JOIN parents n ON n.parent_id = p.nation_id
    WHERE v.status = 'F' AND v.date_start >= DATE '1998-01-01' AND (v.place_id % 10 IN (0, 3, 6, 9))""",
)
def _(t):
    # Each visit belongs to the tenant of its place's last digit; the caller sees tenants 0, 3, 6 and 9.
    rows = t.visits.withColumn("website_id", (F.col("place_id") % 10).cast("int"))
    own = t.region.where("r_regionkey = 0").select(F.col("r_regionkey").alias("website_id"))
    shared = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("to_website_id")
    granted = t.region.select(F.col("r_regionkey").alias("from_website_id"), shared)
    granted = granted.withColumn("receive_for_reporting", F.col("to_website_id") % 3 == 0)
    terms = t.parents.select(F.col("parent_id").alias("term_id"), F.col("parent_name").alias("term"))
    return exports.filtered_listing(
        rows,
        options=[
            ("F", lambda v: F.col("status") == v),
            ("1998-01-01", lambda v: F.col("date_start") >= dates.as_date(v)),
            ("all", lambda v: F.col("priority") == v),
            (0, lambda v: F.col("user_id") == v),
        ],
        tenants=own,
        agreements=granted,
        lookups=[(t.people.select("user_id", "user_name", "nation_id"), "user_id", "left")],
        terms={"nation_id": (terms, "nation")},
        flags={"large": F.col("total") > 250000},
        columns=["visit_id", "date_start", "user_name", "nation", "priority", "large"],
        order=[F.col("date_start").desc(), F.col("visit_id")],
    )


@query(
    "workflow_status",
    "job:workflow_status C4 E2 J2",
    """WITH r AS (SELECT visit_id, bool_or(a.taxon_group <> 'PROMO') AS dna FROM records JOIN taxa a USING (taxon_id) GROUP BY 1),
    v AS (SELECT visit_id, CASE priority WHEN '1-URGENT' THEN 'Sample received' WHEN '2-HIGH' THEN 'Pack requested' ELSE 'Other' END AS stage, total > 250000 AS sugar FROM visits)
    SELECT v.visit_id, stage, sugar AS honey_done, coalesce(dna, FALSE) AS dna_done,
      CASE WHEN NOT sugar AND dna IS NULL AND stage <> 'Other' THEN stage WHEN sugar AND dna IS NULL THEN 'Sugar results added'
      WHEN sugar AND dna IS NOT NULL THEN 'Species results added' END AS proposed FROM v LEFT JOIN r USING (visit_id)""",
)
def _(t):
    stage = recode("priority", {"1-URGENT": "Sample received", "2-HIGH": "Pack requested"}, "Other")
    visits = t.visits.select("visit_id", stage.alias("stage"), F.when(F.col("total") > 250000, F.col("total")).alias("sugar_result"))
    kinds = t.taxa.select("taxon_id", F.when(F.col("taxon_group") == "PROMO", "honey").otherwise("other").alias("taxon_group"))
    rows = t.records.select("visit_id", "taxon_id").join(kinds, "taxon_id")
    return exports.workflow_status(visits, rows)


@query(
    "cursor_feed",
    "job:cursor_feed S3",
    """SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-25' """,
)
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    mark = F.lit("2024-01-25").cast("timestamp_ntz")
    return exports.cursor_feed(rows, "ts", mark, inclusive=True)


@query(
    "users_since",
    "job:cursor_feed S3 A3",
    "SELECT user_id, max(event_id) AS max_id FROM events WHERE event_id > 4000 GROUP BY 1",
)
def _(t):
    return exports.users_since(t.events, "event_id", 4000)


# ---- taxonomy, lists, traits ---------------------------------------------------------


@query(
    "ancestor_expand",
    "job:ancestor_expand J11 J12",
    f"""WITH RECURSIVE tree AS ({TREE_SQL}),
    up AS (SELECT taxon_id AS id FROM taxa WHERE family = 'Brand#7' UNION SELECT t.parent_id FROM up u JOIN tree t ON t.id = u.id WHERE t.parent_id IS NOT NULL)
    SELECT id, term AS name FROM tree WHERE id IN (SELECT id FROM up)""",
)
def _(t):
    tree = taxon_tree(t)
    wanted = t.taxa.where("family = 'Brand#7'").select(F.col("taxon_id").alias("id"))
    return taxonomy.ancestor_expand(wanted, tree.withColumnRenamed("term", "name")).select("id", "name")


@query(
    "rank_ancestor",
    "job:ancestor_expand J11",
    f"""WITH RECURSIVE tree AS ({TREE_SQL}),
    up AS (SELECT id, term AS top, parent_id AS p, 0 AS depth FROM tree WHERE id BETWEEN 3 AND 6
      UNION ALL SELECT t.id, u.top, NULL, 0 FROM up u JOIN tree t ON t.parent_id = u.id)
    SELECT t.id, t.term AS name, u.top AS phylum FROM tree t LEFT JOIN up u ON u.id = t.id""",
)
def _(t):
    tree = taxon_tree(t).withColumnRenamed("term", "name")
    # The taxa two levels below the top play the rank that is looked up.
    path_of = paths(tree)
    ranked = path_of.where(F.size("path") == 3).select("id").join(tree.select("id", "name"), "id")
    return taxonomy.with_rank_ancestor(tree.select("id", "name"), path_of, ranked, "phylum")


@query(
    "term_tree_rollup",
    "job:term_tree_rollup T3",
    f"""WITH RECURSIVE tree AS ({TREE_SQL}),
    walk AS (SELECT id, term, term AS chain, 0 AS depth FROM tree WHERE id = 0
      UNION ALL SELECT c.id, c.term, w.chain || ' >> ' || c.term, w.depth + 1 FROM walk w JOIN tree c ON c.parent_id = w.id WHERE c.term NOT LIKE '%gizmo'),
    links AS (SELECT DISTINCT r.taxon_id AS id, r.place_id FROM records r),
    per AS (SELECT l.id, count(*) AS species, CAST(round(sum(p.parent_id) * 100.0 / count(p.parent_id)) AS BIGINT) AS quality_index
      FROM links l LEFT JOIN places p ON p.place_id = l.place_id AND p.parent_id > 3 GROUP BY 1)
    SELECT w.id, w.term, w.chain, w.depth, coalesce(per.species, 0) AS species, per.quality_index FROM walk w LEFT JOIN per ON per.id = w.id""",
)
def _(t):
    links = t.records.select(F.col("taxon_id").alias("id"), F.col("place_id").alias("taxon_id"))
    scores = t.places.where("parent_id > 3").select(F.col("place_id").alias("taxon_id"), F.col("parent_id").alias("score"))
    return taxonomy.term_tree_rollup(taxon_tree(t), links, scores, F.col("id") == 0, F.col("term").endswith("gizmo"))


@query(
    "name_search",
    "job:name_search F6",
    r"""SELECT taxon_id, name, key AS search_key FROM (SELECT taxon_id, name, regexp_replace(regexp_replace(lower(name), 'ae', 'e', 'g'), '[^a-z0-9?+]', '', 'g') AS key FROM taxa)
    WHERE starts_with(key, 'redb')""",
)
def _(t):
    keyed = taxonomy.search_keys(t.taxa.select("taxon_id", "name"), ["name"])
    return taxonomy.name_search(keyed, "Red B(old name)")


_DESIGNATION_ROWS = values(taxonomy.DESIGNATIONS)


@query(
    "designation_mapping",
    "job:designation_mapping C4",
    f"""WITH m(designation_id, abbreviation, label, label_class) AS (VALUES {_DESIGNATION_ROWS})
    SELECT taxon_id, m.* FROM taxa JOIN m ON m.designation_id = 300 + taxon_id % 200""",
)
def _(t):
    held = t.taxa.select("taxon_id", (F.col("taxon_id") % 200 + 300).alias("designation_id"))
    mapping = taxonomy.designation_mapping(t.spark).withColumn("designation_id", F.col("designation_id"))
    return held.join(F.broadcast(mapping), "designation_id").withColumn("designation_id", F.col("designation_id").cast("int"))


TRAITS_SQL = f"""m(designation_id, abbreviation, label, label_class) AS (VALUES {_DESIGNATION_ROWS}),
    held AS (SELECT taxon_id, 300 + taxon_id % 200 AS designation_id FROM taxa UNION ALL SELECT taxon_id, 400 + taxon_id % 50 FROM taxa),
    des AS (SELECT taxon_id, label, CASE WHEN label LIKE '[%' THEN '[' || label_class || ']' ELSE label_class END AS shown FROM held JOIN m USING (designation_id)),
    d1 AS (SELECT taxon_id, string_agg(DISTINCT label, '; ' ORDER BY label) AS current_designations FROM des GROUP BY 1),
    d2 AS (SELECT taxon_id, string_agg(shown || ' (' || n || ')', '; ' ORDER BY shown || ' (' || n || ')') AS designation_summary FROM
      (SELECT taxon_id, shown, count(*) AS n FROM des GROUP BY 1, 2) GROUP BY 1),
    traits AS (SELECT taxon_id, string_agg(DISTINCT record_status, '; ' ORDER BY record_status) AS biotope,
      string_agg(DISTINCT substatus, '; ' ORDER BY substatus) AS guild FROM records GROUP BY 1),
    near AS (SELECT taxon_id, place_name, (row_number() OVER (PARTITION BY taxon_id ORDER BY place_name) - 1) // 20 AS page FROM (SELECT DISTINCT taxon_id, place_name FROM records JOIN places USING (place_id))),
    assoc AS (SELECT taxon_id, page, string_agg(place_name, ', ' ORDER BY place_name) AS associations FROM near GROUP BY 1, 2)
    SELECT a.taxon_id, a.name, a.family, t.biotope, t.guild, CAST(a.rank_order AS DOUBLE) AS rarity, d1.current_designations, d2.designation_summary, coalesce(assoc.page, 0) AS page, assoc.associations
    FROM taxa a LEFT JOIN traits t USING (taxon_id) LEFT JOIN d1 USING (taxon_id) LEFT JOIN d2 USING (taxon_id) LEFT JOIN assoc USING (taxon_id)"""


def trait_index_of(t):
    status = t.records.select("taxon_id", "record_status", "substatus").distinct()
    item = F.struct
    terms = status.select(
        "taxon_id",
        F.inline(
            F.array(
                item(F.lit(15).alias("attribute_id"), F.col("record_status").alias("term"), F.lit(None).cast("double").alias("number")),
                item(F.lit(16).alias("attribute_id"), F.col("substatus").alias("term"), F.lit(None).cast("double").alias("number")),
            )
        ),
    )
    scores = t.taxa.select(
        "taxon_id", F.lit(24).alias("attribute_id"), F.lit(None).cast("string").alias("term"), F.col("rank_order").cast("double").alias("number")
    )
    held = t.taxa.select("taxon_id", F.explode(F.array(F.col("taxon_id") % 200 + 300, F.col("taxon_id") % 50 + 400)).alias("designation_id"))
    near = t.records.select("taxon_id", "place_id").distinct().join(t.places.select("place_id", "place_name"), "place_id")
    return taxonomy.trait_index(
        t.taxa.select("taxon_id", "name", "family"),
        terms.unionByName(scores),
        {15: "biotope", 16: "guild"},
        {24: "rarity"},
        held,
        near.select("taxon_id", F.col("place_name").alias("name")),
        size=20,
    )


@query("trait_index_rebuild", "job:trait_index_rebuild E1 A4 S6", f"WITH {TRAITS_SQL}")
def _(t):
    return taxonomy.trait_index_rebuild(trait_index_of(t), "trait_index", "v1", scratch_path(t.spark, "derived"))


LISTS_SQL = """countries AS (SELECT parent_name AS code, CASE WHEN region_id = 2 THEN NULL ELSE 'Region ' || region_id END AS place_name, parent_id FROM parents),
    links AS (SELECT n.parent_name AS code, r.taxon_id, min(r.record_status) AS presence, min(r.seen_on) AS since FROM records r
      JOIN places p ON p.place_id = r.place_id JOIN parents n ON n.parent_id = p.parent_id GROUP BY 1, 2),
    want_l AS (SELECT 'EBMS Country List - ' || code AS title, 'List generated for managing the species list for ' || code || coalesce(' (' || place_name || ').', '.') AS description, parent_id FROM countries),
    have_l AS (SELECT title, CASE WHEN parent_id % 2 = 0 THEN description ELSE 'old text' END AS description FROM want_l WHERE parent_id < 20),
    want_e AS (SELECT 'EBMS Country List - ' || code AS title, taxon_id, '{"presence_code":"' || presence || '"}' AS metadata FROM links WHERE presence <> 'A'),
    have_e AS (SELECT 'EBMS Country List - ' || code AS title, taxon_id, '{"presence_code":"' || CASE WHEN taxon_id % 5 = 0 THEN 'X' ELSE presence END || '"}' AS metadata
      FROM links WHERE since < DATE '1999-01-01')"""


def lists_of(t):
    p = F.col("parent_id")
    countries = t.parents.select(
        F.col("parent_name").alias("code"),
        F.when(F.col("region_id") != 2, F.concat(F.lit("Region "), F.col("region_id").cast("string"))).alias("place_name"),
    )
    at = t.places.join(t.parents, "parent_id").select("place_id", F.col("parent_name").alias("code"))
    per = t.records.groupBy("place_id", "taxon_id").agg(F.min("record_status").alias("presence"), F.min("seen_on").alias("since"))
    links = per.join(at, "place_id").groupBy("code", "taxon_id").agg(F.min("presence").alias("presence"), F.min("since").alias("since"))
    old = taxonomy.wanted_lists(countries).join(
        t.parents.select(F.concat(F.lit(taxonomy.LIST_PREFIX), F.col("parent_name")).alias("title"), "parent_id"), "title"
    )
    lists = old.where(p < 20).select("title", F.when(p % 2 == 0, F.col("description")).otherwise("old text").alias("description"))
    stale = links.where(F.col("since") < "1999-01-01").select(
        F.concat(F.lit(taxonomy.LIST_PREFIX), F.col("code")).alias("title"),
        "taxon_id",
        F.to_json(F.struct(F.when(F.col("taxon_id") % 5 == 0, "X").otherwise(F.col("presence")).alias("presence_code"))).alias("metadata"),
    )
    return countries, links, lists, stale


@query(
    "country_list_sync",
    "job:country_list_sync S5 W1",
    f"""WITH {LISTS_SQL}
    SELECT 'list' AS what, w.title, CAST(NULL AS BIGINT) AS taxon_id, w.description AS payload,
      CASE WHEN h.title IS NULL THEN 'I' WHEN h.description <> w.description THEN 'U' ELSE 'S' END AS change FROM want_l w LEFT JOIN have_l h ON h.title = w.title
    UNION ALL SELECT 'entry', coalesce(w.title, h.title), coalesce(w.taxon_id, h.taxon_id), coalesce(w.metadata, h.metadata),
      CASE WHEN h.title IS NULL THEN 'I' WHEN w.title IS NULL THEN 'D' WHEN h.metadata <> w.metadata THEN 'U' ELSE 'S' END
    FROM want_e w FULL JOIN have_e h ON h.title = w.title AND h.taxon_id = w.taxon_id""",
)
def _(t):
    lists, entries = taxonomy.country_list_sync(*lists_of(t))
    a = lists.select(F.lit("list").alias("what"), "title", F.lit(None).cast("long").alias("taxon_id"), F.col("description").alias("payload"), "change")
    b = entries.select(F.lit("entry").alias("what"), "title", "taxon_id", F.col("metadata").alias("payload"), "change")
    return a.unionByName(b)


@query(
    "list_catalogue",
    "job:list_catalogue A4 E4",
    """WITH lists AS (SELECT CAST(parent_id AS BIGINT) AS list_id, CASE WHEN parent_id < 20 THEN 'EBMS Country List - ' || parent_name ELSE parent_name END AS title FROM parents),
    entries AS (SELECT DISTINCT p.parent_id AS list_id, r.taxon_id, a.rank_order % 7 AS g FROM records r JOIN places p ON p.place_id = r.place_id JOIN taxa a ON a.taxon_id = r.taxon_id),
    j AS (SELECT parent_id AS list_id, '{"location_id":' || place_id || ',"location_name":"' || place_name || '"}' AS j FROM places),
    located AS (SELECT list_id, page, '[' || string_agg(j, ',' ORDER BY j) || ']' AS location_info FROM (SELECT *, (row_number() OVER (PARTITION BY list_id ORDER BY j) - 1) // 3 AS page FROM j) GROUP BY 1, 2)
    SELECT l.list_id, l.title, CASE WHEN l.title LIKE 'EBMS Country List - %' THEN replace(l.title, 'EBMS Country List - ', '') END AS region_code,
      coalesce((SELECT '[' || string_agg('{"group_id":' || n.region_id || ',"group_title":"' || g.r_name || '"}', ',') || ']' FROM parents n JOIN region g ON g.r_regionkey = n.region_id
        WHERE n.parent_id = l.list_id AND n.region_id < 4), '[]') AS group_info,
      coalesce(a.page, 0) AS page, coalesce(a.location_info, '[]') AS location_info,
      (SELECT count(*) FROM entries e WHERE e.list_id = l.list_id) AS taxa_count,
      '[' || coalesce((SELECT string_agg(DISTINCT CAST(g AS VARCHAR), ',' ORDER BY CAST(g AS VARCHAR)) FROM entries e WHERE e.list_id = l.list_id), '') || ']' AS species_groups
    FROM lists l LEFT JOIN located a ON a.list_id = l.list_id""",
)
def _(t):
    p = F.col("parent_id")
    key = p.cast("long").alias("list_id")
    title = F.when(p < 20, F.concat(F.lit(taxonomy.LIST_PREFIX), F.col("parent_name"))).otherwise(F.col("parent_name"))
    entries = (
        t.records.select("place_id", "taxon_id")
        .distinct()
        .join(t.places.select("place_id", key), "place_id")
        .select("list_id", "taxon_id")
        .distinct()
        .join(t.taxa.select("taxon_id", (F.col("rank_order") % 7).alias("taxon_group_id")), "taxon_id")
    )
    groups = t.parents.where("region_id < 4").join(t.region, F.col("r_regionkey") == F.col("region_id")).select(
        key, F.col("region_id").alias("group_id"), F.col("r_name").alias("group_title")
    )
    at = t.places.select(key, F.col("place_id").alias("location_id"), F.col("place_name").alias("location_name"))
    return taxonomy.list_catalogue(t.parents.select(key, title.alias("title")), entries, groups, at, size=3)


# ---- history -------------------------------------------------------------------------

HISTORY_SQL = """rec AS (SELECT visit_id AS record_id, priority AS taxon, CASE status WHEN 'F' THEN 'V' WHEN 'O' THEN 'C' ELSE 'R' END AS s,
      CASE WHEN visit_id % 4 = 0 THEN '' ELSE CAST(visit_id % 4 AS VARCHAR) END AS ss, date_start + 60 AS verified_on FROM visits),
    det AS (SELECT visit_id AS record_id, record_id AS id, CAST(min(taxon_id) AS VARCHAR) AS taxon, min(seen_on) AS created_on,
      CASE min(record_status) WHEN 'A' THEN 'V' WHEN 'N' THEN NULL ELSE 'R' END AS s FROM records GROUP BY 1, 2),
    prev AS (SELECT d.record_id, arg_max(d.s, d.id) AS s, arg_max(d.created_on, d.id) AS created_on FROM det d JOIN rec r ON r.record_id = d.record_id
      WHERE d.s IS NOT NULL AND d.created_on < r.verified_on GROUP BY 1),
    names_of(code, label) AS (VALUES ('V', 'accepted'), ('V1', 'accepted as correct'), ('V2', 'accepted as considered correct'), ('C', 'pending'),
      ('C3', 'plausible'), ('R', 'rejected'), ('R4', 'rejected as unable to verify'), ('R5', 'rejected as incorrect'))"""


def histories(t):
    v = F.col("visit_id")
    rows = t.visits.select(
        v.alias("record_id"),
        F.col("priority").alias("taxon"),
        recode("status", {"F": "V", "O": "C"}, "R").alias("record_status"),
        F.when(v % 4 != 0, v % 4).alias("substatus"),
        F.date_add("date_start", 60).alias("verified_on"),
    )
    base = t.records.groupBy("visit_id", "record_id").agg(
        F.min("taxon_id").alias("taxon"), F.min("seen_on").alias("created_on"), F.min("record_status").alias("s")
    )
    given = base.select(F.col("record_id").alias("id"), F.col("visit_id").alias("record_id"), "taxon", "created_on", "s")
    determinations = given.select("record_id", F.col("id").alias("determination_id"), F.col("taxon").cast("string").alias("taxon"), "created_on")
    comments = given.select(
        "record_id",
        F.col("id").alias("comment_id"),
        recode("s", {"A": "V", "R": "R"}).alias("status"),
        F.lit(None).cast("long").alias("substatus"),
        "created_on",
    )
    return rows, determinations, comments


@query(
    "latest_determination",
    "job:latest_determination W1 J9",
    f"""WITH {HISTORY_SQL},
    last AS (SELECT record_id, arg_max(taxon, id) AS taxon, arg_max(created_on, id) AS created_on FROM det GROUP BY 1)
    SELECT r.record_id, r.taxon, coalesce(a.label, r.s || r.ss) AS current_status, strftime(r.verified_on, '%Y-%m-%d') AS verified_on, b.label AS previous_status,
      strftime(p.created_on, '%Y-%m-%d') AS previous_on, l.taxon AS last_determination, strftime(l.created_on, '%Y-%m-%d') AS determined_on
    FROM rec r JOIN last l ON l.record_id = r.record_id LEFT JOIN prev p ON p.record_id = r.record_id
    LEFT JOIN names_of a ON a.code = r.s || r.ss LEFT JOIN names_of b ON b.code = p.s""",
)
def _(t):
    return history.latest_determination(*histories(t))


@query(
    "last_status_before",
    "job:latest_determination J9",
    f"""WITH {HISTORY_SQL}
    SELECT r.record_id, coalesce(a.label, r.s || r.ss) AS current_status, b.label AS previous_status
    FROM rec r LEFT JOIN prev p ON p.record_id = r.record_id LEFT JOIN names_of a ON a.code = r.s || r.ss LEFT JOIN names_of b ON b.code = p.s""",
)
def _(t):
    rows, _, comments = histories(t)
    return history.last_status_before(rows, comments).select("record_id", "current_status", "previous_status")


@query(
    "audit_history",
    "job:audit_history U1 C4",
    """WITH rec AS (SELECT visit_id AS record_id, CAST(date_start AS TIMESTAMP) AS created_on, user_id FROM visits WHERE status = 'F'),
    log AS (SELECT visit_id AS record_id, CASE record_status WHEN 'A' THEN 'Update ' WHEN 'R' THEN 'Delete ' ELSE 'Insert ' END AS action, CAST(seen_on AS TIMESTAMP) AS at, place_id AS user_id,
      CASE WHEN discount > 0.05 THEN '"last_verification_check_date"=>"x"' ELSE '"quantity"=>"' || CAST(quantity AS INTEGER) || '"' END AS changed FROM records),
    h AS (SELECT record_id, 'Inserted' AS action, created_on AS at, user_id, CAST(NULL AS VARCHAR) AS changed,
      CASE WHEN created_on < TIMESTAMP '1996-01-01' THEN 'Record entered before audit logging feature added to the warehouse so initial data values may be inaccurate.' END AS notes FROM rec
      UNION SELECT l.record_id, l.action, l.at, l.user_id, l.changed, CASE WHEN l.changed LIKE '"last_ver%' THEN 'Record cleaner rule check' END
      FROM log l JOIN rec r ON r.record_id = l.record_id)
    SELECT h.record_id, h.action, strftime(h.at, '%Y-%m-%d %H:%M:%S') AS at, h.user_id, p.user_name, h.changed, h.notes FROM h LEFT JOIN people p ON p.user_id = h.user_id""",
)
def _(t):
    rows = t.visits.where("status = 'F'").select(F.col("visit_id").alias("record_id"), F.col("date_start").cast("timestamp").alias("created_on"), "user_id")
    number = F.concat(F.lit('"quantity"=>"'), F.col("quantity").cast("int").cast("string"), F.lit('"'))
    log = t.records.select(
        F.col("visit_id").alias("record_id"),
        recode("record_status", {"A": "U", "R": "D"}, "I").alias("action"),
        F.col("seen_on").cast("timestamp").alias("at"),
        F.col("place_id").alias("user_id"),
        F.when(F.col("discount") > 0.05, '"last_verification_check_date"=>"x"').otherwise(number).alias("changed"),
    )
    return history.audit_history(rows, log, t.people, "1996-01-01")


@query(
    "redeterminations",
    "job:latest_determination W1 J9 A4",
    f"""WITH {HISTORY_SQL},
    last AS (SELECT record_id, max(id) AS id, arg_max(created_on, id) AS made FROM det GROUP BY 1),
    edits AS (SELECT record_id, string_agg(strftime(created_on, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY created_on) AS days FROM det WHERE id % 3 = 0 GROUP BY 1)
    SELECT r.record_id, r.taxon, CASE WHEN l.id % 2 = 0 THEN e.days || ' (estimate from edit comments)' ELSE strftime(l.made + 30, '%Y-%m-%d %H:%M:%S') END AS current_determination_date
    FROM rec r JOIN last l ON l.record_id = r.record_id LEFT JOIN edits e ON e.record_id = r.record_id""",
)
def _(t):
    rows, determinations, comments = histories(t)
    determinations = determinations.withColumn("updated_on", F.when(F.col("determination_id") % 2 == 0, F.col("created_on")).otherwise(F.date_add("created_on", 30)))
    comments = comments.withColumn("text", F.when(F.col("comment_id") % 3 == 0, history.EDITED).otherwise("Seen."))
    return history.redeterminations(rows, determinations, comments).select("record_id", "taxon", "current_determination_date")


# Fields of a logged change, in the order of their names.
_FIELDS = ("last_verification_check_date", "quantity", "status")


def _json(values):
    parts = " || ".join(f"CASE WHEN {v} IS NULL THEN '' ELSE ',\"{n}\":\"' || {v} || '\"' END" for n, v in zip(_FIELDS, values))
    return f"'{{' || substr({parts}, 2) || '}}'"


_BEFORE = "last_value({0} IGNORE NULLS) OVER (PARTITION BY record_id, entity, id ORDER BY log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "audit_trail",
    "job:audit_history U1 J9 W5",
    f"""WITH one AS (SELECT record_id, visit_id, min(tax) AS tax, min(place_id) AS place_id, min(record_status) AS record_status, min(seen_on) AS seen_on, min(quantity) AS quantity,
      min(substatus) AS substatus FROM records GROUP BY 1, 2),
    raw AS (SELECT record_id AS log_id, visit_id AS record_id, CASE WHEN tax > 0.05 THEN 'occurrence_attribute_values' ELSE 'occurrences' END AS entity,
      CASE WHEN tax > 0.05 THEN place_id ELSE visit_id END AS id, record_status, seen_on, place_id,
      CASE WHEN record_id % 10 % 3 <> 0 THEN CAST(CAST(quantity AS INTEGER) AS VARCHAR) END AS q, CASE WHEN record_id % 10 % 2 = 0 THEN substatus END AS st FROM one),
    log AS (SELECT *, CASE WHEN q IS NULL AND st IS NULL THEN strftime(seen_on, '%Y-%m-%d') END AS ck FROM raw),
    before AS (SELECT *, {_BEFORE.format('ck')} AS b_ck, coalesce({_BEFORE.format('q')}, CASE entity WHEN 'occurrences' THEN '0' END) AS b_q,
      coalesce({_BEFORE.format('st')}, CASE entity WHEN 'occurrences' THEN 'new' END) AS b_st FROM log)
    SELECT e.*, p.user_name FROM (
      SELECT visit_id AS record_id, 'Inserted' AS action, 'occurrences' AS entity, visit_id AS id, strftime(date_start, '%Y-%m-%d %H:%M:%S') AS at, user_id, CAST(NULL AS VARCHAR) AS row_before,
        '{{"quantity":"0","status":"new"}}' AS changed,
        CASE WHEN date_start < DATE '1996-01-01' THEN 'Record entered before audit logging feature added to the warehouse so initial data values may be inaccurate.' END AS notes FROM visits
      UNION ALL SELECT record_id, CASE record_status WHEN 'A' THEN 'Update ' WHEN 'R' THEN 'Delete ' ELSE 'Insert ' END, entity, id, strftime(seen_on, '%Y-%m-%d %H:%M:%S'), place_id,
        CASE WHEN coalesce(b_ck, b_q, b_st) IS NOT NULL THEN {_json(('b_ck', 'b_q', 'b_st'))} END, {_json(('ck', 'q', 'st'))},
        concat_ws('. ', CASE WHEN entity = 'occurrences' AND ck IS NOT NULL THEN 'Record cleaner rule check' END,
          CASE WHEN place_id % 7 = 0 THEN 'Action carried out directly on the back-end database' END) FROM before) e
    LEFT JOIN people p ON p.user_id = e.user_id""",
)
def _(t):
    rows = t.visits.select(F.col("visit_id").alias("record_id"), F.col("date_start").cast("timestamp").alias("created_on"), "user_id")
    inserted = t.visits.select(
        F.col("visit_id").alias("record_id"), F.lit("occurrences").alias("entity"), F.col("visit_id").alias("id"), F.explode(F.create_map(F.lit("quantity"), F.lit("0"), F.lit("status"), F.lit("new"))).alias("field", "value")
    )
    line, attribute = F.col("record_id") % 10, F.col("tax") > 0.05
    values = [F.when((line % 3 == 0) & (line % 2 != 0), F.date_format("seen_on", "yyyy-MM-dd")), F.when(line % 3 != 0, F.col("quantity").cast("int").cast("string")), F.when(line % 2 == 0, F.col("substatus"))]
    changed = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in _FIELDS]), F.array(*values)), lambda k, v: v.isNotNull())
    # The stand-in repeats a record's id now and then; a log does not.
    one = t.records.groupBy("record_id", "visit_id").agg(*[F.min(c).alias(c) for c in ("tax", "place_id", "record_status", "seen_on", "quantity", "substatus")])
    log = one.select(
        F.col("record_id").alias("log_id"),
        F.col("visit_id").alias("record_id"),
        F.when(attribute, "occurrence_attribute_values").otherwise("occurrences").alias("entity"),
        F.when(attribute, F.col("place_id")).otherwise(F.col("visit_id")).alias("id"),
        recode("record_status", {"A": "U", "R": "D"}, "I").alias("action"),
        F.col("seen_on").cast("timestamp").alias("at"),
        F.col("place_id").alias("user_id"),
        F.when(F.col("place_id") % 7 == 0, "postgres").otherwise("web").alias("session"),
        changed.alias("changed"),
    )
    return history.audit_trail(rows, log, t.people, inserted, "1996-01-01")
