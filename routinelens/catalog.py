"""The registered queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routinelens import model
from routinelens.model import DAY, HOUR, MINUTE, PRELUDE, SECOND
from routinelens.functions import circular
from routinelens.learn import home_mode as home
from routinelens.learn import ranking
from routinelens.learn import sequence as recurrent
from routinelens.operators import activity, association, causality, conditional, conditions, conflicts, crossings, dimensions, habits, health, motifs as motif, replay, sequences, signals, store
from routinelens.sources import automations
from routinelens.storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Register a function under its name with the SQL of the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return put


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.state_changes(spark, sf_dir)


_ANNOTATED: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """What a table is now: its files' number and bytes and its last change, as the file system tells; nothing is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.getContentSummary(at)
    return whole.getFileCount(), whole.getLength(), fs.getFileStatus(at).getModificationTime()


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes with their causes: written once per application and state of the input, and read by every query that needs them."""
    key = (spark.sparkContext.applicationId, sf_dir, *_stamp(spark, f"{sf_dir}/events.parquet"))
    if key not in _ANNOTATED:
        _ANNOTATED[key] = materialise(causality.annotate(changes(spark, sf_dir)), "annotated")
    return _ANNOTATED[key]


# --- scans -----------------------------------------------------------------------------------------------------------

#: The first week of the driver's events is before the window of the queries that have one.
START = 1_704_672_000_000_000


@query(f"""SELECT sid, us, entity_id, state, old_state FROM base
    WHERE us >= {START} AND us < (SELECT max(us) FROM base) AND domain <> 'person' AND entity_id NOT LIKE 'sensor.t3%'""")
def state_changes_scan(spark, sf_dir):
    from routinelens.sources import recorder

    rows = changes(spark, sf_dir)
    return recorder.window(rows, START).filter(recorder.included(["person"], ["sensor.t3*"])).select("sid", "us", "entity_id", "state", "old_state")


@query("SELECT min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM base")
def time_bounds(spark, sf_dir):
    return changes(spark, sf_dir).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT entity_id, domain FROM base")
def entity_ids(spark, sf_dir):
    return changes(spark, sf_dir).select("entity_id", "domain").distinct()


# --- causality -------------------------------------------------------------------------------------------------------


@query("SELECT sid, cause, cause_entity, chain_depth FROM ann")
def root_causes(spark, sf_dir):
    return annotated(spark, sf_dir).select("sid", "cause", "cause_entity", "chain_depth")


@query("SELECT cause, count(*) AS n, cause = 'unknown' AND count(*) >= 0.1 * sum(count(*)) OVER () AS flagged FROM ann GROUP BY cause")
def cause_histogram(spark, sf_dir):
    return causality.cause_histogram(annotated(spark, sf_dir))


OVERRIDES = """, pend AS (SELECT *, last_value(CASE WHEN cause IN ('automation', 'script') THEN struct_pack(sid := sid, us := us, state := state, by_ := cause_entity) END IGNORE NULLS)
        OVER (PARTITION BY entity_id ORDER BY us, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ann),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY entity_id, p.sid ORDER BY us, sid) AS n FROM pend WHERE cause = 'human' AND p IS NOT NULL AND state <> p.state),
    ov AS (SELECT entity_id, us, p.by_ AS automation, p.state AS automation_state, state AS human_state, us - p.us AS delay_us, context
        FROM firsts WHERE n = 1 AND us - p.us <= 1800000000)
"""
#: The driver's events are sparse, so corrections count for half an hour.
WITHIN = 1800 * SECOND


def _overrides(spark, sf_dir):
    return causality.overrides(annotated(spark, sf_dir), WITHIN)


@query(OVERRIDES + "SELECT * FROM ov")
def overrides(spark, sf_dir):
    return _overrides(spark, sf_dir)


@query(OVERRIDES + """, s AS (SELECT automation, human_state, count(*) AS n FROM ov GROUP BY ALL)
    SELECT automation, count(*) AS overrides, count(DISTINCT entity_id) AS entities,
           (SELECT string_agg(human_state || '=' || n, ',' ORDER BY human_state || '=' || n) FROM s WHERE s.automation = ov.automation) AS preferred
    FROM ov GROUP BY automation""")
def override_summary(spark, sf_dir):
    return causality.override_summary(_overrides(spark, sf_dir))


@query(OVERRIDES + "SELECT entity_id, us // 86400000000 AS day, count(*) AS n FROM ov GROUP BY ALL")
def overrides_per_entity_day(spark, sf_dir):
    return _overrides(spark, sf_dir).groupBy("entity_id", model.day(F.col("us")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


# --- human actions and habits ----------------------------------------------------------------------------------------

ACTS = """, acts AS (SELECT sid, us, entity_id, domain, lower(state) AS state, context, day, minute, wd FROM ann
    WHERE cause = 'human' AND domain IN ('light', 'media_player', 'switch') AND old_state IS NOT NULL AND old_state <> state)
"""


def _actions(spark, sf_dir):
    return habits.human_actions(annotated(spark, sf_dir))


@query(ACTS + "SELECT entity_id, state, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM acts GROUP BY ALL")
def human_actions(spark, sf_dir):
    return _actions(spark, sf_dir).groupBy("entity_id", "state").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("SELECT domain, count(*) AS n FROM ann WHERE cause = 'human' AND old_state IS NOT NULL AND old_state <> state GROUP BY domain")
def human_actions_by_domain(spark, sf_dir):
    rows = annotated(spark, sf_dir).filter((F.col("cause") == "human") & model.is_transition())
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


#: A registry made of the entities themselves: spare ones that no event names, one hidden, one disabled, and a category for media players numbered 1.
REGISTRY = """, rg AS (SELECT entity_id, domain, entity_id = 'switch.z2' AS hidden, entity_id = 'light.z3' AS disabled, CASE WHEN entity_id = 'media_player.z1' THEN 'diagnostic' END AS category FROM (SELECT DISTINCT entity_id, domain FROM base)
        UNION ALL SELECT DISTINCT domain || '.spare', domain, false, false, CASE WHEN domain = 'switch' THEN 'config' END FROM base)
"""


def _registry(spark, sf_dir):
    known = entity_ids(spark, sf_dir)
    spare = known.select(F.concat("domain", F.lit(".spare")).alias("entity_id"), "domain").distinct()
    name = F.col("entity_id")
    category = F.when((name == "media_player.z1") | (name == "switch.spare"), F.when(name == "switch.spare", "config").otherwise("diagnostic"))
    return known.unionByName(spare).select("entity_id", "domain", (name == "switch.z2").alias("hidden"), (name == "light.z3").alias("disabled"), category.alias("category"))


@query(REGISTRY + """SELECT rg.entity_id, count(ann.sid) AS passive FROM rg LEFT JOIN ann USING (entity_id) WHERE rg.domain IN ('light', 'media_player', 'switch') AND NOT hidden AND NOT disabled AND category IS NULL
    GROUP BY rg.entity_id HAVING count(*) FILTER (cause = 'human') = 0""")
def unused_entities(spark, sf_dir):
    """Entities of a registry that nobody ever touched in the whole history."""
    return health.unused(annotated(spark, sf_dir), _registry(spark, sf_dir)).select("entity_id", "passive")


@query(REGISTRY + """, dy AS (SELECT DISTINCT day FROM ann) SELECT rg.entity_id, dy.day, count(ann.sid) AS passive FROM rg JOIN dy ON true LEFT JOIN ann ON ann.entity_id = rg.entity_id AND ann.day = dy.day
    WHERE rg.domain IN ('light', 'media_player', 'switch') AND NOT hidden AND NOT disabled AND category IS NULL GROUP BY ALL HAVING count(*) FILTER (cause = 'human') = 0""")
def unused_by_day(spark, sf_dir):
    """The same for each day that has any event."""
    rows = annotated(spark, sf_dir).withColumn("day", model.day(F.col("us")))
    return health.unused(rows, _registry(spark, sf_dir), "day").select("entity_id", "day", "passive")


@query(ACTS + """, z AS (SELECT entity_id, state, count(*) AS n, sum(sin(minute * 2 * pi() / 1440)) AS s, sum(cos(minute * 2 * pi() / 1440)) AS c FROM acts GROUP BY ALL)
    SELECT entity_id, state, n, round((atan2(s, c) * 1440 / (2 * pi()) + 1440) % 1440, 6) AS mean_minute,
    CASE WHEN n < 2 THEN 0.0 ELSE round(sqrt(-2 * ln(greatest(least(sqrt((s / n) ** 2 + (c / n) ** 2), 1.0), 1e-9))) * 1440 / (2 * pi()), 6) END AS spread FROM z""")
def circular_stats(spark, sf_dir):
    m = F.col("minute")
    return _actions(spark, sf_dir).groupBy("entity_id", "state").agg(F.count(F.lit(1)).alias("n"), F.round(circular.mean(m), 6).alias("mean_minute"), F.round(circular.std(m), 6).alias("spread"))


def _bounds(spark, sf_dir):
    return tuple(changes(spark, sf_dir).agg(F.min("us"), F.max("us")).first())


DAYS = """, span AS (SELECT min(us) // 86400000000 AS a, max(us) // 86400000000 AS b FROM base),
    cal AS (SELECT unnest(generate_series(a, b)) AS dn FROM span), f(rank, filter, low, high) AS (VALUES (0, 'all', 0, 6), (1, 'weekdays', 0, 4), (2, 'weekends', 5, 6)),
    elig AS (SELECT filter, count(*) AS days FROM cal JOIN f ON (dn + 3) % 7 BETWEEN low AND high GROUP BY filter)
"""


@query(DAYS + "SELECT filter, days FROM elig")
def eligible_days(spark, sf_dir):
    return habits.eligible_days(*_bounds(spark, sf_dir), spark)


FIRSTS = ACTS + DAYS + """, one AS (SELECT entity_id, state, day, min_by(minute, us) AS minute, min(us) AS us, min(wd) AS wd FROM acts GROUP BY ALL),
    daily AS (SELECT one.*, rank, filter FROM one JOIN f ON wd BETWEEN low AND high)
"""


@query(FIRSTS + "SELECT entity_id, state, day, minute, us, filter FROM daily")
def first_per_day(spark, sf_dir):
    return habits.first_per_day(_actions(spark, sf_dir)).select("entity_id", "state", "day", "minute", "us", "filter")


CLUSTERS = FIRSTS + """, grp AS (SELECT entity_id, state, rank, filter FROM daily GROUP BY ALL HAVING count(*) >= 3),
    d AS (SELECT daily.* FROM daily JOIN grp USING (entity_id, state, rank, filter)),
    cen AS (SELECT DISTINCT entity_id, state, rank, filter, minute AS centre FROM d),
    near AS (SELECT c.*, d.minute FROM cen c JOIN d USING (entity_id, state, rank, filter) WHERE least(abs(minute - centre), 1440 - abs(minute - centre)) <= 60),
    cs AS (SELECT entity_id, state, rank, filter, centre, count(*) AS m, sum(sin(minute * 2 * pi() / 1440)) AS s, sum(cos(minute * 2 * pi() / 1440)) AS c FROM near GROUP BY ALL),
    top AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY entity_id, state, rank ORDER BY m DESC, centre) = 1),
    ref AS (SELECT *, (atan2(s, c) * 1440 / (2 * pi()) + 1440) % 1440 AS mean FROM top),
    kept AS (SELECT ref.entity_id, ref.state, ref.rank, ref.filter, m, centre, mean, count(*) FILTER (least(abs(minute - mean), 1440 - abs(minute - mean)) <= 60) AS k
             FROM ref JOIN d USING (entity_id, state, rank, filter) GROUP BY ALL),
    cl AS (SELECT entity_id, state, rank, filter, CASE WHEN k >= m THEN mean ELSE centre END AS centre, greatest(k, m) AS members FROM kept)
"""


@query(CLUSTERS + "SELECT entity_id, state, filter, round(centre, 6) AS centre, members FROM cl")
def tod_clusters(spark, sf_dir):
    """Bandwidth 60 minutes and three days: the driver's events have no real habits."""
    found = habits.clusters(habits.first_per_day(_actions(spark, sf_dir)), 60, 3)
    return found.select("entity_id", "state", "filter", F.round("centre", 6).alias("centre"), "members")


@query(CLUSTERS + """, busy AS (SELECT entity_id, state FROM acts GROUP BY ALL HAVING count(*) >= 3),
    h AS (SELECT d.entity_id, d.state, d.rank, d.filter, count(*) AS hits FROM d JOIN cl USING (entity_id, state, rank, filter) JOIN busy USING (entity_id, state)
        WHERE least(abs(minute - centre), 1440 - abs(minute - centre)) <= 60 GROUP BY ALL HAVING count(*) >= 3),
    r AS (SELECT h.*, days, least(hits / days, 1.0) AS consistency FROM h JOIN elig USING (filter))
    SELECT entity_id, state, filter, hits, days, round(consistency, 9) AS consistency, round(consistency * least(hits / 3, 2.0) / 2, 9) AS score
    FROM (SELECT *, CASE WHEN rank = 0 THEN consistency ELSE consistency - 0.15 END AS worth FROM r)
    QUALIFY row_number() OVER (PARTITION BY entity_id, state ORDER BY worth DESC, rank) = 1 AND consistency >= 0.1""")
def tod_habits(spark, sf_dir):
    found = habits.time_of_day(_actions(spark, sf_dir), *_bounds(spark, sf_dir), bandwidth=60, min_occurrences=3, min_consistency=0.1)
    return found.select("entity_id", "state", "filter", "hits", "days", F.round("consistency", 9).alias("consistency"), F.round("score", 9).alias("score"))


# --- signals ---------------------------------------------------------------------------------------------------------


def _points(spark, sf_dir):
    return signals.build(changes(spark, sf_dir))


def _probes(spark, sf_dir):
    """The sensor of an action: that of its number."""
    rows = _actions(spark, sf_dir)
    return rows.select(F.col("sid").alias("action"), F.concat(F.lit("sensor.t"), F.substring("entity_id", -1, 1)).alias("entity_id"), "us")


def _asof_sql(stale: str) -> str:
    return ACTS + f"""SELECT a.sid AS action, 'sensor.t' || right(a.entity_id, 1) AS entity_id, {stale} AS num
        FROM acts a ASOF LEFT JOIN base b ON b.entity_id = 'sensor.t' || right(a.entity_id, 1) AND a.us >= b.us"""


@query(_asof_sql("b.num"))
def signal_asof(spark, sf_dir):
    return signals.value_at(_probes(spark, sf_dir), _points(spark, sf_dir)).select("action", "entity_id", "num")


@query(_asof_sql("CASE WHEN a.us - b.us <= 10800000000 THEN b.num END"))
def signal_asof_stale_3h(spark, sf_dir):
    return signals.value_at(_probes(spark, sf_dir), _points(spark, sf_dir), 3 * HOUR).select("action", "entity_id", "num")


@query(_asof_sql("CASE WHEN a.us - b.us <= 21600000000 THEN b.num END"))
def signal_asof_stale_6h(spark, sf_dir):
    return signals.value_at(_probes(spark, sf_dir), _points(spark, sf_dir), 6 * HOUR).select("action", "entity_id", "num")


@query("SELECT entity_id, count(*) AS n, count(num) = count(*) AS numeric, min(num) AS low, max(num) AS high, count(DISTINCT state) AS states FROM base GROUP BY entity_id")
def signal_catalog(spark, sf_dir):
    return signals.catalogue(_points(spark, sf_dir))


@query("""SELECT entity_id, state AS str, row_number() OVER (PARTITION BY entity_id ORDER BY u, s) AS rank
    FROM (SELECT entity_id, state, min(us) AS u, min(sid) AS s FROM base GROUP BY ALL) QUALIFY rank <= 20""")
def signal_values(spark, sf_dir):
    return signals.distinct_values(_points(spark, sf_dir))


@query("""SELECT entity_id, count(*) AS n, round(sum(num), 6) AS total FROM (
        SELECT entity_id, us, num FROM base WHERE domain = 'sensor' AND day_ = 19723
        UNION ALL SELECT s.entity_id, s.us, s.num FROM (SELECT entity_id, (us // 3600000000) * 3600000000 + 3600000000 AS us, avg(num) AS num FROM base WHERE domain = 'sensor' GROUP BY ALL) s
        JOIN (SELECT entity_id, min(us) AS a, max(us) AS b FROM base WHERE domain = 'sensor' AND us // 86400000000 = 19723 GROUP BY entity_id HAVING count(*) < 2400) r USING (entity_id)
        WHERE (s.us < a OR s.us > b) AND s.us < 1706400000000000) GROUP BY entity_id""".replace("day_", "us // 86400000000"))
def signal_top_up(spark, sf_dir):
    """A window of one day of sensor points, as of a short history, topped up by hourly means of the whole one."""
    points = _points(spark, sf_dir).filter(F.col("entity_id").startswith("sensor."))
    hourly = points.groupBy("entity_id", (F.floor(F.col("us") / HOUR) * HOUR).alias("start_us")).agg(F.avg("num").alias("mean"), F.max("num").alias("max"))
    topped = signals.top_up(points.filter(model.day(F.col("us")) == 19723), hourly, 1_706_400_000_000_000, few=2400)
    return topped.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("num"), 6).alias("total"))


# --- association -----------------------------------------------------------------------------------------------------

#: Baskets reach five minutes to either side.
AROUND = 300 * SECOND
ITEM_DOMAINS = ("light", "media_player", "switch", "person")
BASKETS = """, it AS (SELECT sid, us, entity_id, entity_id || '=' || lower(state) AS item, cause FROM ann
        WHERE old_state IS NOT NULL AND old_state <> state AND cause IN ('human', 'automation', 'device') AND domain IN ('light', 'media_player', 'switch', 'person')),
    bk AS (SELECT a.sid AS anchor, b.item, min(b.us) AS us FROM it a JOIN it b ON b.us BETWEEN a.us - 300000000 AND a.us + 300000000 WHERE a.cause = 'human' GROUP BY ALL),
    bs AS (SELECT * FROM bk QUALIFY count(*) OVER (PARTITION BY anchor) > 1),
    pr AS (SELECT x.item AS a, y.item AS c, count(*) AS n, count(*) FILTER (x.us < y.us) AS forward FROM bs x JOIN bs y ON x.anchor = y.anchor AND x.item <> y.item GROUP BY ALL)
"""


def _items(spark, sf_dir):
    return association.items(annotated(spark, sf_dir), ITEM_DOMAINS)


@query(BASKETS + "SELECT anchor, item, us FROM bs")
def association_baskets(spark, sf_dir):
    return association.baskets(_items(spark, sf_dir), AROUND)


@query(BASKETS + "SELECT a, c, n, forward FROM pr")
def association_pairs(spark, sf_dir):
    return association.pairs(_items(spark, sf_dir), AROUND)


@query(BASKETS + """, tot AS (SELECT count(DISTINCT anchor) AS t FROM bs), si AS (SELECT item, count(*) AS n FROM bs GROUP BY item),
    hand AS (SELECT item, count(*) AS n FROM it WHERE cause = 'human' GROUP BY item),
    r AS (SELECT p.a, p.c, p.n, p.n / t AS support, p.n / x.n AS confidence, p.n * t / (x.n * y.n) AS lift, p.forward, coalesce(q.forward, 0) AS backward
        FROM pr p LEFT JOIN pr q ON q.a = p.c AND q.c = p.a JOIN si x ON x.item = p.a JOIN si y ON y.item = p.c JOIN hand ON hand.item = p.c, tot
        WHERE t >= 10 AND hand.n >= 3 AND split_part(p.a, '=', 1) <> split_part(p.c, '=', 1) AND split_part(p.c, '.', 1) IN ('light', 'media_player', 'switch'))
    SELECT a, c, n, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift, forward, backward, round(least(confidence * least(lift / 3, 1.0), 1.0), 9) AS score FROM r
    WHERE support >= 0.01 AND confidence >= 0.02 AND lift >= 0.5 AND forward >= backward AND (split_part(a, '.', 1) NOT IN ('light', 'media_player', 'switch') OR forward >= 1.0 * backward)
    QUALIFY row_number() OVER (PARTITION BY split_part(a, '=', 1), c ORDER BY confidence DESC, lift DESC, a) = 1""")
def association_rules(spark, sf_dir):
    """Low bars: the driver's events are independent of each other."""
    made = association.rules(_items(spark, sf_dir), AROUND, min_support=0.01, min_confidence=0.02, min_lift=0.5, ratio=1.0)
    return made.select("a", "c", "n", *[F.round(c, 9).alias(c) for c in ("support", "confidence", "lift")], "forward", "backward", F.round("score", 9).alias("score"))


# --- sequences -------------------------------------------------------------------------------------------------------

SESSIONS = """, us_ AS (SELECT sid, us, context, cause, chain_depth, entity_id || '=' || lower(state) AS item FROM ann
        WHERE old_state IS NOT NULL AND old_state <> state AND cause <> 'unknown' AND num IS NULL),
    mk AS (SELECT *, CASE WHEN us - lag(us) OVER (ORDER BY us, sid) <= 300000000 THEN 0 ELSE 1 END AS st FROM us_),
    ss AS (SELECT *, sum(st) OVER (ORDER BY us, sid) AS g FROM mk), se AS (SELECT *, min(sid) OVER (PARTITION BY g) AS session_id FROM ss),
    sm AS (SELECT session_id, count(*) AS n, count(*) FILTER (cause = 'human') AS human, min(us) AS start_us, max(us) AS end_us FROM se GROUP BY session_id),
    sq AS (SELECT session_id AS seq_id, list(item ORDER BY u, s) AS items FROM (SELECT session_id, item, min(us) AS u, min(sid) AS s FROM se JOIN sm USING (session_id) WHERE n > 1 AND human > 0 GROUP BY ALL)
        GROUP BY session_id HAVING count(*) > 1)
"""
GAP = 300 * SECOND


def _sessions(spark, sf_dir):
    return sequences.sessions(sequences.usable(annotated(spark, sf_dir)), GAP)


@query(SESSIONS + "SELECT session_id, n, human, start_us, end_us FROM sm")
def activity_sessions(spark, sf_dir):
    return sequences.session_summary(_sessions(spark, sf_dir))


@query(SESSIONS + "SELECT seq_id, array_to_string(items, '>') AS items FROM sq")
def session_sequences(spark, sf_dir):
    return sequences.session_sequences(_sessions(spark, sf_dir)).select("seq_id", F.array_join("items", ">").alias("items"))


@query(SESSIONS + """, pl AS (SELECT seq_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM sq),
    p2 AS (SELECT a.item AS i1, b.item AS i2, count(*) AS support FROM pl a JOIN pl b ON a.seq_id = b.seq_id AND a.pos < b.pos GROUP BY ALL HAVING count(*) >= 4),
    p3 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS support FROM pl a JOIN pl b ON a.seq_id = b.seq_id AND a.pos < b.pos JOIN pl c ON c.seq_id = b.seq_id AND b.pos < c.pos GROUP BY ALL HAVING count(*) >= 4)
    SELECT i1 || '>' || i2 AS pattern, 2 AS length, support FROM p2 UNION ALL SELECT i1 || '>' || i2 || '>' || i3, 3, support FROM p3
    UNION ALL SELECT a.item || '>' || b.item || '>' || c.item || '>' || d.item, 4, count(*) FROM pl a JOIN pl b ON a.seq_id = b.seq_id AND a.pos < b.pos JOIN pl c ON c.seq_id = b.seq_id AND b.pos < c.pos JOIN pl d ON d.seq_id = c.seq_id AND c.pos < d.pos GROUP BY ALL HAVING count(*) >= 4""")
def sequence_patterns(spark, sf_dir):
    return sequences.patterns(sequences.session_sequences(_sessions(spark, sf_dir)), 4).drop("items")


# --- conditions ------------------------------------------------------------------------------------------------------

BACKGROUND = ACTS + """, w AS (SELECT min(us) AS a, max(us) AS b FROM base), la AS (SELECT entity_id, state, us FROM acts),
    ki AS (SELECT DISTINCT entity_id, state FROM la), ti AS (SELECT DISTINCT entity_id, state, us % 86400000000 AS tod FROM la),
    bu AS (SELECT DISTINCT entity_id, state, (us - a) // 86400000000 AS n FROM la, w),
    al AS (SELECT entity_id, state, unnest(generate_series(0, (b - a) // 86400000000)) AS n FROM ki, w),
    bg AS (SELECT entity_id, state, a - a % 86400000000 + n * 86400000000 + tod AS us FROM (SELECT * FROM al ANTI JOIN bu USING (entity_id, state, n)) JOIN ti USING (entity_id, state), w
        WHERE a - a % 86400000000 + n * 86400000000 + tod >= a AND a - a % 86400000000 + n * 86400000000 + tod < b)
"""


def _moments(spark, sf_dir):
    return _actions(spark, sf_dir).select("entity_id", "state", "us")


def _background(spark, sf_dir):
    return conditional.background(_moments(spark, sf_dir), *_bounds(spark, sf_dir))


@query(BACKGROUND + "SELECT entity_id, state, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM bg GROUP BY ALL")
def background_samples(spark, sf_dir):
    return _background(spark, sf_dir).groupBy("entity_id", "state").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def _samples(spark, sf_dir, domains: list[str]):
    """Every action and background moment with all signals of the domains."""
    marked = _moments(spark, sf_dir).withColumn("positive", F.lit(True)).unionByName(_background(spark, sf_dir).withColumn("positive", F.lit(False)))
    names = sorted(r["entity_id"] for r in entity_ids(spark, sf_dir).filter(F.col("domain").isin(domains)).collect())
    return signals.values_at(marked, _points(spark, sf_dir), names, 3 * HOUR).select("entity_id", "state", "signal", "positive", "us", "num", "str")


SAMPLES = BACKGROUND + """, mk AS (SELECT entity_id, state, us, true AS positive FROM la UNION ALL SELECT entity_id, state, us, false FROM bg),
    sg_n AS (SELECT DISTINCT entity_id AS sig FROM base WHERE domain IN ('sensor', 'person')),
    sa AS MATERIALIZED (SELECT m.entity_id, m.state, m.sig AS signal, m.us, positive, CASE WHEN m.us - b.us <= 10800000000 THEN b.num END AS num, CASE WHEN m.us - b.us <= 10800000000 THEN b.state END AS str
        FROM (SELECT * FROM mk, sg_n) m ASOF LEFT JOIN base b ON b.entity_id = m.sig AND m.us >= b.us)
"""


@query(SAMPLES + """, v AS (SELECT * FROM sa WHERE num IS NOT NULL), t AS (SELECT entity_id, state, signal, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nb FROM v GROUP BY ALL)
    SELECT entity_id, state, signal, np, nb, count(DISTINCT round(num, 2)) AS cuts, round(min(num) FILTER (positive), 6) AS low, round(max(num) FILTER (positive), 6) AS high FROM v JOIN t USING (entity_id, state, signal) GROUP BY ALL""")
def condition_samples(spark, sf_dir):
    v = _samples(spark, sf_dir, ["sensor"]).filter("num is not null")
    return v.groupBy("entity_id", "state", "signal").agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nb"), F.countDistinct(F.round("num", 2)).alias("cuts"), F.round(F.min(F.when(F.col("positive"), F.col("num"))), 6).alias("low"), F.round(F.max(F.when(F.col("positive"), F.col("num"))), 6).alias("high"))


SPLIT = SAMPLES + """, v AS (SELECT * FROM sa WHERE str IS NOT NULL AND signal LIKE 'person%'), t AS (SELECT entity_id, state, signal, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nb FROM v GROUP BY ALL),
    g AS (SELECT entity_id, state, signal, str, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS b, min(us) FILTER (positive) AS f FROM v GROUP BY ALL),
    cs AS (SELECT entity_id, state, signal, str AS value, p / np AS coverage, greatest(b, 0.5) / nb AS baseline FROM g JOIN t USING (entity_id, state, signal) WHERE p > 0 AND np >= 4 AND nb >= 10
        QUALIFY row_number() OVER (PARTITION BY entity_id, state, signal ORDER BY p DESC, f) = 1)
"""


@query(SPLIT + "SELECT entity_id, state, signal, value, round(coverage, 9) AS coverage, round(baseline, 9) AS baseline FROM cs")
def categorical_split(spark, sf_dir):
    found = conditional.categorical_split(_samples(spark, sf_dir, ["person"]))
    return found.select("entity_id", "state", "signal", "value", F.round("coverage", 9).alias("coverage"), F.round("baseline", 9).alias("baseline"))


STUMP = SPLIT + """, nv AS (SELECT *, round(num, 2) AS cut FROM sa WHERE num IS NOT NULL), nt AS (SELECT entity_id, state, signal, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nb, count(DISTINCT cut) AS cuts FROM nv GROUP BY ALL),
    nc AS (SELECT DISTINCT entity_id, state, signal, cut FROM nv),
    nm AS (SELECT entity_id, state, signal, num AS v, CAST(NULL AS DOUBLE) AS cut, CAST(positive AS INT) AS p, CAST(NOT positive AS INT) AS b FROM nv UNION ALL SELECT entity_id, state, signal, cut, cut, 0, 0 FROM nc),
    nu AS (SELECT entity_id, state, signal, cut, sum(p) OVER w AS pu, sum(b) OVER w AS bu, sum(p) OVER s AS ps, sum(b) OVER s AS bs FROM nm
        WINDOW w AS (PARTITION BY entity_id, state, signal ORDER BY v), s AS (PARTITION BY entity_id, state, signal, v)),
    nh AS (SELECT entity_id, state, signal, cut, 'below' AS direction, 0 AS late, pu - ps AS p, bu - bs AS b FROM nu WHERE cut IS NOT NULL
        UNION ALL SELECT entity_id, state, signal, cut, 'above', 1, np - pu, nb - bu FROM nu JOIN nt USING (entity_id, state, signal) WHERE cut IS NOT NULL),
    nr AS (SELECT *, p / np AS coverage, (p / np) / (greatest(b, 0.5) / nb) AS lift FROM nh JOIN nt USING (entity_id, state, signal) WHERE np >= 4 AND nb >= 10 AND cuts >= 2),
    ns AS (SELECT *, coverage * least(lift / 2, 1.0) AS strength FROM nr WHERE coverage >= 0.2 AND lift >= 0.5
        QUALIFY row_number() OVER (PARTITION BY entity_id, state, signal ORDER BY strength DESC, cut, late) = 1)
"""


@query(STUMP + "SELECT entity_id, state, signal, direction, cut, round(coverage, 9) AS coverage, round(lift, 9) AS lift, round(strength, 9) AS strength FROM ns")
def numeric_stump(spark, sf_dir):
    """Low bars: the driver's events are independent of each other. Tests have a planted case at the bars that are the default."""
    found = conditional.numeric_stump(_samples(spark, sf_dir, ["sensor"]), 0.2, 0.5)
    return found.select("entity_id", "state", "signal", "direction", "cut", *[F.round(c, 9).alias(c) for c in ("coverage", "lift", "strength")])


@query(STUMP + """, cv AS (SELECT entity_id, state, signal, 'is ' || value AS test, coverage, coverage / baseline AS lift FROM cs),
    al_ AS (SELECT entity_id, state, signal, test, coverage * least(lift / 2, 1.0) AS strength, 1 AS place FROM cv WHERE coverage >= 0.2 AND lift >= 0.5
        UNION ALL SELECT entity_id, state, signal, direction, strength, 0 FROM ns)
    SELECT entity_id, state, row_number() OVER (PARTITION BY entity_id, state ORDER BY strength DESC, place, signal) AS rank, signal, test, round(strength, 9) AS strength FROM al_ QUALIFY row_number() OVER (PARTITION BY entity_id, state ORDER BY strength DESC, place, signal) <= 2""")
def condition_candidates(spark, sf_dir):
    """The two strongest of all signals of each action kind, with the bars of numeric_stump; of a number's test the direction."""
    samples = _samples(spark, sf_dir, ["sensor", "person"])
    kinds = entity_ids(spark, sf_dir).filter(F.col("domain").isin("sensor", "person")).select(F.col("entity_id").alias("signal"), (F.col("domain") == "sensor").alias("numeric"))
    found = conditional.conditions(samples, kinds, kinds.select("signal", F.when(F.col("numeric"), 0).otherwise(1).alias("place")), coverage=0.2, lift=0.5)
    test = F.when(F.col("test").startswith("is "), F.col("test")).otherwise(F.split_part("test", F.lit(" "), F.lit(1)))
    return found.select("entity_id", "state", "rank", "signal", test.alias("test"), F.round("strength", 9).alias("strength"))


# --- crossings and prices --------------------------------------------------------------------------------------------

CROSS = """, sp AS (SELECT entity_id, us, num, row_number() OVER (PARTITION BY entity_id ORDER BY num) - 1 AS rk, count(*) OVER (PARTITION BY entity_id) AS n, lag(num) OVER (PARTITION BY entity_id ORDER BY us, sid) AS prev FROM base WHERE num IS NOT NULL),
    th AS (SELECT DISTINCT entity_id, round(num, 1) AS threshold FROM sp WHERE n >= 20 AND rk IN (SELECT n * q // 10 FROM generate_series(1, 9) g(q))),
    cr AS (SELECT entity_id, threshold, CASE WHEN prev >= threshold AND threshold > num THEN 'falling' WHEN prev <= threshold AND threshold < num THEN 'rising' END AS direction, us FROM sp JOIN th USING (entity_id) WHERE prev IS NOT NULL)
"""


@query(CROSS + "SELECT entity_id, threshold, direction, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM cr WHERE direction IS NOT NULL GROUP BY ALL")
def threshold_crossings(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = crossings.crossings(points, crossings.deciles(points))
    return found.groupBy("entity_id", "threshold", "direction").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


SCORES = ACTS + CROSS + """, kd AS (SELECT entity_id || '=' || state AS kind, us, row_number() OVER (PARTITION BY entity_id, state ORDER BY us, sid) AS i FROM acts),
    cl AS (SELECT k.kind, c.entity_id, c.threshold, c.direction, c.free FROM (SELECT DISTINCT kind FROM kd) k, (SELECT entity_id, threshold, direction, list(us ORDER BY us) AS free FROM cr WHERE direction IS NOT NULL GROUP BY ALL) c),
    ml AS (SELECT kind, entity_id, threshold, direction, free, CAST(0 AS BIGINT) AS i, 0 AS hits FROM cl
        UNION ALL SELECT n.kind, n.entity_id, n.threshold, n.direction, CASE WHEN n.hit IS NULL THEN n.free ELSE list_filter(n.free, lambda x: x <> n.hit) END, n.i, n.hits + CASE WHEN n.hit IS NULL THEN 0 ELSE 1 END
        FROM (SELECT m.kind, m.entity_id, m.threshold, m.direction, m.free, k.i, m.hits, list_min(list_filter(m.free, lambda x: x <= k.us AND k.us - x <= 900000000)) AS hit FROM ml m JOIN kd k ON k.kind = m.kind AND k.i = m.i + 1) n),
    sc AS (SELECT c.kind, c.entity_id, c.threshold, c.direction, len(c.free) AS crossings, max(m.i) AS actions, max(m.hits) AS hits FROM cl c JOIN ml m USING (kind, entity_id, threshold, direction) GROUP BY ALL HAVING max(m.hits) > 0)
"""


def _scores(spark, sf_dir):
    points = _points(spark, sf_dir)
    acts = _actions(spark, sf_dir).select(F.concat_ws("=", "entity_id", "state").alias("kind"), "us")
    return crossings.matched(crossings.crossings(points, crossings.deciles(points)), acts, 900 * SECOND)


@query(SCORES + "SELECT kind, entity_id, threshold, direction, crossings, actions, hits FROM sc")
def crossing_scores(spark, sf_dir):
    """Every action kind against the crossings of every sensor; what never meets has no row."""
    return _scores(spark, sf_dir)


@query(SCORES + """SELECT kind, entity_id, threshold, direction, hits, round(hits / actions, 9) AS recall, round(hits / crossings, 9) AS precision FROM sc WHERE actions >= 5 AND hits / actions >= 0.02 AND (hits / crossings) * (hits / actions) >= 0.001
    QUALIFY row_number() OVER (PARTITION BY kind ORDER BY (hits / crossings) * (hits / actions) DESC, entity_id, threshold, direction) = 1""")
def crossing_candidates(spark, sf_dir):
    """Low bars, as the driver's events are independent of each other."""
    found = crossings.best_crossing(_scores(spark, sf_dir), 0.02, 0.001)
    return found.select("kind", "entity_id", "threshold", "direction", "hits", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query("SELECT entity_id, CAST((us // 3600000000) % 24 AS INT) AS hour, round(avg(num), 6) AS level FROM base WHERE num IS NOT NULL GROUP BY ALL")
def hourly_profile(spark, sf_dir):
    return crossings.hourly_profile(_points(spark, sf_dir)).select("entity_id", "hour", F.round("level", 6).alias("level"))


@query("""SELECT a.entity_id, a.hour, round((a.level + b.level) / 2, 6) AS cost FROM (SELECT entity_id, CAST((us // 3600000000) % 24 AS INT) AS hour, avg(num) AS level FROM base WHERE num IS NOT NULL GROUP BY ALL) a
    JOIN (SELECT entity_id, CAST((us // 3600000000) % 24 AS INT) AS hour, avg(num) AS level FROM base WHERE num IS NOT NULL GROUP BY ALL) b ON a.entity_id = b.entity_id AND b.hour = (a.hour + 1) % 24
    QUALIFY count(*) OVER (PARTITION BY a.entity_id) >= 12 AND row_number() OVER (PARTITION BY a.entity_id ORDER BY round((a.level + b.level) / 2, 9), a.hour) = 1""")
def cheapest_block(spark, sf_dir):
    return crossings.cheapest_block(crossings.hourly_profile(_points(spark, sf_dir))).withColumn("cost", F.round("cost", 6))


@query(ACTS + """, pr AS (SELECT entity_id AS signal, num, row_number() OVER (PARTITION BY entity_id ORDER BY num) - 1 AS rk, count(*) OVER (PARTITION BY entity_id) AS n FROM base WHERE num IS NOT NULL), cut AS (SELECT signal, num AS cut FROM pr WHERE rk = n * 2 // 3),
    rn AS (SELECT a.entity_id, a.sig AS signal, CASE WHEN a.us - b.us <= 7200000000 THEN b.num END AS num FROM (SELECT *, 'sensor.t' || right(entity_id, 1) AS sig FROM acts WHERE domain = 'switch' AND state = 'on') a ASOF LEFT JOIN base b ON b.entity_id = a.sig AND a.us >= b.us)
    SELECT entity_id, signal, cut, count(*) AS runs, count(*) FILTER (num >= cut) AS expensive FROM rn JOIN cut USING (signal) WHERE num IS NOT NULL GROUP BY ALL""")
def expensive_share(spark, sf_dir):
    return crossings.expensive_share(_runs(spark, sf_dir), _points(spark, sf_dir))


def _runs(spark, sf_dir):
    """Runs of switches with the price, if it is fresh, of the sensor that bears the switch's number."""
    runs = _actions(spark, sf_dir).filter("domain = 'switch' and state = 'on'").select(F.col("entity_id").alias("device"), "us", F.concat(F.lit("sensor.t"), F.right("entity_id", F.lit(1))).alias("entity_id"))
    return signals.value_at(runs, _points(spark, sf_dir), 2 * HOUR).select(F.col("device").alias("entity_id"), F.col("entity_id").alias("signal"), "us", "num")


@query(ACTS + """, pf AS (SELECT entity_id AS signal, CAST((us // 3600000000) % 24 AS INT) AS hour, avg(num) AS level FROM base WHERE num IS NOT NULL GROUP BY ALL),
    ct AS (SELECT signal, level AS cut FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY level) - 1 AS rk, count(*) OVER (PARTITION BY signal) AS n FROM pf) WHERE rk = n * 2 // 3),
    bl AS (SELECT a.signal, a.hour FROM pf a JOIN pf b ON a.signal = b.signal AND b.hour = (a.hour + 1) % 24 QUALIFY count(*) OVER (PARTITION BY a.signal) >= 12 AND row_number() OVER (PARTITION BY a.signal ORDER BY round((a.level + b.level) / 2, 9), a.hour) = 1),
    rn AS (SELECT a.entity_id, a.sig AS signal, a.us, CASE WHEN a.us - b.us <= 7200000000 THEN b.num END AS num FROM (SELECT *, 'sensor.t' || right(entity_id, 1) AS sig FROM acts WHERE domain = 'switch' AND state = 'on') a ASOF LEFT JOIN base b ON b.entity_id = a.sig AND a.us >= b.us),
    rt AS (SELECT entity_id, signal, count(*) AS runs, count(num) AS rated, count(*) FILTER (num >= cut) AS expensive, CAST(floor(avg((us // 60000000) % 1440)) AS BIGINT) AS minute FROM rn JOIN ct USING (signal) GROUP BY ALL)
    SELECT entity_id, signal, runs, rated, expensive, round(expensive / rated, 9) AS share, minute, hour, round(expensive / rated * least(runs / 10.0, 1.0), 9) AS score FROM rt LEFT JOIN bl USING (signal) WHERE runs >= 4 AND rated > 0 AND expensive / rated >= 0.35""")
def shift_candidates(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = crossings.shift_candidates(_runs(spark, sf_dir), points, crossings.hourly_profile(points))
    return found.select("entity_id", "signal", "runs", "rated", "expensive", F.round("share", 9).alias("share"), "minute", "hour", F.round("score", 9).alias("score"))


@query(""", v AS (SELECT entity_id, us, num, row_number() OVER (PARTITION BY entity_id ORDER BY us, sid) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM base WHERE num IS NOT NULL),
    wi AS (SELECT entity_id, us, i, n, list(num) OVER (PARTITION BY entity_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS x FROM v),
    zn AS MATERIALIZED (SELECT entity_id, us, i, list_transform(x, lambda y: (y - list_avg(x)) / list_stddev_pop(x)) AS z FROM wi WHERE len(x) = 12 AND n >= 48),
    pd AS (SELECT a.entity_id, a.us, a.i, b.i AS j, round(sqrt(greatest(0.0, 24 - 2 * list_dot_product(a.z, b.z))), 6) AS d FROM zn a JOIN zn b ON a.entity_id = b.entity_id AND abs(a.i - b.i) > 3),
    mp AS (SELECT entity_id, us, i, min(d) AS d, arg_min(j, d) AS j FROM pd GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d, i) AS rank FROM mp)
    SELECT entity_id, rank, i, j AS neighbour, round(d, 4) AS distance, us AS start_us FROM rk WHERE rank <= 3""")
def motifs(spark, sf_dir):
    """The three windows of twelve readings of each sensor that come most alike again."""
    points = changes(spark, sf_dir).filter("num is not null").select("entity_id", "us", "sid", "num")
    return motif.motifs(points).withColumn("distance", F.round("distance", 4))


# --- replay ----------------------------------------------------------------------------------------------------------

#: Rules written for the driver's events: a clock rule, a state rule and a numeric rule.
RULES = [
    ("clock", "time", 390, None, None, None, None, "light.z0", "on"),
    ("arrive", "state", None, "person.p1", "home", None, None, "light.z1", "on"),
    ("change", "state", None, "person.p2", None, None, None, "switch.z2", "off"),
    ("high", "numeric", None, "sensor.t0", None, 60.0, None, "light.z0", "on"),
]
RULE_SCHEMA = "rule_id string, kind string, at_minute int, entity_id string, to_state string, above double, below double, target_entity string, target_state string"
RULES_SQL = ACTS + """, rl AS (SELECT * FROM (VALUES ('clock', 'light.z0', 'on'), ('arrive', 'light.z1', 'on'), ('change', 'switch.z2', 'off'), ('high', 'light.z0', 'on')) v(rule_id, te, ts_)),
    w AS (SELECT min(us) AS a, max(us) AS b FROM base),
    hist AS (SELECT *, lag(state) OVER (PARTITION BY entity_id ORDER BY us, sid) AS pv, lag(num) OVER (PARTITION BY entity_id ORDER BY us, sid) AS pn, row_number() OVER (PARTITION BY entity_id ORDER BY us, sid) AS rn FROM base),
    fr AS (SELECT 'clock' AS rule_id, d * 86400000000 + 23400000000 AS us, 'time' AS kind FROM (SELECT unnest(generate_series(a // 86400000000, b // 86400000000)) AS d, a, b FROM w) WHERE d * 86400000000 + 23400000000 BETWEEN a AND b
        UNION ALL SELECT 'arrive', us, 'state' FROM hist WHERE entity_id = 'person.p1' AND state = 'home' AND pv IS DISTINCT FROM 'home'
        UNION ALL SELECT 'change', us, 'state' FROM hist WHERE entity_id = 'person.p2' AND pv <> state
        UNION ALL SELECT 'high', us, 'numeric' FROM hist WHERE entity_id = 'sensor.t0' AND rn > 1 AND num > 60 AND NOT pn > 60),
    tr AS (SELECT rule_id, us, sid FROM acts JOIN rl ON te = entity_id AND ts_ = state)
"""


def _rules(spark):
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def _fires(spark, sf_dir):
    return replay.all_fires(_rules(spark), _points(spark, sf_dir), *_bounds(spark, sf_dir))


@query(RULES_SQL + "SELECT rule_id, us, kind FROM fr")
def rule_fires(spark, sf_dir):
    return _fires(spark, sf_dir)


@query(RULES_SQL + "SELECT rule_id, us, kind FROM fr WHERE (us // 86400000000 + 3) % 7 <= 4 AND ((us // 60000000) % 1440 >= 1320 OR (us // 60000000) % 1440 <= 420)")
def condition_filter(spark, sf_dir):
    """Weekdays from 22:00 around midnight to 07:00."""
    return _fires(spark, sf_dir).filter(replay.time_condition(1320, 420, [0, 1, 2, 3, 4]))


def _collapsed(us: int) -> str:
    return COLLAPSE.replace("3600000000", str(us))


COLLAPSE = """, od AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY us) AS i FROM fr),
    bc AS (SELECT rule_id, us, kind, i, us AS last, true AS keep FROM od WHERE i = 1
        UNION ALL SELECT o.rule_id, o.us, o.kind, o.i, CASE WHEN o.us - b.last > 3600000000 THEN o.us ELSE b.last END, o.us - b.last > 3600000000 FROM bc b JOIN od o ON o.rule_id = b.rule_id AND o.i = b.i + 1)
"""


@query(RULES_SQL + COLLAPSE + "SELECT rule_id, us, kind FROM bc WHERE keep")
def burst_collapse(spark, sf_dir):
    """An hour instead of a minute, as the driver's events are sparse."""
    return replay.collapse(materialise(_fires(spark, sf_dir), "fires"), HOUR)


@query(RULES_SQL + "SELECT rule_id, us, sid FROM tr")
def ground_truth(spark, sf_dir):
    return replay.ground_truth(_rules(spark), _actions(spark, sf_dir))


#: The parts of the window by which rules are judged, and for each the collapsed fires and the truth that is left after each fire.
MATCH = """, sp_ AS (SELECT a, b, b - CAST(floor((b - a) * 0.25) AS BIGINT) AS raw FROM w),
    sn AS (SELECT a, b, raw, least(greatest((raw + 43200000000) // 86400000000 * 86400000000, a), b) AS snap FROM sp_),
    se_ AS (SELECT a, b, CASE WHEN (snap - a) / 86400000000 >= 14 AND (b - snap) / 86400000000 >= 7 THEN snap ELSE raw END AS cut FROM sn),
    sg AS (SELECT 'full' AS seg, a AS low, b AS high, b + 1 AS below FROM se_ UNION ALL SELECT 'train', a, cut, cut FROM se_ UNION ALL SELECT 'holdout', cut, b, b + 1 FROM se_),
    od AS (SELECT seg, rule_id, us, kind, row_number() OVER (PARTITION BY seg, rule_id ORDER BY us) AS i FROM fr JOIN sg ON us BETWEEN low AND high),
    bc AS (SELECT seg, rule_id, us, kind, i, us AS last, true AS keep FROM od WHERE i = 1
        UNION ALL SELECT o.seg, o.rule_id, o.us, o.kind, o.i, CASE WHEN o.us - b.last > 60000000 THEN o.us ELSE b.last END, o.us - b.last > 60000000 FROM bc b JOIN od o ON o.seg = b.seg AND o.rule_id = b.rule_id AND o.i = b.i + 1),
    nf AS (SELECT seg, rule_id, us, CASE kind WHEN 'time' THEN 900000000 ELSE 300000000 END AS tol, row_number() OVER (PARTITION BY seg, rule_id ORDER BY us) AS i FROM bc WHERE keep),
    tl AS (SELECT seg, rule_id, coalesce(list(us ORDER BY us) FILTER (us IS NOT NULL), []) AS free FROM (SELECT seg, rl.rule_id, tr.us FROM sg CROSS JOIN rl LEFT JOIN tr ON tr.rule_id = rl.rule_id AND tr.us >= low AND tr.us < below) GROUP BY ALL),
    mt AS (SELECT seg, rule_id, CAST(0 AS BIGINT) AS i, free, CAST(NULL AS BIGINT) AS us, CAST(NULL AS VARCHAR) AS what FROM tl
        UNION ALL SELECT n.seg, n.rule_id, n.i, CASE WHEN n.hit IS NULL THEN n.free ELSE list_filter(n.free, lambda x: x <> n.hit) END, n.us, CASE WHEN n.hit IS NULL THEN 'false' ELSE 'true' END
        FROM (SELECT f.seg, f.rule_id, f.i, f.us, m.free, list_min(list_transform(list_filter(m.free, lambda x: abs(x - f.us) <= f.tol), lambda x: {'d': abs(x - f.us), 'u': x})).u AS hit FROM mt m JOIN nf f ON f.seg = m.seg AND f.rule_id = m.rule_id AND f.i = m.i + 1) n),
    ct AS (SELECT seg, rule_id, count(*) FILTER (what = 'true') AS true_fires, count(*) FILTER (what = 'false') AS false_fires, len(arg_max(free, i)) AS missed FROM mt GROUP BY ALL)
"""


def _kept(spark, sf_dir):
    return materialise(replay.collapse(materialise(_fires(spark, sf_dir), "fires")), "kept-fires")


def _matched(spark, sf_dir):
    return replay.match(_kept(spark, sf_dir), replay.ground_truth(_rules(spark), _actions(spark, sf_dir)), 900 * SECOND)


@query(RULES_SQL + MATCH + "SELECT rule_id, true_fires, false_fires, missed FROM ct WHERE seg = 'full'")
def backtest_match(spark, sf_dir):
    return replay.counts(_matched(spark, sf_dir))


#: Lower bars than the default ones, which no rule reaches on events that are independent of each other; the services stand for the rules' targets.
BARS = replay.Bars(min_true=2, precision=0.005, recall=0.02, false_week=200.0, nuisance=5)
JUDGED = """, os AS (SELECT entity_id AS te, us AS at FROM ov),
    nu AS (SELECT m.seg, m.rule_id, count(DISTINCT m.us) AS nuisance FROM mt m JOIN rl USING (rule_id) JOIN os ON os.te = rl.te AND os.at - m.us BETWEEN 0 AND 480000000 WHERE what = 'false' GROUP BY ALL),
    bu_ AS (SELECT seg, rule_id, count(*) FILTER (NOT keep) AS bursts FROM bc GROUP BY ALL),
    jd AS (SELECT ct.*, (high - low) / 86400000000 AS days, coalesce(bursts, 0) AS bursts, coalesce(nuisance, 0) AS nuisance, (high - low) / (SELECT b - a FROM w) AS scale FROM ct JOIN sg USING (seg) LEFT JOIN bu_ USING (seg, rule_id) LEFT JOIN nu USING (seg, rule_id)),
    jg AS (SELECT *, CASE WHEN true_fires + false_fires > 0 THEN true_fires / (true_fires + false_fires) END AS p, CASE WHEN true_fires + missed > 0 THEN true_fires / (true_fires + missed) END AS r, false_fires * 7.0 / greatest(days, 0.01) AS fw, CASE WHEN scale = 1 THEN 2 ELSE greatest(2, ceil(2 * scale)) END AS floor_ FROM jd),
    jr AS (SELECT *, CASE WHEN true_fires + false_fires + missed = 0 THEN 'nothing to judge' ELSE array_to_string(list_filter([CASE WHEN p IS NULL THEN 'never fired' END, CASE WHEN p IS NOT NULL AND true_fires < floor_ THEN 'few' END, CASE WHEN p < 0.005 THEN 'precision' END,
        CASE WHEN p IS NOT NULL AND r < 0.02 THEN 'recall' END, CASE WHEN fw > 200 THEN 'noisy' END, CASE WHEN bursts > 3 * greatest(true_fires + false_fires, 1) THEN 'bursts' END, CASE WHEN nuisance > 5 THEN 'nuisance' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM jg)
"""


def _judged(spark, sf_dir):
    rules = dimensions.service_for(_rules(spark).select("rule_id", "target_entity", F.split_part("target_entity", F.lit("."), F.lit(1)).alias("domain"), F.col("target_state").alias("state"))).select("rule_id", "target_entity", "service")
    truth = replay.ground_truth(_rules(spark), _actions(spark, sf_dir))
    return replay.backtest(rules, _fires(spark, sf_dir), truth, _overrides(spark, sf_dir).select("entity_id", "us"), *_bounds(spark, sf_dir), BARS)


@query(OVERRIDES + RULES_SQL + MATCH + JUDGED + "SELECT rule_id, seg, true_fires, false_fires, missed, bursts, nuisance, round(p, 9) AS precision, round(r, 9) AS recall, round(fw, 6) AS false_week, reasons, reasons = '' AS passed FROM jr")
def backtest_gates(spark, sf_dir):
    rated = _judged(spark, sf_dir)
    return rated.select("rule_id", "seg", "true_fires", "false_fires", "missed", "bursts", "nuisance", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("false_week", 6).alias("false_week"), "reasons", "passed")


VERDICTS = JUDGED + """, vd AS (SELECT f.rule_id, f.true_fires, h.true_fires AS late_true, f.p AS precision,
        CASE WHEN (SELECT NOT ((cut - a) / 86400000000 >= 14 AND (b - cut) / 86400000000 >= 7) FROM se_) THEN 'insufficient_history' WHEN h.true_fires + h.missed = 0 AND h.true_fires + h.false_fires = 0 THEN 'no_activity_in_holdout'
             WHEN h.true_fires + h.missed = 0 THEN 'behaviour_absent_in_holdout' ELSE 'evaluated' END AS reason, f.reasons = '' AS ok, h.reasons = '' AS late_ok
        FROM jr f JOIN jr h ON f.rule_id = h.rule_id AND f.seg = 'full' AND h.seg = 'holdout'),
    vp AS (SELECT *, CASE WHEN reason IN ('evaluated', 'behaviour_absent_in_holdout') THEN 'holdout' ELSE 'in_sample' END AS validation,
        CASE reason WHEN 'behaviour_absent_in_holdout' THEN false WHEN 'evaluated' THEN ok AND late_ok ELSE ok END AS passed FROM vd)
"""


@query(OVERRIDES + RULES_SQL + MATCH + VERDICTS + "SELECT rule_id, true_fires, late_true, validation, reason, passed, round(precision, 9) AS precision FROM vp")
def holdout_verdicts(spark, sf_dir):
    return replay.verdicts(_judged(spark, sf_dir), *_bounds(spark, sf_dir), BARS).withColumn("precision", F.round("precision", 9))


@query(OVERRIDES + RULES_SQL + MATCH + VERDICTS + "SELECT rule_id, passed, round(CASE WHEN passed AND precision IS NOT NULL THEN (0.5 + precision) / 2 ELSE 0.5 END, 9) AS score FROM vp")
def backtest_scores(spark, sf_dir):
    decided = replay.verdicts(_judged(spark, sf_dir), *_bounds(spark, sf_dir), BARS)
    return replay.settle(_rules(spark).select("rule_id", F.lit(0.5).alias("score")), decided).select("rule_id", "passed", F.round("score", 9).alias("score"))


CONDITIONS = [("clock", "time", None, None, None, None, 360, 420, [0, 1, 2, 3, 4]), ("arrive", "state", "switch.z1", "ON", None, None, None, None, None), ("change", "numeric", "sensor.t2", None, 40.0, None, None, None, None), ("high", "time", None, None, None, None, 1320, 420, None)]
CONDITION_SCHEMA = "rule_id string, kind string, entity_id string, state string, above double, below double, after_minute int, before_minute int, weekdays array<int>"


@query(RULES_SQL + """, rd AS (SELECT f.*, m.state AS st, m.num AS nu_, f.us - m.us AS age FROM (SELECT *, CASE rule_id WHEN 'arrive' THEN 'switch.z1' ELSE 'sensor.t2' END AS sig, (us // 60000000) % 1440 AS mi, (us // 86400000000 + 3) % 7 AS wd FROM fr) f ASOF LEFT JOIN base m ON m.entity_id = f.sig AND f.us >= m.us)
    SELECT rule_id, us, kind FROM rd WHERE CASE rule_id WHEN 'clock' THEN mi BETWEEN 360 AND 420 AND wd <= 4 WHEN 'arrive' THEN coalesce(age <= 21600000000 AND lower(st) = 'on', false) WHEN 'change' THEN coalesce(age <= 21600000000 AND nu_ > 40, false) ELSE mi >= 1320 OR mi <= 420 END""")
def conditions_hold(spark, sf_dir):
    """A time window, a state and a number, each read at the time of the fire."""
    return replay.conditions_hold(_fires(spark, sf_dir), spark.createDataFrame(CONDITIONS, CONDITION_SCHEMA), _points(spark, sf_dir))


@query(RULES_SQL + MATCH + "SELECT rule_id, us, what = 'true' AS matched FROM mt WHERE seg = 'full' AND i > 0 AND us > 1706000000000000")
def shadow_fires(spark, sf_dir):
    """Each fire since a time, with whether someone did what the rule would have done."""
    return _matched(spark, sf_dir).filter("what <> 'missed' and us > 1706000000000000").select("rule_id", "us", (F.col("what") == "true").alias("matched"))


# --- conflicts -------------------------------------------------------------------------------------------------------

#: Rules for the conflict checks, made of what people do: each kind of action with a trigger entity and, in a second row, the minute of its
#: earliest time; and for each switch a rule that sets both states. Every fifth count makes a disabled rule.
LINKED = ACTS + """, kd AS (SELECT entity_id, domain, state, right(entity_id, 1) AS d, count(*) AS n, CAST(min(minute) AS INT) AS m FROM acts GROUP BY ALL),
    kt AS (SELECT *, entity_id || '=' || state AS rule_id, n % 5 <> 0 AS enabled, CASE WHEN domain = 'light' THEN 'switch.z' || d WHEN domain = 'media_player' THEN 'light.z' || d WHEN state = 'on' THEN 'person.p' || d ELSE 'light.z' || ((CAST(d AS INT) + 1) % 2) END AS trig FROM kd),
    r AS (SELECT rule_id, enabled, trig AS trigger_entity, CAST(NULL AS INT) AS trigger_minute, entity_id AS target_entity, state AS target_state FROM kt
        UNION ALL SELECT rule_id, enabled, NULL, m, entity_id, state FROM kt
        UNION ALL SELECT 'both ' || entity_id, true, 'person.p' || d, NULL, entity_id, state FROM kt WHERE domain = 'switch'),
    dv AS (SELECT DISTINCT entity_id, 'd' || right(entity_id, 1) AS device_id FROM base WHERE domain IN ('light', 'switch')),
    p AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, a.target_entity AS ea, b.target_entity AS eb, a.target_state AS sa, b.target_state AS sb, a.enabled AND b.enabled AS live FROM r a JOIN r b ON a.rule_id < b.rule_id
        WHERE a.trigger_entity = b.trigger_entity OR least(abs(a.trigger_minute - b.trigger_minute), 1440 - abs(a.trigger_minute - b.trigger_minute)) <= 45),
    ck AS (SELECT rule_id, bool_or(trigger_minute IS NOT NULL) AS clock FROM r GROUP BY rule_id),
    ti_ AS (SELECT DISTINCT a.rule_id AS rule_a, b.rule_id AS rule_b, a.target_entity AS e FROM r a JOIN r b ON a.rule_id < b.rule_id AND a.target_entity = b.target_entity AND a.target_state <> b.target_state AND a.enabled AND b.enabled
        JOIN ck x ON x.rule_id = a.rule_id JOIN ck y ON y.rule_id = b.rule_id
        WHERE a.trigger_entity = b.trigger_entity OR NOT (x.clock AND y.clock) OR least(abs(a.trigger_minute - b.trigger_minute), 1440 - abs(a.trigger_minute - b.trigger_minute)) <= 45),
    cp AS (SELECT 'inconsistent' AS kind, rule_a, rule_b, e AS detail FROM ti_ UNION ALL SELECT DISTINCT 'redundant', rule_a, rule_b, ea FROM p WHERE ea = eb AND sa = sb),
    sc AS (SELECT rule_id, target_entity AS entity_id FROM r GROUP BY ALL HAVING count(DISTINCT target_state) > 1),
    st AS (SELECT DISTINCT x.rule_id AS a, y.rule_id AS b FROM r x JOIN r y ON x.target_entity = y.trigger_entity WHERE x.enabled AND y.enabled),
    lp AS (SELECT a AS start, b AS cur, [a, b] AS path FROM st UNION ALL SELECT start, st.b, list_append(path, st.b) FROM lp JOIN st ON lp.cur = st.a WHERE start <> cur AND len(path) < 5 AND (st.b = start OR NOT list_contains(path, st.b))),
    lo AS (SELECT start AS rule_id, array_to_string(path, '>') AS way FROM lp WHERE start = cur QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(path), path) = 1),
    ra AS (SELECT DISTINCT rule_a, rule_b, x.device_id FROM p JOIN dv x ON x.entity_id = ea JOIN dv y ON y.entity_id = eb AND x.device_id = y.device_id WHERE live AND ea <> eb)
"""


def _kinds(spark, sf_dir):
    digit = F.right("entity_id", F.lit(1))
    kinds = _actions(spark, sf_dir).groupBy("entity_id", "domain", "state").agg(F.count(F.lit(1)).alias("n"), F.min("minute").alias("m")).withColumn("d", digit)
    by = F.when(F.col("domain") == "light", F.concat(F.lit("switch.z"), "d")).when(F.col("domain") == "media_player", F.concat(F.lit("light.z"), "d")).when(F.col("state") == "on", F.concat(F.lit("person.p"), "d"))
    trigger = by.otherwise(F.concat(F.lit("light.z"), ((F.col("d").cast("int") + 1) % 2).cast("string")))
    return kinds.select("*", F.concat_ws("=", "entity_id", "state").alias("rule_id"), (F.col("n") % 5 != 0).alias("enabled"), trigger.alias("trigger_entity"))


def _linked(spark, sf_dir):
    kinds = _kinds(spark, sf_dir)
    row = lambda rule, enabled, entity, minute: kinds.select(rule.alias("rule_id"), enabled.alias("enabled"), entity.alias("trigger_entity"), minute.cast("int").alias("trigger_minute"), F.col("entity_id").alias("target_entity"), F.col("state").alias("target_state"), "domain")
    none = F.lit(None)
    by_entity = row(F.col("rule_id"), F.col("enabled"), F.col("trigger_entity"), none)
    by_time = row(F.col("rule_id"), F.col("enabled"), none.cast("string"), F.col("m"))
    both = row(F.concat(F.lit("both "), "entity_id"), F.lit(True), F.concat(F.lit("person.p"), "d"), none).filter("domain = 'switch'")
    return by_entity.unionByName(by_time).unionByName(both).drop("domain")


def _devices(spark, sf_dir):
    return entity_ids(spark, sf_dir).filter("domain in ('light', 'switch')").select("entity_id", F.concat(F.lit("d"), F.right("entity_id", F.lit(1))).alias("device_id"))


@query(LINKED + "SELECT kind, rule_a, rule_b, detail AS entity_id FROM cp")
def conflict_pairs(spark, sf_dir):
    rules = _linked(spark, sf_dir)
    return conflicts.inconsistent(rules).unionByName(conflicts.redundant(rules))


@query(LINKED + "SELECT rule_id, entity_id FROM sc")
def self_conflicts(spark, sf_dir):
    return conflicts.self_conflicts(_linked(spark, sf_dir))


@query(LINKED + "SELECT rule_id, way FROM lo")
def loop_paths(spark, sf_dir):
    return conflicts.loops(_linked(spark, sf_dir))


@query(LINKED + "SELECT rule_a, rule_b, device_id FROM ra")
def device_races(spark, sf_dir):
    return conflicts.device_races(_linked(spark, sf_dir), _devices(spark, sf_dir))


@query(LINKED + """SELECT *, CASE kind WHEN 'race' THEN 2 WHEN 'redundant' THEN 2 WHEN 'unresolved' THEN 2 ELSE 3 END AS severity FROM (SELECT kind, rule_a, rule_b, detail FROM cp
    UNION ALL SELECT 'race', rule_a, rule_b, device_id FROM ra UNION ALL SELECT 'self', rule_id, rule_id, entity_id FROM sc UNION ALL SELECT 'loop', rule_id, rule_id, way FROM lo
    UNION ALL SELECT DISTINCT 'unresolved', 'area ' || domain, 'area ' || domain, NULL FROM base WHERE domain = 'sensor')""")
def conflict_check(spark, sf_dir):
    """The rules of people's actions, and one that acts on an area that has no entity."""
    return conflicts.check(_linked(spark, sf_dir), _devices(spark, sf_dir), expanded=expanded_targets(spark, sf_dir))


@query(LINKED + """, bl AS (SELECT rule_a, rule_b FROM cp WHERE kind = 'inconsistent' UNION ALL SELECT rule_id, rule_id FROM sc UNION ALL SELECT rule_id, rule_id FROM lo) SELECT DISTINCT unnest([rule_a, rule_b]) AS rule_id FROM bl""")
def blocked_rules(spark, sf_dir):
    return conflicts.blocked(conflict_check(spark, sf_dir))


#: Conditions for the same rules, as JSON: the bands of sensors by day, the hours of human actions by entity and weekday, and states.
FACTS_SQL = ACTS + """, cj AS (SELECT 'band ' || entity_id || ' ' || day AS rule_id, 'numeric' AS kind, entity_id, CAST(NULL AS VARCHAR) AS st, min(num) AS above, min(num) + 20 AS below, CAST(NULL AS INT) AS after, CAST(NULL AS INT) AS before, CAST(NULL AS INT) AS wd FROM ann WHERE num IS NOT NULL GROUP BY entity_id, day
        UNION ALL SELECT 'hours ' || entity_id || ' ' || wd, 'time', NULL, NULL, NULL, NULL, CAST(min(minute) AS INT), CAST(max(minute) AS INT) // 2, wd FROM acts GROUP BY entity_id, wd
        UNION ALL SELECT DISTINCT 'state ' || entity_id || '=' || state, 'state', entity_id, state, NULL, NULL, NULL, NULL, NULL FROM acts),
    sp2 AS MATERIALIZED (SELECT *, coalesce(entity_id, '') AS ek, after AS a1, CASE WHEN after <= before THEN before ELSE 1439 END AS b1, CASE WHEN after > before THEN before END AS b2 FROM cj)
"""


def _conditions(spark, sf_dir):
    num = annotated(spark, sf_dir).filter("num is not null").groupBy("entity_id", model.day(F.col("us")).alias("day")).agg(F.min("num").alias("above"))
    bands = num.select(F.concat_ws(" ", F.lit("band"), "entity_id", F.col("day").cast("string")).alias("rule_id"), F.to_json(F.struct(F.lit("numeric_state").alias("condition"), "entity_id", "above", (F.col("above") + 20).alias("below"))).alias("condition"))
    acts = _actions(spark, sf_dir)
    clock = lambda m: F.format_string("%02d:%02d:00", F.floor(m / 60), m % 60)
    names = F.array(*map(F.lit, conditions.WEEKDAYS))
    hours = acts.groupBy("entity_id", "wd").agg(F.min("minute").alias("after"), F.floor(F.max("minute") / 2).cast("int").alias("before"))
    hours = hours.select(F.concat_ws(" ", F.lit("hours"), "entity_id", F.col("wd").cast("string")).alias("rule_id"), F.to_json(F.struct(F.lit("time").alias("condition"), clock(F.col("after")).alias("after"), clock(F.col("before")).alias("before"), F.array(F.get(names, F.col("wd"))).alias("weekday"))).alias("condition"))
    states = acts.select("entity_id", "state").distinct().select(F.concat(F.lit("state "), F.concat_ws("=", "entity_id", "state")).alias("rule_id"), F.to_json(F.struct(F.lit("state").alias("condition"), F.array("entity_id").alias("entity_id"), F.upper("state").alias("state"))).alias("condition"))
    return bands.unionByName(hours).unionByName(states)


@query(FACTS_SQL + "SELECT rule_id, kind, entity_id, st AS states, round(above, 6) AS above, round(below, 6) AS below, after, before, ['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'][wd + 1] AS weekdays FROM cj")
def condition_facts(spark, sf_dir):
    told = conditions.facts(_conditions(spark, sf_dir))
    return told.select("rule_id", "kind", "entity_id", F.array_join("states", "|").alias("states"), F.round("above", 6).alias("above"), F.round("below", 6).alias("below"), "after", "before", F.array_join("weekdays", "|").alias("weekdays"))


@query(FACTS_SQL + """SELECT a.rule_id AS rule_a, b.rule_id AS rule_b FROM sp2 a JOIN sp2 b ON a.kind = b.kind AND a.ek = b.ek AND a.rule_id < b.rule_id
    WHERE CASE a.kind WHEN 'state' THEN a.st <> b.st WHEN 'numeric' THEN a.below <= b.above OR b.below <= a.above
        ELSE a.wd <> b.wd OR NOT (a.a1 <= b.b1 AND b.a1 <= a.b1 OR coalesce(a.a1 <= b.b2, false) OR coalesce(b.a1 <= a.b2, false) OR (a.b2 IS NOT NULL AND b.b2 IS NOT NULL)) END""")
def exclusive_conditions(spark, sf_dir):
    return conditions.exclusive(materialise(conditions.facts(_conditions(spark, sf_dir)), "facts"))


@query(LINKED + """, sg_ AS (SELECT rule_id, n % 3 AS s FROM kt), mu AS (SELECT DISTINCT x.rule_id AS rule_a, y.rule_id AS rule_b, x.target_entity AS entity_id FROM r x JOIN r y ON x.target_entity = y.trigger_entity AND x.rule_id <> y.rule_id)
    SELECT DISTINCT CASE WHEN sa <> sb THEN 'inconsistent' ELSE 'redundant' END AS kind, rule_a, rule_b, ea AS entity_id, CASE WHEN sa = sb THEN 'info' WHEN x.s IS DISTINCT FROM y.s THEN 'warning' ELSE 'error' END AS severity
        FROM p LEFT JOIN sg_ x ON x.rule_id = rule_a LEFT JOIN sg_ y ON y.rule_id = rule_b WHERE ea = eb AND live
    UNION ALL SELECT 'loop', rule_a, rule_b, entity_id, 'error' FROM mu WHERE (rule_b, rule_a) IN (SELECT (rule_a, rule_b) FROM mu)""")
def rule_audit(spark, sf_dir):
    signatures = _kinds(spark, sf_dir).select("rule_id", (F.col("n") % 3).cast("string").alias("signature"))
    return conflicts.audit(_linked(spark, sf_dir), signatures)


@query("""SELECT DISTINCT 'whole ' || right(entity_id, 1) AS rule_id, entity_id AS target_entity, 'off' AS target_state, true AS resolved FROM base WHERE domain IN ('light', 'switch')
    UNION ALL SELECT DISTINCT 'area ' || domain, NULL, 'on', false FROM base WHERE domain = 'sensor'""")
def expanded_targets(spark, sf_dir):
    """A rule for each device, and one for an area that has no entity."""
    held = _devices(spark, sf_dir).withColumn("area_id", F.lit(None).cast("string"))
    devices = held.select(F.concat(F.lit("whole "), F.right("device_id", F.lit(1))).alias("rule_id"), F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("area_id"), "device_id", F.lit("off").alias("state")).distinct()
    area = entity_ids(spark, sf_dir).filter("domain = 'sensor'").select(F.concat(F.lit("area "), "domain").alias("rule_id"), F.lit(None).cast("string").alias("entity_id"), F.col("domain").alias("area_id"), F.lit(None).cast("string").alias("device_id"), F.lit("on").alias("state")).distinct()
    return conflicts.expand(devices.unionByName(area), held)


#: The rules of LINKED as raw automations: an action of each kind two branches deep, a scene in the default branch, and a notice to the trigger.
def _raw_automations(spark, sf_dir):
    kinds = _kinds(spark, sf_dir).filter("state in ('on', 'off')")
    text = """concat('{"id":"', rule_id, '","trigger":[{"platform":"state","entity_id":"', trigger_entity, '"},{"platform":"time","at":"', printf('%02d:%02d', int(m div 60), int(m % 60)), '"}],"action":[{"choose":[{"conditions":[],"sequence":[{"if":[],"then":[{"service":"', domain, '.turn_', state,
        '","target":{"entity_id":["', entity_id, '"]}}]}]}],"default":[{"scene":"scene.d', d, '"}]},{"repeat":{"count":', n, ',"sequence":{"action":"notify.send","data":{"entity_id":"', trigger_entity, '"}}}}]}')"""
    return kinds.select(F.col("rule_id").alias("key"), F.expr(text).alias("automation"), F.lit("events").alias("source"))


@query(LINKED + """SELECT rule_id AS key, domain || '.turn_' || state AS service, entity_id, state AS target_state, '0.0.0' AS path FROM kt WHERE state IN ('on', 'off')
    UNION ALL SELECT rule_id, 'scene.turn_on', 'scene.d' || d, NULL, '0.1' FROM kt WHERE state IN ('on', 'off')
    UNION ALL SELECT rule_id, 'notify.send', trig, NULL, '1.0' FROM kt WHERE state IN ('on', 'off')""")
def automation_actions(spark, sf_dir):
    """Every service call of raw automations with its place among the nested steps."""
    called = automations.actions(_raw_automations(spark, sf_dir))
    return called.select("key", "service", F.explode("entity_ids").alias("entity_id"), "target_state", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query(LINKED + """SELECT rule_id AS key, rule_id AS alias, trig AS trigger_entities, printf('%02d:%02d', m // 60, m % 60) AS trigger_times, 'state,time' AS trigger_kinds FROM kt WHERE state IN ('on', 'off')""")
def automation_triggers(spark, sf_dir):
    told = automations.normalise(_raw_automations(spark, sf_dir))
    return told.select("key", "alias", *[F.array_join(c, ",").alias(c) for c in ("trigger_entities", "trigger_times", "trigger_kinds")])


# --- activity and tokens ---------------------------------------------------------------------------------------------


@query("""SELECT domain, bin, CAST(sum(coalesce(edge, 0)) OVER (PARTITION BY domain ORDER BY bin) AS BIGINT) AS active FROM
    (SELECT domain, unnest(generate_series(0, (b - a) // 900000000)) AS bin FROM (SELECT DISTINCT domain FROM base), (SELECT min(us) AS a, max(us) AS b FROM base)) LEFT JOIN
    (SELECT domain, greatest((us - a) // 900000000, 0) AS bin, sum(edge) AS edge FROM (SELECT *, ac - coalesce(lag(ac) OVER (PARTITION BY entity_id ORDER BY us, sid), 0) AS edge FROM
        (SELECT *, CASE WHEN state IN ('off', 'not_home') THEN 0 ELSE 1 END AS ac FROM base)), (SELECT min(us) AS a FROM base) WHERE edge <> 0 GROUP BY ALL) USING (domain, bin)""")
def activity_bins(spark, sf_dir):
    """The whole history in quarters of an hour."""
    start, end = _bounds(spark, sf_dir)
    return activity.bins(changes(spark, sf_dir), start, end + 1)


@query("""SELECT domain, bin, CAST(sum(coalesce(edge, 0)) OVER (PARTITION BY domain ORDER BY bin) AS BIGINT) AS active FROM
    (SELECT domain, unnest(generate_series(0, (b - a) // 900000000)) AS bin FROM (SELECT DISTINCT CASE domain WHEN 'person' THEN 'presence' ELSE domain END AS domain FROM base WHERE domain <> 'sensor'), (SELECT min(us) AS a, max(us) AS b FROM base)) LEFT JOIN
    (SELECT CASE domain WHEN 'person' THEN 'presence' ELSE domain END AS domain, greatest((us - a) // 900000000, 0) AS bin, sum(edge) AS edge FROM (SELECT *, ac - coalesce(lag(ac) OVER (PARTITION BY entity_id ORDER BY us, sid), 0) AS edge FROM
        (SELECT *, CASE WHEN state IN ('off', 'not_home') THEN 0 ELSE 1 END AS ac FROM base)), (SELECT min(us) AS a FROM base) WHERE edge <> 0 AND domain <> 'sensor' GROUP BY ALL) USING (domain, bin)""")
def activity_buckets(spark, sf_dir):
    """The same by the buckets that modes are made of."""
    start, end = _bounds(spark, sf_dir)
    return activity.bins(activity.bucketed(changes(spark, sf_dir)), start, end + 1)


TOKENS = """, tk AS (SELECT sid, us, cause, entity_id || '=' || state AS item FROM ann WHERE old_state IS NOT NULL AND old_state <> state AND num IS NULL)
"""


@query(TOKENS + "SELECT item, count(*) AS n FROM tk GROUP BY item ORDER BY n DESC, item LIMIT 20")
def token_vocab(spark, sf_dir):
    return activity.vocabulary(activity.usable(annotated(spark, sf_dir)), 20)


@query(TOKENS + """SELECT sid, coalesce(array_to_string(list(item) OVER (ORDER BY us, sid ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), ','), '') AS before,
    CASE WHEN g < 10000000 THEN 0 WHEN g < 60000000 THEN 1 WHEN g < 600000000 THEN 2 WHEN g < 3600000000 THEN 3 ELSE 4 END AS gap
    FROM (SELECT *, us - lag(us) OVER (ORDER BY us, sid) AS g FROM tk)""")
def token_windows(spark, sf_dir):
    return activity.windows(activity.usable(annotated(spark, sf_dir))).select("sid", F.array_join("before", ",").alias("before"), "gap")


def _services(spark, sf_dir):
    """The items (entity=state) of the events that a service can bring about."""
    known = dimensions.service_for(changes(spark, sf_dir).select("entity_id", "domain", "state").distinct()).filter("service is not null")
    return known.select(F.concat_ws("=", "entity_id", F.lower("state")).alias("item"), "service").distinct()


@query(""", ev AS (SELECT sid, us, cause, entity_id || '=' || lower(state) AS item FROM ann WHERE old_state IS NOT NULL AND old_state <> state AND domain IN ('light', 'media_player', 'switch') AND cause <> 'unknown'),
    vo AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) + 1 AS n FROM ev GROUP BY item QUALIFY n <= 49),
    sl AS (SELECT sid, us, cause, vo.n, coalesce(vo.n, 1) AS num, us - lag(us) OVER (ORDER BY us, sid) AS g FROM ev LEFT JOIN vo USING (item)),
    tm AS (SELECT *, CASE WHEN g IS NULL THEN 8 WHEN g < 60000000 THEN 0 WHEN g < 300000000 THEN 1 WHEN g < 900000000 THEN 2 WHEN g < 3600000000 THEN 3 WHEN g < 14400000000 THEN 4 WHEN g < 43200000000 THEN 5 WHEN g < 86400000000 THEN 6 ELSE 7 END AS tb FROM sl),
    ls AS (SELECT sid, cause, n, list(num) OVER w AS a, list(tb) OVER w AS b FROM tm WINDOW w AS (ORDER BY us, sid ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
    SELECT sid, n - 2 AS label, array_to_string(list_concat(list_transform(range(6 - len(a)), lambda x: 0), a), ',') AS items, array_to_string(list_concat(list_transform(range(6 - len(b)), lambda x: 9), b), ',') AS times
    FROM ls WHERE cause = 'human' AND n IS NOT NULL AND len(a) > 0""")
def sequence_examples(spark, sf_dir):
    """What people did, in numbers, with the six events before it and the times between them."""
    rows = recurrent.events(annotated(spark, sf_dir))
    told = recurrent.examples(rows, recurrent.vocabulary(rows), _services(spark, sf_dir))
    return told.select("sid", "label", F.array_join(F.col("context.item").cast("array<string>"), ",").alias("items"), F.array_join(F.col("context.time").cast("array<string>"), ",").alias("times"))


@query()
def sequence_rules(spark, sf_dir):
    """Rules of the recurrent model at low bars and few steps, as the driver's events are independent of each other; tests have a planted one at the default bars."""
    found = recurrent.mine(annotated(spark, sf_dir), _services(spark, sf_dir), steps=12, occurrences=2, confidence=0.1, probability=0.03)
    name = lambda c: F.concat_ws("=", F.col(f"{c}.entity_id"), F.col(f"{c}.state"))
    return found.select(name("trigger").alias("trigger"), F.array_join(F.transform("conditions", lambda c: F.concat_ws("=", c["entity_id"], c["state"])), ",").alias("conditions"), F.concat_ws("=", "entity_id", "state").alias("action"), "occurrences", "opportunities", F.round("confidence", 9).alias("confidence"), F.round("model_confidence", 3).alias("model_confidence"))


@query()
def home_mode(spark, sf_dir):
    """Modes of the whole history; seeded, checked by planted regimes in tests."""
    return home.modes(activity_buckets(spark, sf_dir))


@query()
def home_mode_summary(spark, sf_dir):
    """What each mode of the history is like: its share, hours and busiest domains."""
    start, _ = _bounds(spark, sf_dir)
    levels = materialise(activity_buckets(spark, sf_dir), "activity-levels")
    decoded = materialise(home.occupied(home.modes(levels)), "modes")
    return home.summaries(decoded, levels, first_minute=start // MINUTE % 1440)


# --- store, health, dimensions, ranking ------------------------------------------------------------------------------

#: Suggestions made of kinds of action: those of the first week are stored, those after it are fresh.
STORED = ACTS + f""", sg0 AS (SELECT entity_id || '=' || state AS id, domain AS miner, count(*) FILTER (us < {START}) AS n0, count(*) FILTER (us >= {START}) AS n1 FROM acts GROUP BY ALL),
    tb AS (SELECT id, miner, n0 / 100.0 AS score, ['new', 'accepted', 'dismissed', 'suppressed'][n0 % 4 + 1] AS status, 1 AS seen_count, 1 AS last_run, n0 FROM sg0 WHERE n0 > 0),
    fs AS (SELECT id, miner, n1 / 100.0 AS score FROM sg0 WHERE n1 > 0 AND n1 % 3 <> 0)
"""


def _suggestions(spark, sf_dir):
    late = F.col("us") >= START
    kinds = _actions(spark, sf_dir).groupBy(F.concat_ws("=", "entity_id", "state").alias("id"), F.col("domain").alias("miner")).agg(F.count_if(~late).alias("n0"), F.count_if(late).alias("n1"))
    status = F.get(F.array(*map(F.lit, ("new", "accepted", "dismissed", "suppressed"))), F.col("n0") % 4)
    stored = kinds.filter("n0 > 0").select("id", "miner", (F.col("n0") / 100.0).alias("score"), status.alias("status"), F.lit(1).alias("seen_count"), F.lit(1).alias("last_run"), "n0")
    return stored, kinds.filter("n1 > 0 and n1 % 3 <> 0").select("id", "miner", (F.col("n1") / 100.0).alias("score"))


@query(STORED + "SELECT id, coalesce(fs.miner, tb.miner) AS miner, coalesce(fs.score, tb.score) AS score, coalesce(status, 'new') AS status, coalesce(seen_count, 0) + CASE WHEN fs.score IS NULL THEN 0 ELSE 1 END AS seen_count, CASE WHEN fs.score IS NULL THEN last_run ELSE 3 END AS last_run FROM tb FULL JOIN fs USING (id)")
def suggestion_upsert(spark, sf_dir):
    stored, fresh = _suggestions(spark, sf_dir)
    return store.upsert(stored.drop("n0"), fresh, 3)


@query(STORED + "SELECT id, score FROM (SELECT *, CASE WHEN n0 % 3 > 0 THEN (n0 % 3) / 3.0 END AS probability FROM tb) ORDER BY probability DESC NULLS LAST, score DESC, id LIMIT 7")
def topk_suggestions(spark, sf_dir):
    stored = _suggestions(spark, sf_dir)[0]
    return store.top(stored.withColumn("probability", F.when(F.col("n0") % 3 > 0, (F.col("n0") % 3) / 3.0)), 7).select("id", "score")


@query(STORED + "SELECT id, CASE WHEN status = 'new' AND p IS NOT NULL THEN 'suppressed' ELSE status END AS status, CASE WHEN status = 'new' THEN p END AS hidden_by FROM (SELECT *, CASE WHEN miner IN ('light', 'switch') THEN miner END AS p FROM tb)")
def suppressed_suggestions(spark, sf_dir):
    """Active preferences against lights and switches, one against media players that is no longer active."""
    stored = _suggestions(spark, sf_dir)[0]
    wishes = stored.select(F.col("miner").alias("pref_id")).distinct().withColumn("active", F.col("pref_id") != "media_player")
    return store.suppress(stored, stored.select("id", F.col("miner").alias("pref_id")), wishes).select("id", "status", "hidden_by")


@query(STORED + "SELECT id, CASE WHEN status = 'suppressed' AND miner = 'switch' THEN 'new' ELSE status END AS status FROM tb")
def unhidden_suggestions(spark, sf_dir):
    stored = _suggestions(spark, sf_dir)[0].withColumn("hidden_by", F.when(F.col("status") == "suppressed", F.col("miner")))
    return store.unhide(stored, stored.filter("miner = 'switch'").select(F.col("miner").alias("pref_id")).distinct()).select("id", "status")


@query(STORED + "SELECT id, coalesce(fs.score, tb.score) AS score FROM tb FULL JOIN fs USING (id)")
def merged_scores(spark, sf_dir):
    stored, fresh = _suggestions(spark, sf_dir)
    return store.merge(stored.select("id", "score"), fresh.select("id", "score"), ["id"])


@query(STORED + "SELECT id, status FROM tb WHERE status NOT IN ('new', 'suppressed')")
def pruned_suggestions(spark, sf_dir):
    return store.prune(_suggestions(spark, sf_dir)[0], 2).select("id", "status")


@query(STORED + "SELECT count(*) AS n, (SELECT array_to_string(list(id ORDER BY id), ',') FROM (SELECT id FROM tb WHERE status = 'new' ORDER BY score DESC, id LIMIT 5)) AS ids FROM tb WHERE status = 'new'")
def announcement(spark, sf_dir):
    return store.first_seen(_suggestions(spark, sf_dir)[0], 1).select("n", F.array_join("ids", ",").alias("ids"))


@query(OVERRIDES + "SELECT entity_id, us, human_state FROM ov")
def override_insert(spark, sf_dir):
    """Insert-or-ignore: storing the overrides a second time changes nothing."""
    found = _overrides(spark, sf_dir).select("entity_id", "us", "human_state")
    return store.insert_ignore(found, found, ["entity_id", "us", "human_state"])


@query(RULES_SQL + MATCH + "SELECT rule_id, count(*) AS fires, count(*) FILTER (what = 'true') AS matched, max(us) AS last_us FROM mt WHERE seg = 'full' AND i > 0 AND us > 1706000000000000 GROUP BY rule_id")
def shadow_report(spark, sf_dir):
    return store.shadow_report(shadow_fires(spark, sf_dir))


#: The replayed rules as applied automations: what was shipped, whether it is there, on and unchanged follows from what each one did.
HEALTH = """, rn_ AS (SELECT * FROM (VALUES ('clock', 'automation.r0', 0), ('arrive', 'automation.r1', 1), ('change', 'automation.r2', 2), ('high', 'automation.r3', 3), ('gone', 'automation.r9', 4)) v(rule_id, entity_id, k)),
    au AS (SELECT origin_entity AS entity_id, count(*) AS n FROM base WHERE origin = 'automation' GROUP BY ALL),
    ap AS (SELECT rn_.*, a + k * 86400000000 AS from_us, b AS to_us, n FROM rn_ LEFT JOIN au USING (entity_id), w),
    fx AS (SELECT ap.*, (to_us - from_us) / 86400000000 AS days, (SELECT count(*) FROM mt WHERE seg = 'full' AND i > 0 AND mt.rule_id = ap.rule_id AND us BETWEEN from_us AND to_us) AS predicted,
        (SELECT count(*) FROM base WHERE origin = 'automation' AND origin_entity = ap.entity_id AND us BETWEEN from_us AND to_us) AS actual, (SELECT count(*) FROM ov WHERE automation = ap.entity_id AND us BETWEEN from_us AND to_us) AS overridden FROM ap)
"""


def _health(spark, sf_dir):
    start, end = _bounds(spark, sf_dir)
    names = spark.createDataFrame([("clock", "automation.r0", 0), ("arrive", "automation.r1", 1), ("change", "automation.r2", 2), ("high", "automation.r3", 3), ("gone", "automation.r9", 4)], "rule_id string, entity_id string, k int")
    rows = changes(spark, sf_dir).filter("origin = 'automation'")
    done = names.join(rows.groupBy(F.col("origin_entity").alias("entity_id")).agg(F.count(F.lit(1)).alias("n")), "entity_id")
    applied = names.select("rule_id", (F.lit(start) + F.col("k").cast("long") * DAY).alias("applied_us"), F.lit("v0").alias("shipped"))
    automations = done.select("rule_id", "entity_id", (F.col("n") % 7 != 0).alias("enabled"), F.when(F.col("n") % 5 == 0, "v1").when(F.col("n") % 5 != 1, "v0").alias("config"))
    fires = _kept(spark, sf_dir).select("rule_id", "us", F.lit(False).alias("error"))
    return health.facts(applied, automations, fires, rows.select(F.col("origin_entity").alias("entity_id"), "us"), _overrides(spark, sf_dir).select("automation", "us"), start, end)


@query(OVERRIDES + RULES_SQL + MATCH + HEALTH + "SELECT rule_id, n IS NOT NULL AS present, coalesce(n % 5 = 0, false) AS edited, coalesce(n % 7 <> 0, false) AS enabled, round(days, 6) AS days, predicted, CASE WHEN n IS NULL THEN 0 ELSE actual END AS actual, CASE WHEN n IS NULL THEN 0 ELSE overridden END AS overridden FROM fx")
def health_facts(spark, sf_dir):
    return _health(spark, sf_dir).select("rule_id", "present", "edited", "enabled", F.round("days", 6).alias("days"), "predicted", "actual", "overridden")


@query(OVERRIDES + RULES_SQL + MATCH + HEALTH + """SELECT rule_id, CASE WHEN n IS NULL THEN 'deleted' WHEN n % 5 = 0 THEN 'edited' WHEN n % 7 = 0 THEN 'disabled' WHEN days < 7 THEN 'insufficient_data' WHEN actual = 0 AND predicted < 3 THEN 'insufficient_data' WHEN actual = 0 THEN 'dormant' WHEN actual < 5 THEN 'insufficient_data'
    WHEN overridden / actual >= 0.6 THEN 'overridden' WHEN overridden / actual >= 0.3 THEN 'noisy' WHEN predicted > 0 AND actual < 0.3 * predicted THEN 'underperforming' ELSE 'healthy' END AS status, round(CASE WHEN n IS NOT NULL AND actual > 0 THEN overridden / actual END, 9) AS override_share FROM fx""")
def health_verdicts(spark, sf_dir):
    return health.verdict(_health(spark, sf_dir)).withColumn("override_share", F.round("override_share", 9))


STALE = """, sa_ AS (SELECT origin_entity AS id, CASE WHEN count(*) % 3 = 0 THEN 'off' ELSE 'on' END AS state, max(us) AS last FROM base WHERE origin IS NOT NULL GROUP BY origin_entity
        UNION ALL SELECT DISTINCT 'automation.' || entity_id, 'on', NULL FROM base WHERE domain = 'person'),
    nw AS (SELECT max(us) AS now FROM base)
"""


@query(STALE + """SELECT id, reason, round(least(0.4 + CASE WHEN reason = 'old' THEN (now - last) / 86400000000 ELSE 0 END / 365, 0.9), 9) AS score FROM
    (SELECT *, CASE WHEN state = 'off' THEN 'off' WHEN last IS NULL THEN 'never' WHEN (now - last) / 86400000000 > 0.02 THEN 'old' END AS reason FROM sa_, nw) WHERE reason IS NOT NULL""")
def stale_automations(spark, sf_dir):
    """Automations and scripts by their last run, half an hour before the end being old; one a person that never ran."""
    rows = changes(spark, sf_dir)
    ran = rows.filter("origin is not null").groupBy(F.col("origin_entity").alias("id")).agg(F.when(F.count(F.lit(1)) % 3 == 0, "off").otherwise("on").alias("state"), F.max("us").alias("last_triggered_us"))
    never = rows.filter("domain = 'person'").select(F.concat(F.lit("automation."), "entity_id").alias("id"), F.lit("on").alias("state"), F.lit(None).cast("long").alias("last_triggered_us")).distinct()
    return health.stale(ran.unionByName(never), _bounds(spark, sf_dir)[1], 0.02).withColumn("score", F.round("score", 9))


#: Names by entity number, as the driver's entities have none.
NAMES = {"sensor": ("Outdoor temp", "Tibber hourly price", "pv_power roof", "Hall lux"), "switch": ("Dishwasher", "Wallbox garage", "Lamp", "pool_pump")}
ROLES = """, en AS (SELECT DISTINCT entity_id, domain, lower(entity_id || ' ' || coalesce(CASE domain """ + " ".join(f"WHEN '{d}' THEN [{', '.join(repr(n) for n in names)}][CAST(right(entity_id, 1) AS INT) + 1]" for d, names in NAMES.items()) + """ END, '')) AS tx FROM base),
    ro AS (SELECT 'person' AS role, entity_id FROM en WHERE domain = 'person' UNION ALL SELECT 'outdoor_temperature', entity_id FROM en WHERE domain = 'sensor' AND tx LIKE '% outdoor%' AND tx LIKE '% temp%'
        UNION ALL SELECT 'energy_price', entity_id FROM en WHERE domain = 'sensor' AND tx LIKE '% tibber%price%' UNION ALL SELECT 'solar_production', entity_id FROM en WHERE domain = 'sensor' AND tx LIKE '% pv_power%'
        UNION ALL SELECT 'illuminance', entity_id FROM en WHERE domain = 'sensor' AND tx LIKE '% lux%' UNION ALL SELECT 'deferrable_loads', entity_id FROM en WHERE domain = 'switch' AND (tx LIKE '% dishwasher%' OR tx LIKE '% pool_pump%')
        UNION ALL SELECT 'ev_charger', entity_id FROM en WHERE domain = 'switch' AND tx LIKE '% wallbox%')
"""


def _named(spark, sf_dir):
    number = F.right("entity_id", F.lit(1)).cast("int")
    name: Column = F.lit(None).cast("string")
    for domain, names in NAMES.items():
        name = F.when(F.col("domain") == domain, F.get(F.array(*map(F.lit, names)), number)).otherwise(name)
    return entity_ids(spark, sf_dir).withColumn("name", name)


@query(ROLES + "SELECT role, entity_id FROM ro")
def signal_roles(spark, sf_dir):
    return dimensions.roles(_named(spark, sf_dir))


@query(ROLES + """, ha AS (SELECT count(*) FILTER (domain IN ('light', 'switch')) AS n FROM ann WHERE cause = 'human' AND old_state IS NOT NULL AND old_state <> state),
    hs AS (SELECT list(DISTINCT role) AS roles FROM ro), h AS (SELECT (SELECT max(us) - min(us) FROM base) / 86400000000 AS days, n, list_contains(roles, 'person') AS person, list_contains(roles, 'deferrable_loads') OR list_contains(roles, 'ev_charger') AS loads, list_contains(roles, 'energy_price') AS price, list_contains(roles, 'solar_production') AS solar FROM ha, hs)
    SELECT gap, kind, score FROM h, (VALUES ('history too short', 'infrastructure', 0.9, 'days'), ('nobody''s presence is tracked', 'integration', 0.85, 'nobody'), ('no motion or presence sensor at all', 'hardware', 0.75, 'hands'), ('loads that could move, no price', 'integration', 0.7, 'noprice'),
        ('price and loads, nothing moves them', 'integration', 0.65, 'both'), ('solar production without a forecast', 'integration', 0.6, 'solar'), ('weekday rules without a workday calendar', 'integration', 0.55, 'always'), ('price and loads, carbon intensity unknown', 'integration', 0.4, 'both')) v(gap, kind, score, need)
    WHERE CASE need WHEN 'days' THEN days < 14 WHEN 'nobody' THEN NOT person WHEN 'hands' THEN n >= 20 WHEN 'noprice' THEN loads AND NOT price WHEN 'both' THEN loads AND price WHEN 'solar' THEN solar ELSE true END""")
def gap_suggestions(spark, sf_dir):
    start, end = _bounds(spark, sf_dir)
    known = health.gap_facts(signal_roles(spark, sf_dir), human_actions_by_domain(spark, sf_dir), weekday_rules=1, history_days=(end - start) / DAY)
    return health.gaps(known)


@query("""SELECT DISTINCT domain, state, CASE WHEN domain = 'media_player' AND state = 'playing' THEN 'media_player.media_play' WHEN state = 'on' THEN domain || '.turn_on' WHEN state = 'off' THEN domain || '.turn_off' END AS service FROM base WHERE num IS NULL""")
def services(spark, sf_dir):
    return dimensions.service_for(changes(spark, sf_dir).filter("num is null").select("domain", "state").distinct()).select("domain", "state", "service")


#: A registry made of the entities whose number is not 3, live states of those whose number is not 0, and devices and areas by number.
DIMENSION = """, id_ AS (SELECT DISTINCT entity_id, domain, CAST(right(entity_id, 1) AS INT) AS d FROM base), lv AS (SELECT entity_id, upper(arg_max(state, (us, sid))) AS live FROM base GROUP BY entity_id),
    dm AS (SELECT i.entity_id, CASE WHEN d < 3 THEN CASE WHEN d = 0 THEN 'attic' WHEN domain IN ('light', 'switch') THEN ['attic', 'hall', 'yard'][d + 1] END END AS area_name, CASE WHEN d > 0 THEN live WHEN domain = 'person' THEN NULL ELSE 'own ' || i.entity_id END AS name, CASE WHEN d = 3 THEN 'states' WHEN d = 0 THEN 'registry' ELSE 'both' END AS source FROM id_ i JOIN lv USING (entity_id))
"""


def _dimension(spark, sf_dir):
    ids = entity_ids(spark, sf_dir).withColumn("d", F.right("entity_id", F.lit(1)).cast("int"))
    none = F.lit(None).cast("string")
    own = F.when(F.col("domain") != "person", F.concat(F.lit("own "), "entity_id"))
    e = ids.filter("d < 3").select("entity_id", F.when(F.col("domain").isin("light", "switch"), F.col("d").cast("string")).alias("device_id"), F.when(F.col("d") == 0, "0").alias("area_id"), F.array("domain").alias("labels"), none.alias("name_by_user"), none.alias("name"), own.alias("original_name"), none.alias("unit"))
    d = ids.select(F.col("d").cast("string").alias("device_id"), F.col("d").cast("string").alias("area_id"), F.array(F.lit("house")).alias("labels")).distinct()
    a = ids.filter("d < 3").select(F.col("d").cast("string").alias("area_id"), F.get(F.array(*map(F.lit, ("attic", "hall", "yard"))), F.col("d")).alias("name")).distinct()
    live = changes(spark, sf_dir).filter(F.right("entity_id", F.lit(1)) != "0").groupBy("entity_id").agg(F.upper(F.max_by("state", F.struct("us", "sid"))).alias("friendly_name")).withColumn("unit", none)
    return dimensions.merge_states(dimensions.registry(e, d, a), live)


@query(DIMENSION + "SELECT entity_id, area_name, name, source FROM dm")
def entity_dimension(spark, sf_dir):
    return _dimension(spark, sf_dir).select("entity_id", "area_name", "name", "source")


@query(DIMENSION + "SELECT count(*) AS entities, count(*) FILTER (source = 'registry') AS registry, count(*) FILTER (source = 'states') AS states, count(*) FILTER (source = 'both') AS both, CAST(0 AS BIGINT) AS recorder, count(area_name) AS with_area FROM dm")
def entity_stats(spark, sf_dir):
    return dimensions.stats(_dimension(spark, sf_dir))


@query(DIMENSION + "SELECT entity_id FROM dm WHERE contains(lower(concat_ws(' ', entity_id, name, area_name)), 'hall')")
def entity_search(spark, sf_dir):
    return dimensions.search(_dimension(spark, sf_dir), "HALL").select("entity_id")


@query(DIMENSION + "SELECT entity_id, source FROM dm WHERE source <> 'states' UNION ALL SELECT entity_id, 'recorder' FROM dm WHERE source = 'states'")
def seeded_entities(spark, sf_dir):
    """Those of the dimension that the registry has, and the rest of the history's ids as bare rows."""
    return dimensions.seed(_dimension(spark, sf_dir).filter("source <> 'states'"), changes(spark, sf_dir)).select("entity_id", "source")


@query(OVERRIDES + RULES_SQL + MATCH + JUDGED + """SELECT rule_id, round(1 / (1 + exp(-(-1.0 + 2.0 * coalesce(p, 0) + CASE WHEN p IS NULL THEN -0.5 ELSE 0 END + 0.8 * coalesce(r, 0) - 0.6 * ln(1 + fw) + 0.25 * ln(1 + true_fires) - 0.1 * ln(2) + 0.3))), 9) AS probability FROM jr WHERE seg = 'full'""")
def ranking_probability(spark, sf_dir):
    """Acceptance of the replayed rules under the prior, as there are no decisions yet."""
    rated = _judged(spark, sf_dir).filter("seg = 'full'").withColumn("false_fires_per_week", F.col("false_week")).withColumn("domains", F.array("domain")).withColumn("n_entities", F.lit(1))
    none = rated.withColumn("label", F.lit(1)).withColumn("decided_at", F.lit(0)).limit(0)
    return ranking.rank(rated, none).select("rule_id", F.round("probability", 9).alias("probability"))


@query("""SELECT sid, text, coalesce(minute, -1) AS minute, CASE WHEN minute IS NOT NULL THEN printf('%02d:%02d:00', minute // 60, minute % 60) END AS clock FROM (SELECT *, CASE WHEN regexp_full_match(text, '([01][0-9]|2[0-3]):([0-5][0-9])(:[0-5][0-9])?') THEN CAST(text[1:2] AS INT) * 60 + CAST(text[4:5] AS INT) END AS minute FROM
    (SELECT sid, CASE sid % 3 WHEN 0 THEN printf('%02d:%02d', h, m) WHEN 1 THEN printf('%02d:%02d:%02d', h, m, m) ELSE printf('%d:%02d', h + 10, m) END AS text FROM (SELECT sid, CAST((us // 3600000000) % 24 AS INT) AS h, CAST((us // 60000000) % 60 AS INT) AS m FROM base)))""")
def clock_texts(spark, sf_dir):
    """Times of events written in three ways, one of which has hours that no clock has."""
    us = F.col("us")
    h, m = F.floor(F.pmod(us, F.lit(DAY)) / HOUR), F.floor(F.pmod(us, F.lit(HOUR)) / MINUTE)
    text = F.when(F.col("sid") % 3 == 0, F.format_string("%02d:%02d", h, m)).when(F.col("sid") % 3 == 1, F.format_string("%02d:%02d:%02d", h, m, m)).otherwise(F.format_string("%d:%02d", h + 10, m))
    rows = changes(spark, sf_dir).select("sid", text.alias("text")).withColumn("minute", circular.parse(F.col("text")))
    return rows.withColumn("clock", F.when(F.col("minute").isNotNull(), circular.hhmm(F.col("minute")))).na.fill(-1, ["minute"])


#: Sequences of contexts and sessions together, as items in order, and the patterns among them.
ALL_SEQUENCES = SESSIONS + """, cx AS (SELECT context, item, min(us) AS u, min(sid) AS s FROM us_ WHERE context IS NOT NULL AND (cause IN ('automation', 'script') OR chain_depth > 0) AND context IN (SELECT context FROM us_ WHERE context IS NOT NULL AND (cause IN ('automation', 'script') OR chain_depth > 0) GROUP BY context HAVING count(*) > 1) GROUP BY ALL),
    aq AS (SELECT row_number() OVER () AS seq_id, items FROM (SELECT items FROM sq UNION ALL SELECT list(item ORDER BY u, s) FROM cx GROUP BY context HAVING count(*) > 1))
"""


@query(ALL_SEQUENCES + "SELECT array_to_string(items, '>') AS items FROM aq")
def all_sequences(spark, sf_dir):
    return sequences.all_sequences(sequences.usable(annotated(spark, sf_dir)), GAP).select(F.array_join("items", ">").alias("items"))


ROUTINES = ALL_SEQUENCES + """, al AS (SELECT seq_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM aq),
    pt AS (SELECT [a.item, b.item] AS items, count(*) AS support FROM al a JOIN al b ON a.seq_id = b.seq_id AND a.pos < b.pos GROUP BY ALL HAVING count(*) >= 3
        UNION ALL SELECT [a.item, b.item, c.item], count(*) FROM al a JOIN al b ON a.seq_id = b.seq_id AND a.pos < b.pos JOIN al c ON c.seq_id = b.seq_id AND b.pos < c.pos GROUP BY ALL HAVING count(*) >= 3
        UNION ALL SELECT [a.item, b.item, c.item, d.item], count(*) FROM al a JOIN al b ON a.seq_id = b.seq_id AND a.pos < b.pos JOIN al c ON c.seq_id = b.seq_id AND b.pos < c.pos JOIN al d ON d.seq_id = c.seq_id AND c.pos < d.pos GROUP BY ALL HAVING count(*) >= 3),
    k4 AS (SELECT * FROM pt WHERE len(items) = 4),
    k3 AS (SELECT * FROM k4 UNION ALL SELECT * FROM pt x WHERE len(items) = 3 AND NOT EXISTS (SELECT 1 FROM k4 y WHERE x.support <= y.support * 1.1 AND list_filter(y.items, lambda i: list_contains(x.items, i)) = x.items)),
    kp AS (SELECT * FROM k3 UNION ALL SELECT * FROM pt x WHERE len(items) = 2 AND NOT EXISTS (SELECT 1 FROM k3 y WHERE x.support <= y.support * 1.1 AND list_filter(y.items, lambda i: list_contains(x.items, i)) = x.items)),
    hi AS (SELECT entity_id || '=' || lower(state) AS item, count(*) AS n FROM ann WHERE cause = 'human' AND old_state IS NOT NULL AND old_state <> state GROUP BY ALL),
    tr_ AS (SELECT item AS trigger, count(*) AS opportunities FROM al GROUP BY item),
    hl AS (SELECT list(item) AS known FROM hi WHERE n >= 2),
    ac_ AS (SELECT items, support, items[1] AS trigger, list_filter(items[2:], lambda i: split_part(i, '.', 1) IN ('light', 'media_player', 'switch') AND list_contains(known, i)) AS actions FROM kp, hl)
"""


def _patterns(spark, sf_dir):
    rows = sequences.all_sequences(sequences.usable(annotated(spark, sf_dir)), GAP)
    return rows, sequences.prune(sequences.patterns(rows, 3))


@query(ROUTINES + "SELECT array_to_string(items, '>') AS pattern, support FROM kp")
def pruned_patterns(spark, sf_dir):
    return _patterns(spark, sf_dir)[1].select("pattern", "support")


@query(ROUTINES + "SELECT array_to_string(items, '>') AS pattern, trigger, array_to_string(actions, '>') AS actions, support, opportunities, round(support / opportunities, 9) AS confidence, round(support / opportunities * least(support / 10.0, 1.0), 9) AS score FROM ac_ JOIN tr_ USING (trigger) WHERE len(actions) >= 2")
def sequence_candidates(spark, sf_dir):
    rows, kept = _patterns(spark, sf_dir)
    mine = annotated(spark, sf_dir).filter((F.col("cause") == "human") & model.is_transition())
    item = F.concat_ws("=", "entity_id", F.lower("state")).alias("item")
    human = mine.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    known = dimensions.service_for(changes(spark, sf_dir).select("entity_id", "domain", "state").distinct()).filter("service is not null").select(item, "service").distinct()
    found = sequences.candidates(kept, rows, human, list(model.ACTIONABLE), known)
    return found.select("pattern", "trigger", "actions", "support", "opportunities", F.round("confidence", 9).alias("confidence"), F.round("score", 9).alias("score"))
