"""Batch forms of the streaming operators, where SQL can express them with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.digest import FNV64
from strandline.operators import stats as S
from strandline.plans.registry import query
from strandline.session import table
from strandline.streaming import machines as M
from strandline.streaming.processors import batch

#: Button masks of a user's events, one a frame.
_MASK_SQL = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CASE event_type WHEN 'click' THEN 16 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE 32 END AS mask FROM events"


def masks(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    mask = F.when(F.col("event_type") == "click", M.RIGHT).when(F.col("event_type") == "view", 0).when(F.col("event_type") == "purchase", M.A).otherwise(M.LEFT)
    return table(spark, sf, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), mask.cast("int").alias("mask"))


_HELD_SQL = f"""SELECT user_id, n, mask, coalesce(last_value(CASE WHEN steady THEN mask END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held
    FROM (SELECT *, coalesce(mask = lag(mask) OVER (PARTITION BY user_id ORDER BY n), mask = 0 AND false) AS steady FROM ({_MASK_SQL}))"""


@query("debounce_edges", f"SELECT user_id, n, held, held & ~coalesce(lag(held) OVER w, 0) AS pressed, coalesce(lag(held) OVER w, 0) & ~held AS released FROM ({_HELD_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY n)")
def debounce_edges(spark, sf):
    """Debounce of two equal samples and the edges of what is held, by windows alone."""
    w = Window.partitionBy("user_id").orderBy("n")
    steady = F.coalesce(F.col("mask") == F.lag("mask").over(w), F.lit(False))
    held = masks(spark, sf).withColumn("steady", steady).withColumn("held", F.coalesce(F.last(F.when(F.col("steady"), F.col("mask")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    before = F.coalesce(F.lag("held").over(w), F.lit(0))
    return held.select("user_id", "n", "held", F.col("held").bitwiseAND(F.bitwise_not(before)).alias("pressed"), before.bitwiseAND(F.bitwise_not(F.col("held"))).alias("released"))


_DIRECTION_SQL = "CASE (held & 48) WHEN 16 THEN 16 WHEN 32 THEN 32 ELSE 0 END + CASE (held & 192) WHEN 64 THEN 64 WHEN 128 THEN 128 ELSE 0 END"
_ACTION_SQL = "CASE WHEN (pressed & 9) <> 0 THEN 'pause_toggle' WHEN (pressed & 272) <> 0 THEN 'next_track' WHEN (pressed & 544) <> 0 THEN 'previous_track' WHEN (pressed & 128) <> 0 THEN 'restart_track' END"


@query(
    "key_machine",
    f"""WITH c AS (SELECT user_id, n, held, (held & 779) = 779 AS chord, coalesce(lag(held) OVER (PARTITION BY user_id ORDER BY n), 0) AS before FROM ({_HELD_SQL})),
        d AS (SELECT *, CASE WHEN chord THEN 0 ELSE {_DIRECTION_SQL} END AS way FROM c), t AS (SELECT *, way <> coalesce(lag(way) OVER (PARTITION BY user_id ORDER BY n), 0) AS turned FROM d),
        g AS (SELECT *, sum(turned::INT) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM t), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY n) - 1 AS place FROM g),
        e AS (SELECT user_id, n, held, CASE WHEN chord THEN 0 ELSE held & ~before END AS pressed, CASE WHEN chord THEN 0 ELSE before & ~held END AS released, CASE WHEN place >= 24 AND (place - 24) % 8 = 0 THEN way ELSE 0 END AS repeated FROM p)
        SELECT user_id AS key, n AS seq, held, pressed, released, repeated, {_ACTION_SQL} AS action FROM e""",
)
def key_machine(spark, sf):
    """The whole key machine: debounce, edges, auto-repeat by the place in a direction's run, and actions, as windows."""
    return batch(masks(spark, sf).select(F.col("user_id").alias("key"), F.col("n").alias("seq"), "mask"), "keys")


@query("key_actions", "SELECT event_id, CASE WHEN event_id % 1024 & 9 <> 0 THEN 'pause_toggle' WHEN event_id % 1024 & 272 <> 0 THEN 'next_track' WHEN event_id % 1024 & 544 <> 0 THEN 'previous_track' WHEN event_id % 1024 & 128 <> 0 THEN 'restart_track' END AS action FROM events")
def key_actions(spark, sf):
    return table(spark, sf, "events").select("event_id", M.action_of(F.col("event_id") % 1024).alias("action"))


_CHUNK_SQL = """SELECT hour, ready, CASE WHEN ready >= 60 THEN 'full' WHEN hour >= (SELECT max(hour) FROM h) - 2 AND ready > 0 THEN 'tail' ELSE 'starved' END AS verdict, CASE WHEN ready >= 60 THEN 60 WHEN hour >= (SELECT max(hour) FROM h) - 2 THEN ready ELSE 0 END AS "real" FROM h"""
_HOURS_SQL = "h AS (SELECT epoch_us(ts) // 3600000000 AS hour, count(*) AS ready FROM events GROUP BY 1)"


def _hours(spark, sf):
    return table(spark, sf, "events").groupBy(F.expr("unix_timestamp(ts) div 3600").alias("hour")).agg(F.count(F.lit(1)).alias("ready"))


def _chunks(spark, sf):
    h = _hours(spark, sf)
    last = h.agg(F.max("hour").alias("end"))  # one row
    late = F.col("hour") >= F.col("end") - 2
    full = F.col("ready") >= 60
    return h.join(F.broadcast(last)).select("hour", "ready", F.when(full, "full").when(late & (F.col("ready") > 0), "tail").otherwise("starved").alias("verdict"), F.when(full, 60).when(late, F.col("ready")).otherwise(0).cast("long").alias("real"), late.alias("late"))


@query("chunk_verdicts", f"WITH {_HOURS_SQL} {_CHUNK_SQL}")
def chunk_verdicts(spark, sf):
    """Full, tail or starved by what an hour brought."""
    return _chunks(spark, sf).drop("late")


@query("ledger", f"WITH {_HOURS_SQL}, c AS ({_CHUNK_SQL}) SELECT count(*) AS periods, count(*) FILTER (verdict = 'full') AS served, count(*) FILTER (verdict = 'starved' AND hour < (SELECT max(hour) FROM h) - 2) AS underruns, count(*) FILTER (verdict = 'tail' OR (verdict = 'starved' AND hour >= (SELECT max(hour) FROM h) - 2)) AS tail_after_end, max(ready) AS max_ready FROM c")
def ledger(spark, sf):
    c = _chunks(spark, sf)
    v = F.col("verdict")
    return c.agg(F.count(F.lit(1)).alias("periods"), F.count_if(v == "full").alias("served"), F.count_if((v == "starved") & ~F.col("late")).alias("underruns"), F.count_if((v == "tail") | (v == "starved") & F.col("late")).alias("tail_after_end"), F.max("ready").alias("max_ready"))


@query(
    "starved_runs",
    """WITH s AS (SELECT user_id, event_id, value < 60 AS starved FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - sum(starved::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
       SELECT user_id, max(length) AS longest, count(*) AS runs FROM (SELECT user_id, island, count(*) AS length FROM g WHERE starved GROUP BY ALL) GROUP BY user_id""",
)
def starved_runs(spark, sf):
    r = S.runs(table(spark, sf, "events").select("user_id", "event_id", (F.col("value") < 60).alias("starved")), ["user_id"], "event_id", "starved")
    return r.groupBy("user_id").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("runs"))


_RING_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'click' THEN 'take' WHEN 'purchase' THEN 'truncate' ELSE 'push' END AS op,
           CASE WHEN event_type = 'click' THEN 560 ELSE round(value)::BIGINT * 20 END::BIGINT AS n FROM events),
       r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS ready, NULL::VARCHAR AS verdict, 0::BIGINT AS moved, false AS refused FROM (SELECT DISTINCT user_id FROM events)
             UNION ALL
             SELECT o.user_id, o.i, o.event_id, CASE WHEN op = 'push' AND ready + n <= 20160 THEN ready + n WHEN op = 'truncate' THEN 0 WHEN op = 'take' AND ready >= n THEN ready - n ELSE ready END,
                    CASE WHEN op = 'take' THEN CASE WHEN ready >= n THEN 'full' ELSE 'starved' END END, CASE WHEN op = 'push' AND ready + n <= 20160 THEN n WHEN op = 'truncate' THEN ready WHEN op = 'take' AND ready >= n THEN n ELSE 0 END,
                    op = 'push' AND ready + n > 20160 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
       SELECT user_id AS key, event_id AS seq, verdict, moved AS "real", ready, refused FROM r WHERE i > 0"""


@query("ring_machine", _RING_SQL)
def ring_machine(spark, sf):
    """Pushes and takes of each user through a bounded ring."""
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "click", "take").when(F.col("event_type") == "purchase", "truncate").otherwise("push")
    return batch(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op == "take", M.CHUNK).otherwise(F.round("value") * 20).cast("long").alias("n")), "ring")


_FNV_SQL = "list_reduce({}, lambda h, b: ((xor(h, b::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT), {})"


def _played_sql(side: str, items: str) -> str:
    return f"CASE WHEN op = 'push' AND why IS NULL THEN {_FNV_SQL.format(items, side)} ELSE {side} END"


@query(
    "ring_feed",
    f"""WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'click' THEN 'take' WHEN 'purchase' THEN 'truncate' ELSE 'push' END AS op, round(value * 100)::BIGINT - 14000 AS x FROM events),
       r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS ready, NULL::VARCHAR AS verdict, 0::BIGINT AS moved, NULL::VARCHAR AS refused, {FNV64[0]}::HUGEINT AS l, {FNV64[0]}::HUGEINT AS r FROM (SELECT DISTINCT user_id FROM events)
             UNION ALL
             SELECT user_id, i, event_id, CASE WHEN op = 'push' AND why IS NULL THEN ready + 3 WHEN op = 'truncate' THEN 0 WHEN op = 'take' AND ready >= 7 THEN ready - 7 ELSE ready END, CASE WHEN op = 'take' THEN CASE WHEN ready >= 7 THEN 'full' ELSE 'starved' END END,
                    CASE WHEN op = 'push' AND why IS NULL THEN 3 WHEN op = 'truncate' THEN ready WHEN op = 'take' AND ready >= 7 THEN 7 ELSE 0 END, CASE WHEN op = 'push' THEN why END,
                    {_played_sql("l", "[(x >> 8) & 255, ((x + 300) >> 8) & 255, ((x + 600) >> 8) & 255]")}, {_played_sql("r", "[((-x) >> 8) & 255, ((-x - 300) >> 8) & 255, ((-x - 600) >> 8) & 255]")}
             FROM (SELECT o.*, ready, l, r, CASE WHEN ready + 3 > 20160 THEN 'space' WHEN x + 600 > 32767 OR -x - 600 < -32768 THEN 'profile' END AS why FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
       SELECT user_id AS key, event_id AS seq, verdict, moved AS "real", ready, refused, lower(lpad(hex(l::UBIGINT), 16, '0')) AS played_left, lower(lpad(hex(r::UBIGINT), 16, '0')) AS played_right FROM r WHERE i > 0""",
)
def ring_feed(spark, sf):
    """Frames of three samples into each user's ring, with the digests of what will be played; frames out of range change nothing."""
    x = F.round(F.col("value") * 100).cast("long") - 14000
    op = F.when(F.col("event_type") == "click", "take").when(F.col("event_type") == "purchase", "truncate").otherwise("push")
    frames = [F.array(*[(s * (x + 300 * i)).cast("long") for i in range(3)]) for s in (1, -1)]
    return batch(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.lit(7).cast("long").alias("n"), frames[0].alias("left"), frames[1].alias("right")), "feed")


@query("frame_source", "SELECT t::INT AS track, f AS frame, p AS place, f * 64 AS first_sample, f = 0 AS roll, list_transform(range(64), lambda k: ((t * 7919 + f * 64 + k) * 40503) % 65536 - 32768)::INT[] AS \"left\" FROM (SELECT 0 AS t, unnest(range(0, 700)) AS f, unnest(range(0, 700)) AS p UNION ALL SELECT 1, unnest(range(0, 300)), unnest(range(700, 1000)))")
def frame_source(spark, sf):
    """The generated frames of two tracks through the data source."""
    from strandline.streaming import framesource

    framesource.register(spark)
    return spark.read.format("frames").option("kind", "stub").option("frames", "700,300").load().select("track", "frame", "place", "first_sample", "roll", "left")


_COMMANDS = ("period", "toggle", "period", "period", "skip", "period", "cover", "toggle_dry", "filled", "period")
_TRANSPORT_SQL = f"""WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {list(_COMMANDS)!r}[event_id % 10 + 1] AS command FROM events),
       r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS command, NULL::VARCHAR AS step, 'playing' AS state, 256 AS level, 0 AS slope, 0 AS wait, false AS silent FROM (SELECT DISTINCT user_id FROM events)
             UNION ALL
             SELECT user_id, i, event_id, command, step, next, CASE WHEN next = 'repriming' AND state = 'skipping' THEN 0 ELSE level END,
                    CASE WHEN command <> 'period' AND next IN ('pausing', 'skipping') AND next <> state THEN -1 WHEN command <> 'period' AND next = 'resuming' AND next <> state THEN 1 WHEN next = 'repriming' AND state = 'skipping' THEN 0 ELSE slope END,
                    CASE WHEN next = 'repriming' AND state = 'skipping' THEN 2 WHEN command <> 'period' AND next = 'resuming' AND next <> state THEN 0 ELSE wait END, silent AND next = state
             FROM (SELECT *, CASE WHEN command IN ('toggle', 'toggle_dry') AND state = 'playing' THEN 'pausing' WHEN command = 'toggle' AND state = 'paused' THEN 'resuming' WHEN command = 'toggle_dry' AND state = 'paused' THEN 'buffering'
                                  WHEN command = 'skip' AND state = 'playing' THEN 'skipping' WHEN command = 'filled' AND state = 'buffering' THEN 'resuming' WHEN command = 'cover' AND state = 'skipping' THEN 'repriming'
                                  WHEN command = 'period' AND state = 'pausing' AND level = 0 AND silent THEN 'paused' WHEN command = 'period' AND state IN ('resuming', 'repriming') AND level = 256 THEN 'playing' ELSE state END AS next,
                             CASE WHEN command IN ('toggle', 'toggle_dry', 'skip') AND state = 'playing' THEN 'fade_out' WHEN command = 'toggle' AND state = 'paused' OR command = 'filled' AND state = 'buffering' THEN 'prime'
                                  WHEN command = 'toggle_dry' AND state = 'paused' THEN 'buffer' WHEN command = 'cover' AND state = 'skipping' THEN 'covered' WHEN command = 'period' AND level = 0 AND silent AND state = 'pausing' THEN 'freeze'
                                  WHEN command = 'period' AND level = 0 AND silent AND state = 'skipping' THEN 'skip_hand_off' WHEN command IN ('period', 'filled') THEN 'idle' ELSE 'ignored' END AS step
                   FROM (SELECT o.user_id, o.i, o.event_id, o.command, state, CASE WHEN o.command = 'period' THEN greatest(0, least(256, level + slope * 560)) ELSE level END AS level,
                                CASE WHEN o.command <> 'period' THEN slope WHEN wait = 1 THEN 1 WHEN slope < 0 AND level + slope * 560 <= 0 THEN 0 ELSE slope END AS slope, CASE WHEN o.command = 'period' THEN greatest(0, wait - 1) ELSE wait END AS wait,
                                silent OR o.command = 'period' AND level = 0 AND slope = 0 AS silent FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)))
       SELECT user_id AS key, event_id AS seq, command, step, state, level::INT AS gain FROM r WHERE i > 0"""


@query("transport_machine", _TRANSPORT_SQL)
def transport_machine(spark, sf):
    commands = F.array(*[F.lit(c) for c in _COMMANDS])
    return batch(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.get(commands, (F.col("event_id") % 10).cast("int")).alias("command")), "transport")


@query("gain_ramp", "SELECT event_id, n, greatest(0, least(256, 256 - n * (1 + event_id % 5))) AS gain, ((event_id * 37) % 255 - 127) * greatest(0, least(256, 256 - n * (1 + event_id % 5))) >> 8 AS scaled FROM (SELECT event_id, event_id % 300 AS n FROM events)")
def gain_ramp(spark, sf):
    from strandline.functions.bits import scale_byte

    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 300).alias("n")).withColumn("gain", F.expr("greatest(0, least(256, 256 - n * (1 + event_id % 5)))"))
    return e.select("event_id", "n", "gain", scale_byte(F.expr("(event_id * 37) % 255 - 127"), F.col("gain")).alias("scaled"))


@query("session_clock", "SELECT user_id, event_id, sum(cast(round(value) as bigint)) OVER w::BIGINT AS committed, greatest(0, sum(cast(round(value) as bigint)) OVER w - 1136)::BIGINT AS shown FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def session_clock(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = F.sum(F.round("value").cast("long")).over(w)
    return table(spark, sf, "events").select("user_id", "event_id", c.alias("committed"), F.greatest(F.lit(0), c - 1136).alias("shown"))


@query("pending_slot", "SELECT user_id, count(*) FILTER (dropped) AS dropped, count(*) FILTER (NOT dropped) AS taken FROM (SELECT user_id, coalesce(lead(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) = false, false) AS dropped FROM events WHERE event_type IN ('click', 'purchase', 'view') QUALIFY event_type <> 'purchase') GROUP BY user_id")
def pending_slot(spark, sf):
    """A slot that holds the latest value: a value is lost if another one comes before the slot is taken."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").where("event_type in ('click', 'purchase', 'view')")
    lost = F.coalesce(~(F.lead("event_type").over(w) == "purchase"), F.lit(False))
    return e.select("user_id", "event_type", lost.alias("lost")).where("event_type <> 'purchase'").groupBy("user_id").agg(F.count_if("lost").alias("dropped"), F.count_if(~F.col("lost")).alias("taken"))


@query(
    "interactions",
    """WITH o AS (SELECT user_id, event_id FROM events WHERE event_type = 'click'), r AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'),
       p AS (SELECT o.user_id, o.event_id AS opened, r.event_id AS resolved FROM o ASOF LEFT JOIN r ON o.user_id = r.user_id AND o.event_id < r.event_id)
       SELECT user_id, count(*) AS opened, count(resolved) AS resolved, max(resolved - opened) AS worst FROM p GROUP BY user_id""",
)
def interactions(spark, sf):
    """Each opening paired with the next observation, and the worst wait: a forward as-of by one window."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    e = table(spark, sf, "events").where("event_type in ('click', 'purchase')")
    p = e.withColumn("seen", F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'click'")
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("opened"), F.count("seen").alias("resolved"), F.max(F.col("seen") - F.col("event_id")).alias("worst"))


@query("latch_gap", "SELECT user_id, max(gap) AS widest, count(*) AS frames FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) GROUP BY user_id")
def latch_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("user_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("gap")).groupBy("user_id").agg(F.max("gap").alias("widest"), F.count(F.lit(1)).alias("frames"))


_SCRIPT_SQL = f"SELECT user_id, n * 3 AS frame, mask FROM ({_MASK_SQL})"


@query("key_script", f"SELECT f.user_id, f.frame, s.mask FROM (SELECT user_id, unnest(range(0, 3 * count(*))) AS frame FROM ({_MASK_SQL}) GROUP BY user_id) f ASOF LEFT JOIN ({_SCRIPT_SQL}) s ON f.user_id = s.user_id AND f.frame >= s.frame")
def key_script(spark, sf):
    """A script of (frame, mask) pairs replayed as one mask a frame: each pair holds until the next."""
    from strandline.operators.lookup import asof

    script = masks(spark, sf).select("user_id", (F.col("n") * 3).alias("frame"), "mask")
    frames = script.select("user_id", F.explode(F.sequence(F.col("frame"), F.col("frame") + 2)).alias("frame"))
    return asof(frames, script, ["user_id"], "frame", ["mask"])
