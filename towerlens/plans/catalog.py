"""All registered queries over the given tables: name -> callable(spark, sf_dir)."""

from pyspark.sql import functions as F

from towerlens.functions import bitmaps, id_sets, sketches
from towerlens.functions import columns as C
from towerlens.operators import (
    flow,
    latest,
    persona,
    portraits,
    region_hours,
    sampling,
    user_index,
)
from towerlens.operators.skew import heavy_keys, heavy_keys_of
from towerlens.plans import batch, inputs, serving
from towerlens.session import materialise, work_folder
from towerlens.sinks import tables as sink
from towerlens.sinks.event_log import EventLog
from towerlens.sinks.index_table import IndexTable
from towerlens.sinks.keyed import KeyedTable
from towerlens.sources import lines, streams, tables
from towerlens.streaming import live, visits, writers

# Parameters of the registered queries.
HOUR = "2024011108"
REGION = "R0"
PORTRAIT = 5
STAY_MS = 24 * 3_600_000
PERSONA_WINDOW = "1 hour"
WATERMARK_DELAY = "2 hours"
NEWEST = 50
SAMPLE = 40

QUERIES = {}


def _query(fn, name=None):
    """Register ``fn``, with the session pinned to UTC hours."""

    def run(spark, sf_dir):
        # Lazy frames are analysed again when they run, so the setting has to stay.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[name or fn.__name__] = run
    return run


# ---- scans and parsers -------------------------------------------------------------------------


@_query
def scan_signal(spark, sf_dir):
    return inputs.signal(spark, sf_dir)


@_query
def scan_signal_hour(spark, sf_dir):
    return inputs.signal(spark, sf_dir, hour=HOUR)


@_query
def scan_user_info(spark, sf_dir):
    return inputs.all_users(spark, sf_dir)


@_query
def scan_region_cell(spark, sf_dir):
    return lines.accepted(lines.parse_region_cell(inputs.cell_lines(spark, sf_dir))).select(
        "region_id", "laccell"
    )


@_query
def scan_region_center(spark, sf_dir):
    parsed = lines.accepted(lines.parse_region_center(inputs.site_lines(spark, sf_dir)))
    last = latest.last_per_key(
        parsed.select("region_id", "name", "center", "boundary", "line_no"),
        ["region_id"],
        "line_no",
    )
    return serving.center_columns(last.drop("line_no"))


@_query
def parse_signal(spark, sf_dir):
    return lines.accepted(lines.parse_signal(inputs.signal_lines(spark, sf_dir))).drop("line")


@_query
def parse_user_info(spark, sf_dir):
    return lines.accepted(lines.parse_user_info(inputs.user_lines(spark, sf_dir))).drop("line")


@_query
def parse_reject_count(spark, sf_dir):
    """Accepted and rejected lines of the strict and tolerant parsers."""
    parsed = {
        "user_info": lines.parse_user_info(inputs.user_lines(spark, sf_dir)),
        "region_cell": lines.parse_region_cell(inputs.cell_lines(spark, sf_dir)),
        "region_center": lines.parse_region_center(inputs.site_lines(spark, sf_dir)),
    }
    counted = [
        lines.reject_counts(frame).select(F.lit(name).alias("input"), "n_ok", "n_rejected")
        for name, frame in parsed.items()
    ]
    # The strict and the tolerant reading of signals come from one pass over their lines.
    strict = lines.parse_signal(inputs.signal_lines(spark, sf_dir))
    strict = strict.select("line", F.col("is_valid").alias("strict"))
    both = lines.parse_signal_cell(strict).agg(
        *[F.count_if(c).alias(f"{c}_ok") for c in ("strict", "is_valid")],
        *[F.count_if(~F.col(c)).alias(f"{c}_bad") for c in ("strict", "is_valid")],
    )
    result = both.selectExpr(
        "stack(2, 'signal', strict_ok, strict_bad, 'signal_cell', is_valid_ok, is_valid_bad)"
        " AS (input, n_ok, n_rejected)"
    )
    for other in counted:
        result = result.unionByName(other)
    return result


@_query
def signal_hour(spark, sf_dir):
    return inputs.signal(spark, sf_dir).select(
        "event_id", C.hour_text(C.millis_to_ts("start_ms")).alias("produce_hour")
    )


# ---- user index and portraits ------------------------------------------------------------------


def _index(spark, sf_dir):
    return user_index.dense_ids(inputs.user_info(spark, sf_dir))


_query(lambda spark, sf_dir: user_index.dense_ids(inputs.all_users(spark, sf_dir)), "user_index")


@_query
def user_index_extended(spark, sf_dir):
    """Ids after a second load: subscribers seen first keep theirs, new ones follow."""
    first = inputs.user_info(spark, sf_dir)
    known = user_index.dense_ids(first)
    feed = inputs.signal(spark, sf_dir)
    return known.unionByName(user_index.extend_ids(known, feed))


@_query
def user_age_band(spark, sf_dir):
    return inputs.all_users(spark, sf_dir).select(
        "imsi", C.age_band(F.col("age")).alias("age_flag")
    )


@_query
def user_age_band_alt(spark, sf_dir):
    return inputs.all_users(spark, sf_dir).select(
        "imsi",
        C.age_band_closed_upper(F.col("age")).alias("age_flag"),
        C.gender_name(F.col("gender")).alias("gender_flag"),
    )


def _labelled(spark, sf_dir, index=None, scheme=portraits.STANDARD):
    index = _index(spark, sf_dir) if index is None else index
    return portraits.user_portraits(inputs.user_info(spark, sf_dir), index, scheme)


def _all_labelled(spark, sf_dir, scheme=portraits.STANDARD):
    users = inputs.all_users(spark, sf_dir)
    return portraits.user_portraits(users, user_index.dense_ids(users), scheme)


def _portrait_query(scheme=portraits.STANDARD, kinds=("gender", "age")):
    def run(spark, sf_dir):
        labelled = _all_labelled(spark, sf_dir, scheme)
        return portraits.portrait_sizes(portraits.portrait_members(labelled, scheme, kinds))

    return run


_query(_portrait_query(kinds=("gender",)), "portrait_gender")
_query(_portrait_query(kinds=("age",)), "portrait_age")
_query(_portrait_query(), "portraits")
_query(_portrait_query(portraits.CLOSED_UPPER), "portrait_alt")


@_query
def portrait_members(spark, sf_dir):
    return portraits.portrait_members(_all_labelled(spark, sf_dir)).select("portrait_id", "bitmap_id")


# ---- region hours ------------------------------------------------------------------------------


def _members(spark, sf_dir, index, how="left", hour=None, fold_unknown=True):
    signals = inputs.signal(spark, sf_dir, hour)
    return region_hours.region_hour_members(
        signals,
        inputs.region_cell(spark, sf_dir),
        index,
        how,
        heavy_keys(signals, "laccell"),
        fold_unknown,
    )


@_query
def region_hour_users(spark, sf_dir):
    return _members(spark, sf_dir, _index(spark, sf_dir))


@_query
def region_hour_users_inner(spark, sf_dir):
    return _members(spark, sf_dir, _index(spark, sf_dir), how="inner")


@_query
def region_hour_users_skewed(spark, sf_dir):
    """The form for heavy cells and a dimension too large to broadcast, whatever the size."""
    signals = inputs.signal(spark, sf_dir)
    heavy = heavy_keys(signals, "laccell", floor=30)
    return region_hours.region_hour_members(
        signals, inputs.region_cell(spark, sf_dir), _index(spark, sf_dir), "left", heavy, limit=-1
    )


@_query
def region_hour_count(spark, sf_dir):
    members = _members(spark, sf_dir, _index(spark, sf_dir), fold_unknown=False)
    return region_hours.region_hour_counts(members)


# ---- bitmaps -----------------------------------------------------------------------------------


@_query
def bitmap_buckets(spark, sf_dir):
    members = portraits.portrait_members(_all_labelled(spark, sf_dir))
    built = bitmaps.build(members, ["portrait_id"])
    return built.select("portrait_id", "bucket", F.bitmap_count("bm").alias("n_bits"))


@_query
def bitmap_buckets_wide(spark, sf_dir):
    """Bitmaps over ids that do not fit 32 bits and spread over many buckets."""
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderkey") * 101 + 5_000_000_000).alias("bitmap_id"),
    )
    built = bitmaps.build(orders, ["status"])
    return built.select("status", "bucket", F.bitmap_count("bm").alias("n_bits"))


@_query
def bitmap_to_ids(spark, sf_dir):
    """Region-hour sets through bitmaps and back to ids."""
    members = _members(spark, sf_dir, _index(spark, sf_dir), how="inner")
    keys = ["region_id", "produce_hour"]
    return bitmaps.expand(bitmaps.build(members, keys), keys)


@_query
def region_day_users(spark, sf_dir):
    """Users per region and day, from the membership rows."""
    members = _members(spark, sf_dir, _index(spark, sf_dir), fold_unknown=False)
    people = members.where(F.col("bitmap_id").isNotNull()).select(
        "region_id", C.day_text("produce_hour").alias("produce_day"), "bitmap_id"
    )
    return people.distinct().groupBy("region_id", "produce_day").agg(F.count("*").alias("n_users"))


@_query
def region_day_users_bitmap(spark, sf_dir):
    """Users per region and day: the bitmaps of the hours merged."""
    members = _members(spark, sf_dir, _index(spark, sf_dir), fold_unknown=False)
    hours = bitmaps.build(members, ["region_id", "produce_hour"])
    days = hours.withColumn("produce_day", C.day_text("produce_hour"))
    keys = ["region_id", "produce_day"]
    return bitmaps.cardinality(bitmaps.union(days, keys), keys)


@_query
def bitmap_and_count(spark, sf_dir):
    """Users per region, hour and portrait by intersecting bitmaps; empty intersections left out."""
    index = _index(spark, sf_dir)
    members = _members(spark, sf_dir, index, fold_unknown=False)
    hours = bitmaps.build(members, ["region_id", "produce_hour"])
    # The portrait bitmaps are written once, as their size is checked before they are joined.
    groups = materialise(
        bitmaps.build(
            portraits.portrait_members(_labelled(spark, sf_dir, index)), ["portrait_id"]
        )
    )
    keys = ["region_id", "produce_hour"]
    return bitmaps.and_counts(hours, groups, keys, ["portrait_id"])


@_query
def bitmap_and_ids(spark, sf_dir):
    """The users themselves of every portrait in one region and hour, as intersected bitmaps."""
    index = _index(spark, sf_dir)
    members = _members(spark, sf_dir, index, "inner", HOUR).where(F.col("region_id") == REGION)
    hours = bitmaps.build(members, ["region_id", "produce_hour"])
    groups = materialise(
        bitmaps.build(portraits.portrait_members(_labelled(spark, sf_dir, index)), ["portrait_id"])
    )
    keys = ["region_id", "produce_hour", "portrait_id"]
    return bitmaps.expand(bitmaps.intersect(hours, groups, keys[:2], keys[2:]), keys)


# ---- sets of two forms and sketches ------------------------------------------------------------


@_query
def region_day_users_sets(spark, sf_dir):
    """Users per region and day: the sets of the hours merged, thin buckets as offsets."""
    members = _members(spark, sf_dir, _index(spark, sf_dir), fold_unknown=False)
    days = id_sets.build(members, ["region_id", "produce_hour"]).withColumn("produce_day", C.day_text("produce_hour"))
    keys = ["region_id", "produce_day"]
    return id_sets.cardinality(id_sets.union(days, keys), keys)


@_query
def set_and_count(spark, sf_dir):
    """Users per region, hour and portrait by intersecting sets; empty intersections left out."""
    hours, groups = _hour_and_portrait_sets(spark, sf_dir)
    keys = ["region_id", "produce_hour"]
    both = id_sets.intersect(hours, groups, keys, ["portrait_id"])
    return id_sets.cardinality(both, [*keys, "portrait_id"])


@_query
def set_and_ids(spark, sf_dir):
    """The users themselves of every portrait in one region and hour, as intersected sets."""
    hours, groups = _hour_and_portrait_sets(spark, sf_dir, HOUR, REGION)
    keys = ["region_id", "produce_hour"]
    return id_sets.expand(id_sets.intersect(hours, groups, keys, ["portrait_id"]), [*keys, "portrait_id"])


def _hour_and_portrait_sets(spark, sf_dir, hour=None, region=None):
    index = _index(spark, sf_dir)
    members = _members(spark, sf_dir, index, hour=hour, fold_unknown=False)
    if region is not None:
        members = members.where(F.col("region_id") == region)
    people = portraits.portrait_members(_labelled(spark, sf_dir, index))
    # Written once, as their size is checked before they are joined.
    groups = materialise(id_sets.build(people, ["portrait_id"]))
    return id_sets.build(members, ["region_id", "produce_hour"]), groups


@_query
def region_day_people_sketch(spark, sf_dir):
    """Whether sketches of the hours, merged to days, give the people of a region within their bound."""
    members = _members(spark, sf_dir, _index(spark, sf_dir), fold_unknown=False).where("bitmap_id IS NOT NULL")
    keys = ["region_id", "produce_day"]
    hours = sketches.build(members, ["region_id", "produce_hour"])
    days = sketches.union(hours.withColumn("produce_day", C.day_text("produce_hour")), keys)
    return _within_bound(sketches.estimate(days), region_day_users(spark, sf_dir), keys)


@_query
def portrait_day_people_sketch(spark, sf_dir):
    """The same for the people of every portrait in a region and day: sketches intersected."""
    index = _index(spark, sf_dir)
    members = _members(spark, sf_dir, index, "inner", fold_unknown=False)
    members = members.withColumn("produce_day", C.day_text("produce_hour"))
    people = materialise(portraits.portrait_members(_labelled(spark, sf_dir, index)))
    keys = ["region_id", "produce_day"]
    days = sketches.union(sketches.build(members, [*keys, "produce_hour"]), keys)
    both = sketches.intersect(days, sketches.build(people, ["portrait_id"]), keys, ["portrait_id"])
    sets = id_sets.intersect(id_sets.build(members, keys), materialise(id_sets.build(people, ["portrait_id"])), keys, ["portrait_id"])
    keys = [*keys, "portrait_id"]
    return _within_bound(sketches.estimate(both), id_sets.cardinality(sets, keys), keys)


def _within_bound(estimated, exact, keys):
    """The exact counts, and whether the estimate of each is within its bound."""
    same = [estimated[key].eqNullSafe(exact[key]) for key in keys]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    off = F.abs(F.col("n_people") - F.col("n_users"))
    within = F.coalesce(off <= F.col("bound"), F.lit(False)).alias("within_bound")
    return exact.join(estimated, condition, "left").select(*[exact[key] for key in keys], "n_users", within)


# ---- serving: intersections --------------------------------------------------------------------


@_query
def portrait_region_hour_count(spark, sf_dir):
    index = _index(spark, sf_dir)
    return serving.portrait_user_count(
        _members(spark, sf_dir, index, "inner", HOUR),
        portraits.portrait_members(_labelled(spark, sf_dir, index)),
        REGION,
        HOUR,
        PORTRAIT,
    )


@_query
def portrait_region_hour_users(spark, sf_dir):
    index = _index(spark, sf_dir)
    return serving.portrait_users(
        _members(spark, sf_dir, index, "inner", HOUR),
        portraits.portrait_members(_labelled(spark, sf_dir, index)),
        REGION,
        HOUR,
        PORTRAIT,
    )


@_query
def portrait_region_hour_matrix(spark, sf_dir):
    index = _index(spark, sf_dir)
    return region_hours.matrix(
        _members(spark, sf_dir, index, fold_unknown=False),
        _labelled(spark, sf_dir, index),
        portraits.STANDARD.lookup(0),
    )


# ---- live operators in batch form --------------------------------------------------------------


def _cells(spark, sf_dir):
    return latest.cell_map(inputs.region_cell(spark, sf_dir), "line_no")


def _heavy(spark, sf_dir):
    """Subscribers and cells with too many signals for one task."""
    return heavy_keys_of(inputs.signal(spark, sf_dir), ("imsi", "laccell"))


def _flow(spark, sf_dir, heavy=None):
    return persona.user_region_flow(
        inputs.signal(spark, sf_dir),
        inputs.user_info(spark, sf_dir),
        _cells(spark, sf_dir),
        *(heavy or _heavy(spark, sf_dir)),
    )


def _persona(spark, sf_dir):
    return persona.persona_windows(_flow(spark, sf_dir), PERSONA_WINDOW)


def _changes(spark, sf_dir):
    heavy = _heavy(spark, sf_dir)
    return flow.region_changes(_flow(spark, sf_dir, heavy), heavy[0])


def _flow_events(spark, sf_dir):
    return flow.flow_events(_changes(spark, sf_dir), inputs.target_region(spark, sf_dir))


def _stay_events(spark, sf_dir):
    visits = flow.visits(_changes(spark, sf_dir), inputs.target_region(spark, sf_dir))
    newest = inputs.signal(spark, sf_dir).agg(F.max("event_ts").alias("h"))
    return flow.stay_events(visits, STAY_MS, newest.scalar())


@_query
def enriched_signal(spark, sf_dir):
    signals = inputs.signal(spark, sf_dir)
    return persona.enrich(
        signals, inputs.user_info(spark, sf_dir), heavy_keys(signals, "imsi")
    ).select("imsi", "laccell", "gender", "age", "event_ts")


@_query
def user_region_flow(spark, sf_dir):
    return _flow(spark, sf_dir).select("imsi", "region_id", "gender", "age", "event_ts")


@_query
def region_persona_window(spark, sf_dir):
    windows = _persona(spark, sf_dir)
    return windows.withColumns(
        {
            "window_start_text": C.second_text("window_start"),
            "window_end_text": C.second_text("window_end"),
        }
    ).drop("window_end")


@_query
def region_persona_people(spark, sf_dir):
    """The counters with the number of different people next to the number of signals."""
    return persona.persona_windows(
        _flow(spark, sf_dir), "10 seconds", distinct_users=True
    ).drop("window_end")


@_query
def flow_events(spark, sf_dir):
    return _flow_events(spark, sf_dir)


@_query
def flow_events_skewed(spark, sf_dir):
    """The form for heavy subscribers and cells and large dimensions, whatever the size."""
    heavy = heavy_keys_of(inputs.signal(spark, sf_dir), ("imsi", "laccell"), floor=20)
    placed = persona.user_region_flow(
        inputs.signal(spark, sf_dir),
        inputs.user_info(spark, sf_dir),
        _cells(spark, sf_dir),
        *heavy,
        limit=-1,
    )
    return flow.flow_events(
        flow.region_changes(placed, heavy[0]), inputs.target_region(spark, sf_dir)
    )


@_query
def flow_events_all(spark, sf_dir):
    return flow.flow_events(_changes(spark, sf_dir))


@_query
def region_visits(spark, sf_dir):
    visits = flow.visits(_changes(spark, sf_dir), inputs.target_region(spark, sf_dir))
    return visits.select("imsi", "region_id", "enter_ts", "exit_ts")


@_query
def stay_events(spark, sf_dir):
    return _stay_events(spark, sf_dir)


@_query
def stay_delta(spark, sf_dir):
    return flow.stay_deltas(_stay_events(spark, sf_dir)).select(
        "imsi", "region_id", "event_ts", "event_type", "delta"
    )


@_query
def stay_running_total(spark, sf_dir):
    # The stays are written once: the running sum needs them for the slice totals and the rows.
    stays = materialise(_stay_events(spark, sf_dir).select("imsi", "event_type", "region_id", "event_ts"))
    return flow.running_stays(flow.stay_deltas(stays))


@_query
def stay_total(spark, sf_dir):
    totals = flow.stay_totals(flow.stay_deltas(_stay_events(spark, sf_dir)))
    return totals.select("region_id", "stay_count")


def _in_loads(spark, sf_dir, n):
    """The placed signals cut into ``n`` loads of equal time, and the heavy subscribers."""
    heavy = _heavy(spark, sf_dir)
    placed = _flow(spark, sf_dir, heavy)
    first, last = inputs.signal(spark, sf_dir).agg(F.min("event_ts"), F.max("event_ts")).first()
    if first is None:
        return [placed], heavy[0]
    borders = [first + (last - first) * i / n for i in range(1, n)]
    ts, out = F.col("event_ts"), []
    for low, high in zip([None, *borders], [*borders, None]):
        part = placed if low is None else placed.where(ts > F.lit(low).cast("timestamp"))
        out.append(part if high is None else part.where(ts <= F.lit(high).cast("timestamp")))
    return out, heavy[0]


EVENT_COLUMNS = ("imsi", "event_type", "region_id", "gender", "age", "event_ts")


@_query
def visits_by_load(spark, sf_dir):
    """Enter, leave and stay events of three loads run apart, one of them twice.

    Each load sees its own signals and the visits that the load before left open.
    """
    path = work_folder(spark)
    loads, heavy = _in_loads(spark, sf_dir, 3)
    targets = inputs.target_region(spark, sf_dir)
    for n in [i for i in range(len(loads)) for _ in range(2 if i == 1 else 1)]:
        batch.build_visits(loads[n], path, n, n - 1 if n else None, STAY_MS, targets, heavy)
    kinds = [spark.read.parquet(f"{path}/{kind}_events").select(*EVENT_COLUMNS) for kind in ("flow", "stay")]
    return kinds[0].unionByName(kinds[1])


# ---- live operators as streams -----------------------------------------------------------------


def _replay(spark, sf_dir, start, beyond="0 seconds", since=None):
    """Run a bounded stream to its very end; returns the folder it wrote to. ``since`` leaves out
    the signals up to a time.

    ``start(placed, folder)`` starts a query on the placed signals. It runs once over all signals.
    Then one row of an unknown subscriber and cell arrives, so far in the future that the watermark
    passes the newest signal by ``beyond`` and a millisecond, and the query, continued from its
    checkpoint, releases what still waited. The inner joins drop that row.
    """
    folder = work_folder(spark)
    signals = inputs.signal(spark, sf_dir)
    signals.limit(0).write.parquet(f"{folder}/end")
    live_signals = inputs.signal_stream(spark, sf_dir)
    if since is not None:
        live_signals = live_signals.where(F.col("event_ts") > F.lit(since).cast("timestamp"))
    stream = live_signals.unionByName(streams.file_table(spark, f"{folder}/end", signals.schema))
    placed = live.user_region_flow(
        stream, inputs.user_info(spark, sf_dir), _cells(spark, sf_dir), WATERMARK_DELAY
    )
    start(placed, folder).awaitTermination()
    after = F.max("event_ts") + F.expr(
        f"INTERVAL {WATERMARK_DELAY} + INTERVAL {beyond} + INTERVAL '0.001' SECOND"
    )
    end = signals.agg(F.date_trunc("millisecond", after).alias("event_ts"))
    # Not null, as rows of null keys are filtered before they reach the watermark.
    unknown = {"imsi": F.lit(""), "laccell": F.lit("")}
    end.select(
        *[
            (F.col(f.name) if f.name == "event_ts" else unknown.get(f.name, F.lit(-1)).cast(f.dataType)).alias(f.name)
            for f in signals.schema
        ]
    ).write.mode("append").parquet(f"{folder}/end")
    start(placed, folder).awaitTermination()
    return folder


def _run_visits(spark, sf_dir):
    def start(placed, folder):
        return writers.start_visits(
            placed,
            inputs.target_region(spark, sf_dir),
            STAY_MS,
            f"{folder}/tables",
            f"{folder}/checkpoint",
            availableNow=True,
        )

    return f"{_replay(spark, sf_dir, start)}/tables"


@_query
def stream_visit_events(spark, sf_dir):
    """Enter, leave and stay events as the stateful stream query writes them."""
    out = _run_visits(spark, sf_dir)
    names = ("imsi", "event_type", "region_id", "gender", "age", "event_ts")
    kinds = [spark.read.parquet(f"{out}/{kind}_events").select(*names) for kind in ("flow", "stay")]
    return kinds[0].unionByName(kinds[1])


@_query
def stream_reject_count(spark, sf_dir):
    """Good and bad lines of three streams of text, by the tables of their micro-batches."""
    folder, found = work_folder(spark), []
    feeds = {
        "signal": (inputs.signal_lines, lines.parse_signal),
        "user_info": (inputs.user_lines, lines.parse_user_info),
        "region_cell": (inputs.cell_lines, lines.parse_region_cell),
    }
    for name, (feed, parse) in feeds.items():
        feed(spark, sf_dir).select("line").repartition(4).write.text(f"{folder}/{name}/in")
        text = streams.file_lines(spark, f"{folder}/{name}/in", files_per_trigger=1)
        writers.start_parsed(
            parse(text), f"{folder}/{name}/out", f"{folder}/{name}/checkpoint", availableNow=True
        ).awaitTermination()
        counts = writers.stored_counts(spark, f"{folder}/{name}/out")
        found.append(counts.select(F.lit(name).alias("input"), "n_ok", "n_rejected"))
    counts = found[0].unionByName(found[1]).unionByName(found[2])
    return counts.groupBy("input").agg(*[F.sum(n).alias(n) for n in ("n_ok", "n_rejected")])


@_query
def stream_running_stays(spark, sf_dir):
    """Long stays per region after every change, as two chained stateful steps write them."""

    def start(placed, folder):
        return writers.start_running_stays(
            placed,
            inputs.target_region(spark, sf_dir),
            STAY_MS,
            f"{folder}/running",
            f"{folder}/checkpoint",
            availableNow=True,
        )

    out = f"{_replay(spark, sf_dir, start)}/running"
    return spark.read.parquet(out).drop("batch_id")


@_query
def stream_open_visits(spark, sf_dir):
    """Who is in a watched region at the end of the stream, read from the tracker's own state."""
    out = _run_visits(spark, sf_dir).removesuffix("/tables")
    return visits.current_visits(spark, f"{out}/checkpoint", STAY_MS).select("imsi", "region_id", "enter_ts")


@_query
def stream_from_history(spark, sf_dir):
    """A batch load over the first half of the time, and a stream that goes on from its open visits."""
    folder = work_folder(spark)
    loads, heavy = _in_loads(spark, sf_dir, 2)
    targets = inputs.target_region(spark, sf_dir)
    batch.build_visits(loads[0], folder, 0, None, STAY_MS, targets, heavy)
    carried = batch.read_carried(spark, folder, 0)
    since = loads[0].agg(F.max("event_ts")).first()[0]

    def start(placed, out):
        return writers.start_visits(
            placed,
            targets,
            STAY_MS,
            f"{out}/tables",
            f"{out}/checkpoint",
            opened=visits.open_visits(carried, targets, STAY_MS),
            availableNow=True,
        )

    out = f"{_replay(spark, sf_dir, start, since=since)}/tables"
    parts = [f"{folder}/flow_events", f"{folder}/stay_events", f"{out}/flow_events", f"{out}/stay_events"]
    kinds = [spark.read.parquet(part).select(*EVENT_COLUMNS) for part in parts]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])


@_query
def stream_stay_totals(spark, sf_dir):
    """Stay totals as the stream query keeps them."""
    return writers.read_totals(spark, f"{_run_visits(spark, sf_dir)}/stay_totals")


@_query
def stream_persona_windows(spark, sf_dir):
    """Audience windows as the stream query writes them; a later row ends the last window too."""

    def start(placed, folder):
        return writers.start_persona_log(
            placed, PERSONA_WINDOW, f"{folder}/windows", f"{folder}/checkpoint", availableNow=True
        )

    folder = _replay(spark, sf_dir, start, PERSONA_WINDOW)
    return spark.read.parquet(f"{folder}/windows").drop("batch_id", "window_end")


# ---- stored tables -----------------------------------------------------------------------------


@_query
def stored_region_hours(spark, sf_dir):
    """Two overlapping loads into the stored hours, one of them twice: every member is there."""
    folder = work_folder(spark)
    batch.build_user_index(inputs.user_info(spark, sf_dir), f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    signals, cells = inputs.signal(spark, sf_dir), inputs.region_cell(spark, sf_dir)
    loads = {"a": F.col("event_id") % 3 != 0, "b": F.col("event_id") % 3 != 1}
    for load in ("a", "b", "a"):
        batch.build_region_hours(
            signals.where(loads[load]), cells, index, f"{folder}/hours", load, write=sink.overwrite_load
        )
    return sink.read_hours(spark, f"{folder}/hours")


@_query
def stored_index_extended(spark, sf_dir):
    """The stored user index after a second load that brings unknown subscribers."""
    path = f"{work_folder(spark)}/index"
    batch.build_user_index(inputs.user_info(spark, sf_dir), path)
    batch.build_user_index(inputs.signal(spark, sf_dir), path, spark.read.parquet(path))
    return spark.read.parquet(path).select("imsi", "bitmap_id")


@_query
def stored_index_buckets(spark, sf_dir):
    """The bucketed user index after two loads, the second of them twice."""
    index = IndexTable(spark, f"{work_folder(spark)}/index", buckets=16)
    index.load(inputs.user_info(spark, sf_dir), "users")
    for _ in range(2):
        index.load(inputs.signal(spark, sf_dir), "signals")
    return index.read()


@_query
def stored_portraits(spark, sf_dir):
    """Sizes of the stored portraits; the second build replaces the first."""
    folder = work_folder(spark)
    users = inputs.all_users(spark, sf_dir)
    batch.build_user_index(users, f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    for _ in range(2):
        batch.build_portraits(users, index, f"{folder}/portraits")
    return portraits.portrait_sizes(spark.read.parquet(f"{folder}/portraits"))


@_query
def stored_latest_events(spark, sf_dir):
    """The newest events of a region from the stored log of the stream, laid out for serving."""
    out = _run_visits(spark, sf_dir)
    sink.compact_events(spark.read.parquet(f"{out}/flow_events"), f"{out}/flow_by_day")
    return serving.latest_events(sink.read_events(spark, f"{out}/flow_by_day"), REGION, NEWEST)


@_query
def stored_newest_events(spark, sf_dir):
    """The newest events of a region from a log that took all of them in 8 batches, by levels."""
    events = materialise(_flow_events(spark, sf_dir))
    log = EventLog(spark, f"{work_folder(spark)}/log", fanout=4)
    part = F.pmod(F.xxhash64("imsi", "event_ts"), F.lit(8))
    for n in range(8):
        log.append(events.where(part == n), n)
    found = log.newest(REGION, NEWEST, "imsi", "event_type")
    return found.select("imsi", "gender", "age", "event_ts", "event_type")


@_query
def stored_region_portrait(spark, sf_dir):
    """The current portraits as the stream keeps them, with the regions' names."""

    def start(placed, folder):
        return writers.start_persona(
            placed, PERSONA_WINDOW, f"{folder}/current", f"{folder}/checkpoint", availableNow=True
        )

    folder = _replay(spark, sf_dir, start, PERSONA_WINDOW)
    schema = _persona(spark, sf_dir).schema
    current = sink.read_current(spark, f"{folder}/current", schema).drop("window_end")
    return serving.region_portrait(current, _centers(spark, sf_dir))


@_query
def stored_keyed_portraits(spark, sf_dir):
    """Current portraits after 20 micro-batches of windows in no order, and two compactions."""
    windows = materialise(_persona(spark, sf_dir).drop("window_end"))
    table = KeyedTable(spark, f"{work_folder(spark)}/keyed", windows.schema, ["region_id"], "window_start")
    part = F.pmod(F.xxhash64("region_id", "window_start"), F.lit(20))
    for n in range(20):
        table.put(windows.where(part == n), n, open_deltas=8)
    return serving.region_portrait(table.read(), _centers(spark, sf_dir))


@_query
def stored_text_heatmap(spark, sf_dir):
    """Heat map totals over counters that a keyed store gives as text, some of them no numbers."""
    path = f"{work_folder(spark)}/text"
    names = serving.TOTALLED
    rows = _current(spark, sf_dir)
    broken = F.when(F.col("region_id") == REGION, "n/a").otherwise(F.col("man").cast("string"))
    texts = rows.select("region_id", *[F.col(n).cast("string").alias(n) for n in names if n != "man"], broken.alias("man"))
    sink.overwrite(texts, path)
    return serving.heatmap_totals(serving.numeric_cells(spark.read.parquet(path), names))


@_query
def served_by_parameters(spark, sf_dir):
    """One answer through a SQL text with named parameters over the stored hours."""
    folder = work_folder(spark)
    index = _index(spark, sf_dir)
    batch.build_region_hours(
        inputs.signal(spark, sf_dir),
        inputs.region_cell(spark, sf_dir),
        index,
        f"{folder}/hours",
        "all",
        write=sink.overwrite_load,
    )
    view = f"hours_{folder.rpartition('-')[2]}"
    tables.register(**{view: sink.read_hours(spark, f"{folder}/hours")})
    return tables.query(
        spark,
        f"SELECT bitmap_id FROM {view} WHERE region_id = :region AND produce_hour = :hour",
        region=REGION,
        hour=HOUR,
    )


# ---- serving: regions --------------------------------------------------------------------------


def _centers(spark, sf_dir):
    parsed = lines.accepted(lines.parse_region_center(inputs.region_center_lines(spark, sf_dir)))
    return latest.last_per_key(
        parsed.select("region_id", "name", "center", "boundary", "line_no"),
        ["region_id"],
        "line_no",
    )


def _current(spark, sf_dir):
    return serving.current_persona(_persona(spark, sf_dir).drop("window_end"))


@_query
def region_portrait(spark, sf_dir):
    return serving.region_portrait(_current(spark, sf_dir), _centers(spark, sf_dir))


@_query
def region_stay_total(spark, sf_dir):
    return serving.region_stay_total(
        flow.stay_totals(flow.stay_deltas(_stay_events(spark, sf_dir))), REGION
    )


@_query
def latest_flow_events(spark, sf_dir):
    return serving.latest_events(_flow_events(spark, sf_dir), REGION, NEWEST)


@_query
def latest_stay_detail(spark, sf_dir):
    return serving.latest_events(_stay_events(spark, sf_dir), REGION, NEWEST)


@_query
def latest_per_region(spark, sf_dir):
    return serving.latest_events_per_region(_flow_events(spark, sf_dir), NEWEST)


@_query
def heatmap_totals(spark, sf_dir):
    return serving.heatmap_totals(_current(spark, sf_dir))


@_query
def heatmap_regions(spark, sf_dir):
    return serving.center_columns(
        serving.heatmap_regions(_current(spark, sf_dir), _centers(spark, sf_dir))
    )


@_query
def heatmap_flat(spark, sf_dir):
    return serving.center_columns(
        serving.heatmap_flat(_current(spark, sf_dir), _centers(spark, sf_dir))
    )


# ---- region lists ------------------------------------------------------------------------------


def _region_list(spark, sf_dir):
    parts = C.fields("line")
    listed = inputs.cell_lines(spark, sf_dir).select(
        F.col("line_no").alias("seq"), F.trim(C.field(parts, 0)).alias("region_id")
    )
    return sampling.drop_adjacent_repeats(listed, "seq", "region_id")


@_query
def adjacent_dedup_regions(spark, sf_dir):
    return _region_list(spark, sf_dir)


@_query
def sample_regions(spark, sf_dir):
    return sampling.uniform_sample(
        _region_list(spark, sf_dir), SAMPLE, ["seq", "region_id"], seed=7
    )
