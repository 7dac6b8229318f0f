"""Per-client request rates: sliding counts, session breadth, the rate verdict.

Counts come from ranks, not from sliding frames: a RANGE frame re-reads the whole
frame for every row, which is quadratic for a flooding client. The rank of an
event minus the rank of the instant one window earlier is the same number.

Rows go to their client once, where frames that only grow rank them. Clients of more than
BUSY requests, at most one per BUSY rows of the input, are too long for one task's pass;
they take the way below, with the same results.

There, everything but the last join runs over cells (client, microsecond, arrival
chunk). Cells are combined map-side, so even a third of all rows on one client
and one instant shrinks to one row per CHUNK arrivals before it is shuffled.

Ranks have two levels. A client's time is cut into spans, a SPANS-th of the shortest
of its windows; a timeline carries totals from span to span, and what happens inside
a span is ordered there. A flood of one client in one window so spreads over SPANS
tasks, and the timeline has a row per active span, however many requests that has.
Nothing is written or cut: the timeline's exchanges are shared by what reads it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from reqlens.config import DEFAULTS, Settings

BUSY = 100_000  # requests of a client, beyond which its time is cut into spans
CHUNK = 65_536
SPANS = 60   # of the shortest window
GROUP = 64   # spans that are carried together
SECOND = 1_000_000
KEYS = ("_client", "_us", "_chunk")


def _keyed(df: DataFrame, client: str, ts: str, arrival: str) -> DataFrame:
    # Join keys are never NULL, so no request is lost: one without a client counts
    # as "unknown", one without a time as the epoch.
    place = F.coalesce(F.col(arrival).cast("bigint"), F.lit(-1))
    return df.withColumns({
        "_client": F.coalesce(F.col(client), F.lit("unknown")),
        "_us": F.coalesce(F.unix_micros(ts), F.lit(0)), "_arrival": place,
        "_chunk": F.floor(place / CHUNK).cast("bigint")})


def _grains(rows: DataFrame, template: str) -> DataFrame:
    name = F.coalesce(F.col(template), F.lit("/")).alias("_template")
    return rows.groupBy(*KEYS, name).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_arrival").alias("_first"))


def _span(us: Column, width: int) -> Column:
    return F.floor(us / width).cast("bigint")


def _walked(spans: Column, start: Column, step) -> Column:
    """Folds an array of at most GROUP spans; step(acc, span) gives the new fields and the
    row that is put out."""
    def merge(acc, s):
        fields, row = step(acc, s)
        return F.struct(*fields, F.concat(acc["out"], F.array(row)).alias("out"))
    return F.aggregate(spans, start, merge)


def _timeline(cells: DataFrame, probes: dict[str, int], width: int,
              gap_us: int) -> DataFrame:
    """A row per span in which a client has events or a probe looks: `_before`, the events
    of earlier spans, and `_start`, where the session that runs in it began.

    Spans are shorter than a session's gap, so only the first event of a span can start one.
    Per client, GROUP spans are one row of the only ordered pass.
    """
    us, nothing = F.col("_us"), F.lit(None).cast("bigint")

    def mark(span, n, at):
        return F.struct(span.alias("_span"), n.cast("bigint").alias("n"), at.alias("at"))
    marks = [mark(_span(us, width), F.col("_n"), us)]
    marks += [mark(_span(us - back, width), F.lit(0), nothing) for back in probes.values()]
    spans = cells.select("_client", F.explode(F.array(*marks)).alias("m")).select("_client", "m.*").groupBy(
        "_client", "_span").agg(F.sum("n").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    groups = spans.groupBy("_client", _span(F.col("_span"), GROUP).alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct("_span", "n", "lo", "hi"))).alias("spans"),
        F.sum("n").alias("n"), F.max("hi").alias("hi"))
    earlier = Window.partitionBy("_client").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_client", "_group", "spans", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"),
                           F.max("hi").over(earlier).alias("hi"))

    def step(acc, s):
        starts = (s["n"] > 0) & (acc["hi"].isNull() | (s["lo"] - acc["hi"] >= gap_us))
        start = F.when(starts, s["lo"]).otherwise(acc["start"])
        return [(acc["n"] + s["n"]).alias("n"), F.greatest(acc["hi"], s["hi"]).alias("hi"), start.alias("start")], F.struct(
            s["_span"].alias("_span"), acc["n"].alias("_before"), start.alias("_start"))
    begin = F.struct("n", "hi", nothing.alias("start"),
                     F.array().cast("array<struct<_span:bigint,_before:bigint,_start:bigint>>").alias("out"))
    groups = groups.select("_client", "_group", _walked(F.col("spans"), begin, step).alias("w"))
    carried = F.last("w.start", ignorenulls=True).over(earlier)
    groups = groups.withColumn("_carried", carried)
    return groups.select("_client", "_carried", F.inline("w.out")).withColumn(
        "_start", F.coalesce("_start", "_carried")).drop("_carried")


def _ranks(cells: DataFrame, probes: dict[str, int], timeline: DataFrame, width: int) -> DataFrame:
    """Per cell: `_before`, a rank, and per probe the rank that many microseconds
    ago. Differences of the two count the events in between."""
    def mark(at, kind, n):
        return F.struct(_span(at, width).alias("_span"), at.alias("_at"), F.lit(kind).alias("_kind"),
                        n.cast("bigint").alias("_add"))
    marks = [mark(F.col("_us"), 0, F.col("_n"))]
    marks += [mark(F.col("_us") - back, i + 1, F.lit(0)) for i, back in enumerate(probes.values())]
    marks = cells.select(*KEYS, F.explode(F.array(*marks)).alias("m")).select(*KEYS, "m.*")
    # Events sort before probes of the same instant: a probe counts them.
    so_far = Window.partitionBy("_client", "_span").orderBy("_at", "_kind", "_chunk").rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = marks.join(timeline.select("_client", "_span", "_before"), ["_client", "_span"]).withColumn(
        "_rank", F.col("_before") + F.sum("_add").over(so_far))
    own = F.col("_kind") == 0
    return ranked.groupBy(*KEYS).agg(
        F.max(F.when(own, F.col("_rank") - F.col("_add"))).alias("_before"),
        *[F.max(F.when(F.col("_kind") == i + 1, F.col("_rank"))).alias(name)
          for i, name in enumerate(probes)])


def _attach(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Joins cell values to rows and adds each row's place within its cell. The
    window and the join share keys, so wide rows shuffle once."""
    place = Window.partitionBy(*KEYS).orderBy("_arrival")
    return rows.withColumn("_place", F.row_number().over(place)).join(cells, list(KEYS))


def _tidy(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _count_columns(df: DataFrame) -> DataFrame:
    rank = F.col("_before") + F.col("_place")
    return df.withColumns({"window_count": rank - F.col("_w_old"),
                           "burst_count": rank - F.col("_b_old")})


def _count_probes(settings: Settings) -> dict[str, int]:
    return {"_w_old": settings.window_seconds * SECOND, "_b_old": settings.burst_seconds * SECOND}


def _width(settings: Settings) -> int:
    return max(1, min(settings.window_seconds, settings.session_gap_seconds) * SECOND // SPANS)


def _by_load(rows: DataFrame, whole, cut, prepare=None) -> DataFrame:
    """whole(rows) of clients up to BUSY requests, cut(rows) of the others. `prepare` runs
    on each part behind the split, so no row takes it twice."""
    busy = F.broadcast(rows.groupBy("_client").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > BUSY).select("_client"))
    few, many = (rows.join(busy, "_client", how) for how in ("left_anti", "left_semi"))
    if prepare is not None:
        few, many = prepare(few), prepare(many)
    return _tidy(whole(few)).unionByName(_tidy(cut(many)))


def _line() -> WindowSpec:
    return Window.partitionBy("_client").orderBy("_us", "_arrival")


def _counted(rows: DataFrame, settings: Settings) -> DataFrame:
    """window_count and burst_count by frames that only grow: a client's rank less the
    events up to one window earlier."""
    rows = rows.withColumn("_rank", F.row_number().over(_line()).cast("bigint"))
    times = Window.partitionBy("_client").orderBy("_us")
    old = {name: F.count(F.lit(1)).over(times.rangeBetween(Window.unboundedPreceding, -back))
           for name, back in _count_probes(settings).items()}
    return rows.withColumns(old).withColumns({
        "window_count": F.col("_rank") - F.col("_w_old"), "burst_count": F.col("_rank") - F.col("_b_old")})


def _visited(rows: DataFrame, settings: Settings, template: str) -> DataFrame:
    """session_start and window_distinct: a template is new if it was last seen before the
    session's start. Requests of one instant and arrival see each other's templates."""
    us, line = F.col("_us"), _line()
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_template", F.coalesce(F.col(template), F.lit("/")))
    rows = rows.withColumn("_seen", F.lag("_us").over(
        Window.partitionBy("_client", "_template").orderBy("_us", "_arrival")))
    rows = rows.withColumn("_last", F.lag("_us").over(line))
    opens = F.col("_last").isNull() | (us - F.col("_last") >= settings.session_gap_seconds * SECOND)
    rows = rows.withColumn("_opens", opens).withColumn("_start", F.max(F.when(F.col("_opens"), us)).over(so_far))
    rows = rows.withColumn("_new", F.when(F.coalesce(F.col("_seen") >= F.col("_start"), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumns({
        "_known": F.sum("_new").over(so_far),
        "_total": F.sum("_new").over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    rows = rows.withColumn("_base", F.max(F.when(F.col("_opens"), F.col("_known") - 1)).over(so_far))
    return rows.withColumns({"session_start": F.timestamp_micros("_start"),
                             "window_distinct": F.col("_total") - F.col("_base")})


def sliding_counts(df: DataFrame, settings: Settings = DEFAULTS, client="client", ts="ts",
                   arrival="event_id") -> DataFrame:
    """Adds window_count and burst_count: the client's requests in the half-open
    spans (t - window, t] and (t - burst, t], in arrival order, itself included.
    `arrival` is an integer that orders requests of the same instant."""
    def cut(rows):
        cells = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
        probes, width = _count_probes(settings), _width(settings)
        timeline = _timeline(cells, probes, width, settings.session_gap_seconds * SECOND)
        return _count_columns(_attach(rows, _ranks(cells, probes, timeline, width)))
    return _by_load(_keyed(df, client, ts, arrival), lambda rows: _counted(rows, settings), cut)


def _known_before(spans: DataFrame) -> DataFrame:
    """Of (_client, _start, _span, _fresh: templates first seen there): `_known`, those of
    the session's earlier spans. GROUP spans are one row of the ordered pass."""
    groups = spans.groupBy("_client", "_start", _span(F.col("_span"), GROUP).alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct("_span", "_fresh"))).alias("spans"), F.sum("_fresh").alias("n"))
    earlier = Window.partitionBy("_client", "_start").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    begin = F.struct("n", F.array().cast("array<struct<_span:bigint,_known:bigint>>").alias("out"))
    walked = _walked(F.col("spans"), begin, lambda acc, s: ([(acc["n"] + s["_fresh"]).alias("n")], F.struct(
        s["_span"].alias("_span"), acc["n"].alias("_known"))))
    return groups.select("_client", "_start", F.inline(walked["out"]))


def _sessions(grains: DataFrame, cells: DataFrame, timeline: DataFrame, width: int) -> DataFrame:
    """Per cell the session's start, the number of templates seen in it before the cell, and
    the arrivals that bring a new one."""
    timeline = timeline.filter("_start IS NOT NULL").select("_client", "_span", "_start")
    span = _span(F.col("_us"), width).alias("_span")
    # First sighting of each template per session; at most one row per pair.
    firsts = (grains.select("*", span).join(timeline, ["_client", "_span"])
              .groupBy("_client", "_start", "_template")
              .agg(F.min(F.struct("_us", "_chunk", "_first", "_span")).alias("f"))
              .select("_client", "f.*"))
    new = firsts.groupBy(*KEYS).agg(  # bounded: a cell has at most CHUNK distinct arrivals
        F.count(F.lit(1)).alias("_new"), F.collect_list("_first").alias("_new_at"))
    fresh = firsts.groupBy("_client", "_span").agg(F.count(F.lit(1)).alias("_fresh"))
    known = _known_before(timeline.join(fresh, ["_client", "_span"], "left").withColumn(
        "_fresh", F.coalesce("_fresh", F.lit(0).cast("bigint"))))
    inside = Window.partitionBy("_client", "_span").orderBy("_us", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    found = cells.select(*KEYS, span).join(new, list(KEYS), "left").join(known, ["_client", "_span"])
    return found.withColumn("_known", F.col("_known") + F.coalesce(F.sum("_new").over(inside), F.lit(0))).drop(
        "_new", "_span")


def _session_columns(df: DataFrame) -> DataFrame:
    fresh = F.size(F.filter("_new_at", lambda a: a <= F.col("_arrival")))
    return df.withColumns({
        "session_start": F.timestamp_micros("_start"),
        "window_distinct": F.col("_known") + F.when(
            F.col("_new_at").isNotNull(), fresh).otherwise(0)})


def session_distinct(df: DataFrame, settings: Settings = DEFAULTS, client="client", ts="ts",
                     template="template", arrival="event_id") -> DataFrame:
    """Adds session_start and window_distinct: distinct templates the client has
    touched since its last pause of session_gap_seconds or more, exactly."""
    def cut(rows):
        grains = _grains(rows, template)
        cells = grains.groupBy(*KEYS).agg(F.sum("_n").alias("_n"))
        width = _width(settings)
        timeline = _timeline(cells, {}, width, settings.session_gap_seconds * SECOND)
        return _session_columns(_attach(rows, _sessions(grains, cells, timeline, width)))
    return _by_load(_keyed(df, client, ts, arrival), lambda rows: _visited(rows, settings, template), cut)


def rate_verdict(settings: Settings = DEFAULTS, window="window_count",
                 burst="burst_count") -> tuple[Column, Column]:
    """(rate_limited, rate_reason); the burst limit is checked first."""
    over_burst = F.col(burst) > settings.burst_limit
    over_window = F.col(window) > settings.window_limit
    reason = (
        F.when(over_burst, F.format_string(
            f"burst limit exceeded: %d requests in {settings.burst_seconds}s "
            f"(limit {settings.burst_limit})", F.col(burst).cast("bigint")))
        .when(over_window, F.format_string(
            f"rate limit exceeded: %d requests in {settings.window_seconds}s "
            f"(limit {settings.window_limit})", F.col(window).cast("bigint")))
        .otherwise(""))
    return F.coalesce(over_burst | over_window, F.lit(False)), reason


def with_verdict(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    limited, reason = rate_verdict(settings)
    return df.withColumns({"rate_limited": limited, "rate_reason": reason})


def rate_state(df: DataFrame, settings: Settings = DEFAULTS, client="client", ts="ts",
               template="template", arrival="event_id", prepare=None) -> DataFrame:
    """All rate columns at once: counts, session breadth and the verdict. `prepare` maps the
    rows, keeping those that the rates need, before they are shuffled."""
    def cut(rows):
        grains = _grains(rows, template)
        cells = grains.groupBy(*KEYS).agg(F.sum("_n").alias("_n"))
        probes, width = _count_probes(settings), _width(settings)
        timeline = _timeline(cells, probes, width, settings.session_gap_seconds * SECOND)
        found = _ranks(cells, probes, timeline, width).join(_sessions(grains, cells, timeline, width), list(KEYS))
        return _count_columns(_session_columns(_attach(rows, found)))
    rated = _by_load(_keyed(df, client, ts, arrival),
                     lambda rows: _counted(_visited(rows, settings, template), settings), cut, prepare)
    return with_verdict(rated, settings)


def without_counters(df: DataFrame) -> DataFrame:
    """Counters unavailable: zeros, never limited, and marked degraded."""
    return df.withColumns({
        "window_count": F.lit(0).cast("bigint"), "burst_count": F.lit(0).cast("bigint"),
        "window_distinct": F.lit(0).cast("bigint"), "rate_limited": F.lit(False),
        "rate_reason": F.lit(""), "rate_degraded": F.lit(True)})
