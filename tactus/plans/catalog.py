"""Name -> query and name -> oracle SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.functions import columns as fn
from tactus.operators import hmm, manifest, nearest, parity, peaks, quantiles, rollup, score, segments, signal, sound, stems
from tactus.operators.tempo import tempo_candidates
from tactus.session import fresh_path
from tactus.sources import arrays, audio, cache, sinks, store, waves
from tactus.streaming import guard, incremental, sink
from tactus.streaming import islands as islands_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Register the decorated function under its own name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
TYPES = ["click", "error", "purchase", "signup", "view"]
PAST, FUTURE = 12, 6

# Parts that the oracles share.
FRAMES = """frames as (select user_id, event_id, event_type, value, props, ts,
    date_diff('microsecond', timestamp '2024-01-01', ts) as us,
    row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events)"""
STRENGTH = f"""{FRAMES}, strengths as (select user_id, frame, event_type, value, case when value > 0 and value = max(value) over (partition by user_id
    order by frame rows between {PAST} preceding and {FUTURE} following) then value - (
    coalesce(sum(value) over (partition by user_id order by frame rows between {PAST} preceding and 1 preceding), 0) / {PAST} +
    coalesce(sum(value) over (partition by user_id order by frame rows between 1 following and {FUTURE} following), 0) / {FUTURE}) / 2
    else 0 end as strength from frames)"""
SEGMENTED = f"""{STRENGTH}, segmented as (select *, cast(sum(case when strength > 0 and frame > 0 then 1 else 0 end) over
    (partition by user_id order by frame rows unbounded preceding) as bigint) as segment from strengths)"""
FLAGGED = f"""{FRAMES}, edges as (select *, value >= 50 as hot, case when value >= 50 and not coalesce(lag(value >= 50) over
    (partition by user_id order by frame), false) then 1 else 0 end as enters from frames),
    flagged as (select *, cast(sum(enters) over (partition by user_id order by frame rows unbounded preceding) as bigint) as island from edges)"""


def frames(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    us = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col("ts")).alias("us")
    return peaks.frame_numbers(events.select("*", us), "user_id", "ts", "event_id")


def strengths(spark, sf_dir):
    return peaks.peak_strength(frames(spark, sf_dir), "user_id", "frame", "value", PAST, FUTURE)


def segmented(spark, sf_dir):
    return segments.segment_ids(strengths(spark, sf_dir), "user_id", "frame", F.col("strength") > 0)


def r6(name):
    return F.round(name, 6).alias(name)


# --- tempo

TEMPO = """gaps as (select user_id, date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) as gap from events),
    beats as (select user_id, cast(round_even(60 * 3600e6 / gap, 0) as bigint) as bpm from gaps where gap > 0),
    votes as (select user_id, bpm, count(*) as votes from beats group by all)"""


def _tempo(spark, sf_dir):
    """Events of a user as beats, the hour as the minute."""
    return tempo_candidates(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.lit(60 * 3600e6), micros=True)


@query(f"with {TEMPO} select user_id, bpm, votes from votes qualify row_number() over (partition by user_id order by votes desc, bpm desc) = 1")
def tempo_mode(spark, sf_dir):
    return _tempo(spark, sf_dir).where("rank = 1").select("user_id", "bpm", "votes")


@query(f"""with {TEMPO} select user_id, bpm, round(votes / sum(votes) over (partition by user_id), 6) as share,
    row_number() over (partition by user_id order by votes desc, bpm desc) as rank from votes""")
def tempo_shares(spark, sf_dir):
    return _tempo(spark, sf_dir).select("user_id", "bpm", r6("share"), F.col("rank").cast("bigint").alias("rank"))


# --- peaks and segments


@query(f"with {STRENGTH} select user_id, frame, round(strength, 6) as strength from strengths")
def peak_strength(spark, sf_dir):
    return strengths(spark, sf_dir).select("user_id", "frame", r6("strength"))


@query(f"with {STRENGTH} select user_id, frame, frame * 441 / 44100 as seconds from strengths where strength > 0")
def boundaries(spark, sf_dir):
    return strengths(spark, sf_dir).where("strength > 0").select("user_id", "frame", segments.seconds(F.col("frame")).alias("seconds"))


@query(f"""with {FRAMES} select user_id, frame, case when value = max(value) over (partition by user_id order by frame
    rows between 3 preceding and 3 following) then value else 0 end as kept from frames""")
def local_max_window(spark, sf_dir):
    return peaks.local_maxima(frames(spark, sf_dir), "user_id", "frame", "value", 7).select("user_id", "frame", "kept")


@query(f"""with {FRAMES} select user_id, frame from frames qualify value > max(value) over (partition by user_id order by frame rows between 2 preceding and 1 preceding)
    and value > max(value) over (partition by user_id order by frame rows between 1 following and 2 following)""")
def local_max_strict(spark, sf_dir):
    return peaks.strict_maxima(frames(spark, sf_dir), "user_id", "frame", "value", 2).where("is_peak").select("user_id", "frame")


@query(f"""with {SEGMENTED} select user_id, segment, min(frame) as "start", max(frame) + 1 as "end" from segmented group by all""")
def segment_intervals(spark, sf_dir):
    return segments.segments(segmented(spark, sf_dir), "user_id", "frame")


@query(f"""with {SEGMENTED}, counted as (select user_id, segment, event_type, count(*) as n from segmented group by all)
    select user_id, segment, event_type as label from counted qualify row_number() over (partition by user_id, segment order by n desc, event_type) = 1""")
def segment_labels(spark, sf_dir):
    one_hot = segmented(spark, sf_dir).withColumns({t: F.when(F.col("event_type") == t, 1.0).otherwise(0.0) for t in TYPES})
    labelled = segments.segment_labels(one_hot, "user_id", TYPES)
    return labelled.select("user_id", "segment", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("label_id") + 1).cast("int")).alias("label"))


@query(f"""with {SEGMENTED}, starts as (select user_id, segment, min(frame) as "start", count(*) as n from segmented group by all)
    select user_id, "start", lead("start", 1, total) over (partition by user_id order by "start") as "end" from
    (select *, cast(sum(n) over (partition by user_id) as bigint) as total from starts)""")
def interval_construction(spark, sf_dir):
    starts = segmented(spark, sf_dir).groupBy("user_id", "segment").agg(F.min("frame").alias("start"), F.count("*").alias("n"))
    whole = W.partitionBy("user_id")
    total = starts.withColumn("total", F.sum("n").over(whole))
    end = F.coalesce(F.lead("start").over(whole.orderBy("start")), F.col("total"))
    return total.select("user_id", "start", end.alias("end"))


@query(f"with {FLAGGED} select user_id, frame, island from flagged where hot")
def islands(spark, sf_dir):
    return segments.islands(frames(spark, sf_dir), "user_id", "frame", F.col("value") >= 50).select("user_id", "frame", "island")


@query(f"""with {FLAGGED} select user_id, island, min(frame) as "start", max(frame) + 1 as "end", cast(arg_max(frame, value * 1e6 - frame * 1e-3) as bigint) as peak
    from flagged where hot group by all""")
def island_peaks(spark, sf_dir):
    runs = segments.islands(frames(spark, sf_dir), "user_id", "frame", F.col("value") >= 50)
    return segments.island_peaks(runs, "user_id", "frame", F.col("value"))


@query(f"""with {FRAMES}, bounds as (select *, min(case when value >= 90 then frame end) over (partition by user_id) as f,
    max(case when value >= 90 then frame end) over (partition by user_id) as l from frames)
    select user_id, frame, value from bounds where frame between f and l""")
def threshold_trim(spark, sf_dir):
    return segments.threshold_trim(frames(spark, sf_dir), "user_id", "frame", F.col("value"), 90.0).select("user_id", "frame", "value")


# --- nearest

NEAREST = f"""{FRAMES}, deltas as (select c.user_id, c.us, c.event_id, p.us - c.us as delta from frames c join frames p on c.user_id = p.user_id
    where c.event_type = 'click' and p.event_type = 'purchase'
    qualify row_number() over (partition by c.event_id order by abs(p.us - c.us), p.us desc) = 1)"""


def _deltas(spark, sf_dir):
    f = frames(spark, sf_dir)
    return nearest.nearest_deltas(f.where("event_type = 'click'"), f.where("event_type = 'purchase'"), "user_id", "us")


@query(f"with {NEAREST} select user_id, us, delta from deltas")
def nearest_signed_delta(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query(f"""with {NEAREST} select user_id, count(*) as n, round(avg(delta), 3) as mean_signed, median(delta) as median_signed, median(abs(delta)) as median_abs,
    round(quantile_cont(abs(cast(delta as double)), 0.9), 3) as p90_abs, cast(max(abs(delta)) as double) as max_abs from deltas group by user_id""")
def delta_summary(spark, sf_dir):
    out = nearest.delta_summary(_deltas(spark, sf_dir), "user_id")
    return out.withColumns({c: F.round(c, 3) for c in ("mean_signed", "p90_abs")})


@query(f"""with {FRAMES} select p.user_id, p.us from frames p where p.event_type = 'purchase' and not exists (select 1 from frames c
    where c.user_id = p.user_id and c.event_type = 'click' and abs(c.us - p.us) <= 7200000000)""")
def near_duplicate_exclusion(spark, sf_dir):
    f = frames(spark, sf_dir)
    out = nearest.without_near(f.where("event_type = 'purchase'"), f.where("event_type = 'click'"), "user_id", "us", 7_200_000_000)
    return out.select("user_id", "us")


# --- rollups


@query("""select event_type as stage, user_id as track, grouping(user_id) = 0 as by_track, cast(round(sum(value), 4) as double) as total from events
    group by grouping sets ((event_type), (event_type, user_id))""")
def stage_rollup(spark, sf_dir):
    out = rollup.stage_totals(table(spark, sf_dir, "events"), "event_type", "user_id", F.col("value"))
    return out.withColumn("total", F.round("total", 4))


@query(f"""with {FRAMES}, named as (select *, case when event_type in ('click', 'view') then 'post' else event_type end as stage,
    case when event_type in ('click', 'view') then -1 else event_id end as k from frames)
    select user_id, stage, min(us) as "start", max(us + 1000) as "end", count(*) as "rows" from named group by user_id, stage, k""")
def stage_collapse(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("stop", F.col("us") + 1000)
    return rollup.collapse(f, "event_type", ["click", "view"], "post", "us", "stop", "user_id")


@query(f"""with {FRAMES} select user_id, us - min(us) over (partition by user_id) as since from frames where event_type not in ('error')""")
def rebased_timeline(spark, sf_dir):
    return rollup.rebased(frames(spark, sf_dir), "user_id", "us", ["error"], "event_type").select("user_id", "since")


# --- hidden Markov model

STEP = np.array([[0.0, -2.0, -3.0], [-3.0, 0.0, -2.0], [-2.0, -3.0, 0.0]])


VITERBI = f"""{FRAMES}, scored as (select user_id, frame, floor(value / 10) as s0, 3.0 as s1, 8 - floor(value / 10) as s2 from frames),
    walk(user_id, frame, d0, d1, d2, b0, b1, b2) as (select user_id, frame, s0, cast(s1 as double), s2, -1, -1, -1 from scored where frame = 0 union all
    select s.user_id, s.frame, greatest(d0, d1 - 3, d2 - 2) + s0, greatest(d0 - 2, d1, d2 - 3) + s1, greatest(d0 - 3, d1 - 2, d2) + s2,
    case when d0 >= d1 - 3 and d0 >= d2 - 2 then 0 when d1 - 3 >= d2 - 2 then 1 else 2 end,
    case when d0 - 2 >= d1 and d0 - 2 >= d2 - 3 then 0 when d1 >= d2 - 3 then 1 else 2 end,
    case when d0 - 3 >= d1 - 2 and d0 - 3 >= d2 then 0 when d1 - 2 >= d2 then 1 else 2 end
    from walk w join scored s on s.user_id = w.user_id and s.frame = w.frame + 1),
    ends as (select * from walk qualify row_number() over (partition by user_id order by frame desc) = 1),
    back(user_id, frame, state, score) as (select user_id, frame, case when d0 >= d1 and d0 >= d2 then 0 when d1 >= d2 then 1 else 2 end, greatest(d0, d1, d2) from ends union all
    select b.user_id, b.frame - 1, case b.state when 0 then w.b0 when 1 then w.b1 else w.b2 end, b.score from back b join walk w on w.user_id = b.user_id and w.frame = b.frame where b.frame > 0)"""


@query(f"with recursive {VITERBI} select user_id, frame, cast(state as bigint) as state, score from back")
def viterbi_small(spark, sf_dir):
    scores = [F.floor(F.col("value") / 10).cast("double"), F.lit(3.0), (F.lit(8) - F.floor(F.col("value") / 10)).cast("double")]
    f = frames(spark, sf_dir).select("user_id", "frame", *(s.alias(f"s{k}") for k, s in enumerate(scores)))
    return hmm.viterbi(f, "user_id", "frame", ["s0", "s1", "s2"], STEP)


@query()
def dbn_beats(spark, sf_dir):
    """Pseudo-activations: beats from values, downbeats from large ones; a small tempo range."""
    unit = F.least(F.greatest(F.col("value") / 200, F.lit(0.0)), F.lit(0.9))
    f = frames(spark, sf_dir).select("user_id", "frame", unit.alias("b"), (unit * unit).alias("d"))
    return hmm.beats(f, "user_id", "frame", "b", "d", (3, 4), 10, 0.05, 60, 200, 10)


LENGTHS = "lengths as (select unnest(range(28, 110)) as n)"
CHANGES = f"""{LENGTHS}, raw as (select a.n as from_n, b.n as to_n, exp(-100 * abs(b.n / a.n - 1)) as p from lengths a, lengths b),
    changes as (select from_n, to_n, p / sum(p) over (partition by from_n) as p from raw where p > 2.220446049250313e-16)"""


def _changes(spark):
    """The decoder's tempo transitions as a relation: 82 lengths each way."""
    lengths = np.arange(28, 110)
    p = hmm.length_changes(lengths, 100)
    rows = [(int(lengths[i]), int(lengths[j]), float(p[i, j])) for i, j in zip(*np.nonzero(p), strict=True)]
    return spark.createDataFrame(rows, "from_n bigint, to_n bigint, p double")


@query(f"with {CHANGES} select from_n, to_n, round(p, 9) as p from changes")
def tempo_transition(spark, sf_dir):
    return _changes(spark).withColumn("p", F.round("p", 9))


@query(f"""with {LENGTHS} select b as beat, n, k as place, case when k / n < 1 / 16 then case when b = 0 then 2 else 1 end else 0 end as density
    from lengths, unnest(range(0, 4)) as t(b), unnest(range(0, n)) as u(k)""")
def bar_state_space(spark, sf_dir):
    """The decoder's own states, beat by beat and length by length."""
    bar = hmm.Bar(4, np.arange(28, 110))
    n = np.tile(np.repeat(bar.lengths, bar.lengths), bar.beats)
    place = np.concatenate([np.arange(first, last + 1) - first for first, last in zip(bar.first, bar.last, strict=True)])
    rows = zip(bar.position.astype(int).tolist(), n.tolist(), place.tolist(), bar.column.tolist(), strict=True)
    return spark.createDataFrame(list(rows), "beat bigint, n bigint, place bigint, density int")


@query(f"""with {CHANGES}, edges as (select to_n as state, from_n as prev, round(sum(p), 9) as p from changes group by all)
    select state, prev, p, count(*) over (order by state, prev) as upto from edges""")
def sparse_edges(spark, sf_dir):
    edges = _changes(spark).groupBy(F.col("to_n").alias("state"), F.col("from_n").alias("prev")).agg(F.round(F.sum("p"), 9).alias("p"))
    return edges.withColumn("upto", F.count("*").over(W.orderBy("state", "prev").rowsBetween(W.unboundedPreceding, 0)))


# --- probabilities and arrays


@query("""with x as (select vec_id, unnest(embedding) as v, unnest(range(0, 64)) as i from embeddings),
    e as (select *, exp(cast(v as double) - max(cast(v as double)) over (partition by vec_id)) as w from x)
    select vec_id, i, round(w / sum(w) over (partition by vec_id), 9) as p from e""")
def softmax_rows(spark, sf_dir):
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(fn.softmax(F.col("embedding"))).alias("i", "p"))
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("p", 9).alias("p"))


@query("select event_id, round(1 / (1 + exp(-value / 100)), 9) as p from events")
def sigmoid_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(fn.sigmoid(F.col("value") / 100), 9).alias("p"))


@query("""with s as (select event_id, 1 / (1 + exp(-value / 100)) as b from events), t as (select event_id, greatest(b - b * b, 1e-8) as x, b * b as d, 1 - (b + b * b) / 2 as n from s)
    select event_id, round(x / (x + d + n), 9) as p_only_beat, round(d / (x + d + n), 9) as p_downbeat, round(n / (x + d + n), 9) as p_none from t""")
def metrical_triple(spark, sf_dir):
    s = table(spark, sf_dir, "events").withColumn("b", fn.sigmoid(F.col("value") / 100)).withColumn("d", F.col("b") * F.col("b"))
    return s.select("event_id", *(F.round(c, 9).alias(k) for k, c in hmm.metrical_triple(F.col("b"), F.col("d")).items()))


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as label_id from embeddings")
def argmax_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", segments.argmax(F.col("embedding")).alias("label_id"))


@query("""with x as (select vec_id // 8 as track, unnest(range(0, 64)) as i, unnest(embedding) as v from embeddings)
    select track, i, round(avg(cast(v as double)), 9) as v from x group by all""")
def ensemble_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("track"), F.posexplode("embedding").alias("i", "v"))
    return stems.ensemble_mean(rows.withColumn("i", F.col("i").cast("bigint")), ["track", "i"], ["v"]).withColumn("v", F.round("v", 9))


# --- signals

FRAMED = """x as (select vec_id, embedding, unnest(range(0, 4)) as frame from embeddings),
    framed as (select vec_id, frame, k, case when frame * 16 - 16 + k between 0 and 63 then cast(embedding[frame * 16 - 16 + k + 1] as double) else 0 end as v
    from x, unnest(range(0, 32)) as t(k))"""


@query(f"with {FRAMED} select vec_id, frame, k, v from framed")
def framed_signal(spark, sf_dir):
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.framed(F.col("embedding"), 32, 16)).alias("frame", "samples"))
    out = out.select("vec_id", F.col("frame").cast("bigint").alias("frame"), F.posexplode("samples").alias("k", "v"))
    return out.withColumn("k", F.col("k").cast("bigint"))


DFT = """x as (select vec_id, unnest(range(0, 64)) as i, cast(unnest(embedding) as double) as v from embeddings),
    spectrum as (select vec_id, bin, sum(v * cos(i * bin * (-2 * pi() / 64))) as re, sum(v * sin(i * bin * (-2 * pi() / 64))) as im
    from x, unnest(range(0, 32)) as b(bin) group by all)"""


@query(f"with {DFT} select vec_id, bin, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from spectrum")
def relational_dft(spark, sf_dir):
    out = signal.dft(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return out.select("vec_id", "bin", *((F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")))


@query(f"""with {DFT} select vec_id, bin // 4 as band, round(log10(sum(sqrt(re * re + im * im) * 0.25) + 1), 6) as level from spectrum group by all""")
def log_spectrum(spark, sf_dir):
    """A filterbank of eight bands as a relation, joined and summed."""
    spectrum = signal.dft(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    bank = spark.range(32).select(F.col("id").alias("bin"), F.floor(F.col("id") / 4).cast("bigint").alias("band"), F.lit(0.25).alias("w"))
    magnitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    summed = spectrum.join(F.broadcast(bank), "bin").groupBy("vec_id", "band").agg(F.sum(magnitude * F.col("w")).alias("m"))
    return summed.select("vec_id", "band", F.round(F.log10(F.col("m") + 1), 6).alias("level"))


CHUNKED = f"""{FRAMES}, tracks as (select user_id, count(*) as n from frames group by user_id)"""


def _chunks(rows, track, at, value, length):
    """A signal's rows as chunks of so many samples."""
    whole = rows.groupBy(track).agg((F.max(at) + 1).alias("total"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value])
    chunks = rows.groupBy(track, F.floor(F.col(at) / length).alias("chunk")).agg(F.min(at).alias("at"), ordered.alias("samples"))
    return chunks.join(whole, track)


@query(f"""with {CHUNKED}, hops(hop) as (values (3.0), (2.5)), starts as (select user_id, hop, i as frame, cast(floor(i * hop) as bigint) - 10 as s from tracks, hops, unnest(range(0, cast(ceil(n / hop) as bigint))) as t(i))
    select s.user_id, hop, s.frame, k, coalesce(f.value, 0) as v from starts s cross join unnest(range(0, 20)) as u(k) left join frames f on f.user_id = s.user_id and f.frame = s.s + k""")
def chunked_frames(spark, sf_dir):
    """Users' values as signals in chunks of 8 samples; frames of 20 reach over several chunks on either side."""
    chunks = signal.with_edges(_chunks(frames(spark, sf_dir), "user_id", "frame", "value", 8), "user_id", 10)
    both = [signal.chunk_frames(chunks, "user_id", 20, hop).withColumn("hop", F.lit(hop)) for hop in (3.0, 2.5)]
    out = both[0].unionByName(both[1]).select("user_id", "hop", "frame", F.posexplode("samples").alias("k", "v"))
    return out.withColumn("k", F.col("k").cast("bigint"))


@query("""with x as (select event_id - (select min(event_id) from events) as i, value as v from events), total as (select max(i) + 1 as n from x),
    f as (select i as frame, i * 441 - 1024 as s from total, unnest(range(0, cast(ceil(n / 441) as bigint))) as t(i)),
    framed as (select frame, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 2047)) as w from f, unnest(range(0, 2048)) as u(k), x where x.i = s + k and v <> 0),
    tones as (select m from (select 440 * pow(2, unnest(range(-48, 64)) / 12) as h), lateral (select case when h - (c - 1) * 44100 / 2048 < c * 44100 / 2048 - h then c - 1 else c end as m
        from (select least(greatest(cast(ceil(h * 2048 / 44100) as bigint), 1), 1023) as c)) where h between 30 and 17000),
    points as (select m, row_number() over (order by m) - 1 as p from (select distinct m from tones)),
    edges as (select p as band, m as a, lead(m) over (order by p) as b, lead(m, 2) over (order by p) as c from points qualify lead(m, 2) over (order by p) is not null),
    sides as (select band, a, case when c - a < 2 then a else b end as b, case when c - a < 2 then a + 1 else c end as c from edges),
    heights as (select band, j, case when j < b then (j - a) / (b - a) else 1 - (j - b) / (c - b) end as h from sides, unnest(range(a, c)) as t(j)),
    bank as (select band, j, h / sum(h) over (partition by band) as h from heights where h > 0),
    bins as (select distinct j from bank),
    spectrum as (select frame, j, sqrt(pow(sum(w * cos(2 * pi() * ((k * j) % 2048) / 2048)), 2) + pow(sum(w * sin(2 * pi() * ((k * j) % 2048) / 2048)), 2)) as m from framed, bins group by frame, j)
    select frame, band, round(log10(sum(m * h) + 1), 6) as level from spectrum join bank using (j) group by frame, band""")
def chunked_spectrogram(spark, sf_dir):
    """All values as one signal at 44.1 kHz in chunks of 4096 samples: frames of 2048 at 100 a second, the whole filterbank."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_id")).first()[0]
    rows = events.select(F.lit("all").alias("track"), (F.col("event_id") - F.lit(first)).alias("i"), "value")
    chunks = signal.with_edges(_chunks(rows, "track", "i", "value", 4096), "track", 1024).withColumn("sample_rate", F.lit(signal.RATE))
    bands = signal.chunk_spectrogram(chunks, ["track"], exact=True).select("frame", F.posexplode("bands").alias("band", "level"))
    return bands.select("frame", F.col("band").cast("bigint").alias("band"), F.round("level", 6).alias("level"))


# --- stems, stages, sets


NAMED = """named as (select doc_id, n_chars, case when n_chars % 7 = 0 then array_extract(w, 1) || '.wav' when n_chars % 7 < 4 then array_extract(w, 2) || '_' || array_extract(w, 1) || '.wav'
    else array_extract(w, 2) || ' (' || array_extract(w, 1) || ').mp3' end as name from
    (select doc_id, n_chars, [array_extract(['Bass','drums','OTHER','vocals','guitar','Piano','mix'], 1 + n_chars % 7), coalesce(lang, '') || source] as w from documents))"""


@query(f"""with {NAMED}, l as (select doc_id, lower(name) as f, regexp_replace(lower(name), '\\.[^.]*$', '') as bare from named)
    select doc_id, (select s.v from (select unnest(['bass', 'drums', 'other', 'vocals', 'guitar', 'piano']) as v, unnest(range(0, 6)) as o) s
    where bare = s.v or contains(f, '(' || s.v || ')') or contains(f, '_' || s.v || '.') order by o limit 1) as stem from l""")
def stem_classify(spark, sf_dir):
    """File names made of each document's language, source and length."""
    docs = table(spark, sf_dir, "documents")
    kind = (F.col("n_chars") % 7).cast("int")
    word = F.element_at(F.array(*map(F.lit, ["Bass", "drums", "OTHER", "vocals", "guitar", "Piano", "mix"])), kind + 1)
    lead = F.concat(F.coalesce("lang", F.lit("")), "source")
    bare = F.concat(word, F.lit(".wav"))
    name = F.when(kind == 0, bare).when(kind < 4, F.concat(lead, F.lit("_"), bare)).otherwise(F.concat(lead, F.lit(" ("), word, F.lit(").mp3")))
    return docs.select("doc_id", stems.stem_of(name).alias("stem"))


@query("select source, lang, doc_id from documents qualify row_number() over (partition by source, lang order by n_chars desc, doc_id) = 1")
def stem_priority(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return stems.first_by_priority(docs, ["source", "lang"], F.desc("n_chars"), "doc_id").select("source", "lang", "doc_id")


STEM_OF_TYPE = {"click": "guitar", "error": "piano", "purchase": "other", "signup": "bass", "view": "drums"}


@query(f"""with {FRAMES}, n as (select user_id, value, case when event_type = 'view' and event_id % 2 = 1 then 'vocals' else
    case event_type when 'click' then 'guitar' when 'error' then 'piano' when 'purchase' then 'other' when 'signup' then 'bass' else 'drums' end end as part, frame from frames),
    m as (select *, row_number() over (partition by user_id, part order by frame) - 1 as i, case when part in ('guitar', 'piano') then 'other' else part end as stem from n),
    h as (select user_id, list(distinct part) as have from m group by user_id),
    k as (select user_id, list_has_all(have, ['guitar', 'piano']) as six from h where list_has_all(have, ['bass', 'drums', 'other', 'vocals'])),
    u as (select m.* from m join k using (user_id) where six or part = stem),
    s as (select user_id, stem, count(distinct part) as parts from u group by all)
    select u.user_id, u.stem, i, round(sum(value), 6) as value from u join s using (user_id, stem) group by u.user_id, u.stem, i, parts having count(distinct part) = parts""")
def stem_collapse(spark, sf_dir):
    """Event types as stems, views in two; users without a whole set are left out."""
    named = F.create_map(*(F.lit(x) for kv in STEM_OF_TYPE.items() for x in kv))[F.col("event_type")]
    named = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 1), "vocals").otherwise(named)
    numbered = peaks.frame_numbers(frames(spark, sf_dir).withColumn("stem", named).withColumn("key", F.concat_ws("/", "user_id", "stem")), "key", "frame", name="i")
    return stems.collapse_stems(numbered, "user_id", "stem", "i", "value", strict=False).withColumn("value", F.round("value", 6))


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def cache_todo(spark, sf_dir):
    return stems.todo(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def cache_done(spark, sf_dir):
    return stems.done(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("select l_orderkey from lineitem group by l_orderkey having count(distinct l_linenumber) = 4")
def complete_groups(spark, sf_dir):
    return stems.complete(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 4)


@query("select d.doc_id, d.lang, l.quality from documents d left join labels l on d.doc_id = l.doc_id")
def left_side_arrays(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return audio.with_side(docs.select("doc_id", "lang"), labels.select("doc_id", "quality"), "doc_id")


@query("select distinct split_part(url, '/', 3) as host from pages")
def distinct_sorted_inputs(spark, sf_dir):
    return audio.distinct_inputs(table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")), "host")


@query("select doc_id, 'cached' as origin from labels union all select doc_id, 'new' as origin from documents where doc_id not in (select doc_id from labels)")
def union_cached_new(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id")
    return stems.cached_and_new(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


@query("select distinct user_id from events where event_type = 'view' except select distinct user_id from events where event_type = 'error'")
def stage_except(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return stems.apart(events.where("event_type = 'view'").select("user_id"), events.where("event_type = 'error'").select("user_id"))


@query("select p_partkey from part except select l_partkey from lineitem where l_quantity >= 45")
def parts_except(spark, sf_dir):
    """Parts without a large order line."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return stems.apart(table(spark, sf_dir, "part").select("p_partkey"), large)


# --- JSON, text and paths


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("select event_id, case when event_id % 2 = 0 then cast(cast(event_id as double) as varchar) else event_type end as safe from events")
def json_safe_coerce(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", fn.json_safe(text).alias("safe"))


@query("select event_id, round(value, 2) as value from events")
def json_rounding(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.rounded(F.array("value"))[0].alias("value"))


@query("select page_id, list_extract(string_split(url, '/'), -1) as name, regexp_replace(url, '\\.[^./]*$', '') || '.json' as target from pages")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.basename(F.col("url")).alias("name"), fn.with_suffix(F.col("url"), ".json").alias("target"))


@query("select doc_id, sha256(text) as digest from documents")
def sha_verify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", audio.digest(F.col("text").cast("binary")).alias("digest"))


@query("""select event_id, printf('%d:%02d', cast(floor(value / 60) as bigint), cast(round_even(value % 60, 0) as bigint)) as clock,
    coalesce(printf('%.3fs', case when event_type = 'error' then null else round(value, 2) end), 'na') as lasted from events where value >= 0""")
def mss_format(spark, sf_dir):
    lasted = F.when(F.col("event_type") != "error", F.round("value", 2))
    events = table(spark, sf_dir, "events").where("value >= 0")
    return events.select("event_id", fn.minutes_seconds(F.col("value")).alias("clock"), fn.duration_text(lasted).alias("lasted"))


# --- parity

PAIRS = "x as (select vec_id, label, cast(unnest(embedding) as double) as a, unnest(range(0, 64)) as i from embeddings), pairs as (select *, a + (i % 5) * 1e-3 as b from x)"


def _pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("vec_id", "label", "i", F.col("v").cast("double").alias("a")).withColumn("b", F.col("a") + (F.col("i") % 5) * 1e-3)


@query(f"""with {PAIRS} select vec_id, round(avg(abs(a - b)), 9) as mean_abs, round(max(abs(a - b)), 9) as max_abs, round(sqrt(avg((a - b) * (a - b))), 9) as rmse,
    round(avg(abs(a - b) / (abs(a) + 1e-8)), 4) as mean_rel, max(abs(a - b)) > 1e-3 or avg(abs(a - b)) > 1e-4 as triggered from pairs group by vec_id""")
def parity_metrics(spark, sf_dir):
    out = parity.guard(parity.difference_metrics(_pairs(spark, sf_dir), ["vec_id"], "a", "b"))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_abs", "max_abs", "rmse")}).withColumn("mean_rel", F.round("mean_rel", 4))


@query(f"""with {PAIRS}, m as (select label, i % 5 as config, avg(abs(a - b)) as e from pairs group by all)
    select cast(label as bigint) as label, arg_min(config, e) as config from m group by label""")
def argmin_config(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("config", (F.col("i") % 5).cast("bigint"))
    return parity.best_config(parity.difference_metrics(pairs, ["label", "config"], "a", "b"), ["label"], "config").select("label", "config")


@query(f"""with {PAIRS} select vec_id, bool_and(a is not distinct from case when i < 1 + vec_id % 3 then b else a end) as equal from pairs group by vec_id""")
def exact_parity(spark, sf_dir):
    """All entries of every vector; the checked copy differs at the first 1 + vec_id % 3 alone, so some are equal throughout."""
    copy = F.when(F.col("i") < 1 + F.col("vec_id") % 3, F.col("b")).otherwise(F.col("a"))
    return parity.exact_parity(_pairs(spark, sf_dir).withColumn("b", copy), "vec_id", [("a", "b")])


# --- clicks, windows


@query(f"""with {STRENGTH}, k as (select unnest(range(0, 25)) as k) select user_id, frame, k, round(frame / 100 - 4 * pow(0.0125, k / 24.0), 6) as t
    from strengths, k where strength > 0 and frame / 100 - 4 * pow(0.0125, k / 24.0) > 0""")
def click_schedule(spark, sf_dir):
    """Accelerating clicks before each boundary: offsets in equal ratios, those before the start left out."""
    edges = strengths(spark, sf_dir).where("strength > 0").select("user_id", "frame")
    clicks = edges.select("*", F.posexplode(fn.geometric(4.0, 0.05, 25)).alias("k", "offset"))
    at = segments.seconds(F.col("frame")) - F.col("offset")
    return clicks.where(at > 0).select("user_id", "frame", F.col("k").cast("bigint").alias("k"), F.round(at, 6).alias("t"))


@query("""select user_id, time_bucket(interval 15 minutes, ts) - k * interval 15 minutes as "start", count(*) as n, round(sum(value), 4) as total
    from events, unnest(range(0, 4)) as w(k) group by all""")
def hopping_mean(spark, sf_dir):
    aggregates = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]
    out = incremental.hopping(table(spark, sf_dir, "events"), "ts", ["user_id"], "1 hour", "15 minutes", aggregates)
    return out.select("user_id", F.col("window.start").alias("start"), "n", "total")


@query("""with e as (select user_id, ts, value, case when lag(ts) over (partition by user_id order by ts) > ts - interval 6 hours then 0 else 1 end as opens from events),
    s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as session from e)
    select user_id, min(ts) as "start", max(ts) as last, count(*) as n from s group by user_id, session""")
def session_segments(spark, sf_dir):
    out = incremental.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours", [F.max("ts").alias("last"), F.count("*").alias("n")])
    return out.select("user_id", F.col("session.start").alias("start"), "last", "n")


TONE_SQL = ", ".join(f"('{kind}', {', '.join(map(str, of))})" for kind, of in sound.TONES.items())


@query(f"""with {STRENGTH}, tones(kind, f, g, seconds, octaves) as (values {TONE_SQL}),
    played as (select user_id, frame * 10 as s, case when event_type = 'view' then 'drop' else 'beat' end as kind from strengths where strength > 0), ends as (select user_id, count(*) * 10 as e from strengths group by user_id),
    ks as (select user_id, s, e, f, g, octaves, cast(floor(seconds * 1000) as bigint) as n, unnest(range(0, cast(floor(seconds * 1000) as bigint))) as k from played join tones using (kind) join ends using (user_id)),
    heard as (select user_id, s + k as "at", sin(2 * pi() * case when f = g then f * k else f * (1 - pow(pow(g / f, 1.0 / (n - 1)), k + 1)) / (1 - pow(g / f, 1.0 / (n - 1))) end / 1000) * pow(2, -octaves * k / (n - 1)) as v from ks where s + k < e)
    select user_id, "at", round(least(greatest(sum(v), -1), 1), 6) + 0.0 as value from heard group by all""")
def rendered_tones(spark, sf_dir):
    """A tone at every boundary, ten samples a frame at 1 kHz: tones overlap and are cut at the track's end."""
    strong = strengths(spark, sf_dir).select(F.col("user_id").alias("path"), "frame", "strength", F.when(F.col("event_type") == "view", "drop").otherwise("beat").alias("kind"))
    events = strong.where("strength > 0").select("path", (F.col("frame") / 100).alias("time"), "kind")
    lengths = strong.groupBy("path").agg((F.count("*") * 10).alias("samples"))
    out = sound.rendered(events, lengths, 1000)
    return out.select(F.col("path").alias("user_id"), "at", (F.round("value", 6) + 0.0).alias("value"))


# --- streams: the events in shuffled files, one a batch, and a last row that moves the watermark past them all


def _replayed(spark, rows):
    """rows (track, time, ...) as a stream of out-of-order batches."""
    path = fresh_path(spark, "replayed")
    rows.repartition(4, F.xxhash64(*rows.columns)).write.parquet(path)
    end = rows.agg(F.max("time").alias("time")).select(F.lit("end").alias("track"), (F.col("time") + F.expr("interval 1000 days")).alias("time"))
    spark.createDataFrame([], rows.schema).unionByName(end, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, stream):
    """All that a stream appends, each batch once."""
    path = fresh_path(spark, "streamed")
    sink.append_once(stream, path, f"{path}-state", "query").awaitTermination()
    return sink.read(spark, path, stream.schema).drop("writer", "batch")


def _timed(spark, sf_dir):
    return frames(spark, sf_dir).select(F.col("user_id").cast("string").alias("track"), F.col("ts").cast("timestamp").alias("time"), "frame", "us", "event_id", "event_type", "value")


@query(f"""with {FLAGGED} select user_id, island, min(frame) as "start", max(frame) + 1 as "end", cast(arg_max(frame, value * 1e6 - frame * 1e-3) as bigint) as peak
    from flagged where hot group by all""")
def stream_islands(spark, sf_dir):
    rows = _timed(spark, sf_dir).select("track", "time", "frame", (F.col("value") >= 50).alias("flag"), F.col("value").alias("height"))
    found = _run(spark, islands_stream.islands(_replayed(spark, rows), "60 days", 100 * 86400))
    return found.select(F.col("track").cast("bigint").alias("user_id"), "island", "start", "end", "peak")


def _pair(spark, sf_dir, first, second):
    rows = _timed(spark, sf_dir)
    kinds = [rows.where(F.col("event_type") == t).select("track", "time", "us", "event_id") for t in (first, second)]
    return [_replayed(spark, k) for k in kinds]


@query(f"""with {FRAMES} select p.user_id, p.us from frames p where p.event_type = 'purchase' and not exists (select 1 from frames c
    where c.user_id = p.user_id and c.event_type = 'click' and abs(c.us - p.us) <= 7200000000)""")
def stream_exclusion(spark, sf_dir):
    found = _run(spark, islands_stream.without_near(*_pair(spark, sf_dir, "purchase", "click"), "60 days", "2 hours", ["us", "event_id"]))
    return found.where("track <> 'end'").select(F.col("track").cast("bigint").alias("user_id"), "us")


@query(f"""with {NEAREST} select c.user_id, c.us, case when abs(delta) <= 21600000000 then delta end as delta from frames c left join deltas d using (user_id, us) where c.event_type = 'click'""")
def stream_nearest(spark, sf_dir):
    """The nearest purchase within six hours of every click."""
    found = _run(spark, islands_stream.nearest_deltas(*_pair(spark, sf_dir, "click", "purchase"), "60 days", "6 hours", ["us", "event_id"]))
    return found.where("track <> 'end'").select(F.col("track").cast("bigint").alias("user_id"), "us", "delta")


# --- harnesses: runs compared, times summed up, guards


@query("select event_type, round(avg(value), 6) as mean, min(value) as min, round(median(value), 6) as median, max(value) as max from events group by event_type")
def run_summary(spark, sf_dir):
    out = parity.summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query(f"""with {PAIRS}, m as (select vec_id, any_value(label) as label, avg(abs(a - b)) as mean_abs, sqrt(avg((a - b) * (a - b))) as rmse from pairs group by vec_id)
    select cast(label as bigint) as label, round(avg(mean_abs), 9) as mean_abs, round(avg(rmse), 9) as rmse from m group by label""")
def macro_metrics(spark, sf_dir):
    """Unweighted means over vectors of what each vector's entries give."""
    each = parity.difference_metrics(_pairs(spark, sf_dir), ["label", "vec_id"], "a", "b")
    out = parity.macro_average(each, ["label"], ["mean_abs", "rmse"])
    return out.select("label", *(F.round(c, 9).alias(c) for c in ("mean_abs", "rmse")))


NUMBERED = f"{FRAMES}, numbered as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by frame) - 1 as i from frames)"


@query(f"""with {NUMBERED} select user_id, a.i, a.value as a, b.value as b from numbered a join numbered b using (user_id, i)
    where a.event_type = 'click' and b.event_type = 'purchase'""")
def cropped_runs(spark, sf_dir):
    """Two runs of values at the places that both have."""
    each = frames(spark, sf_dir).withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    numbered = peaks.frame_numbers(each, "key", "frame", name="i")
    return parity.cropped(numbered.where("event_type = 'click'"), numbered.where("event_type = 'purchase'"), ["user_id", "i"], "value")


@query("""select user_id, event_id, coalesce(max(value > 180 or value * value > 30000) over (partition by user_id order by event_id rows unbounded preceding), false) as triggered,
    case when coalesce(max(value > 180 or value * value > 30000) over (partition by user_id order by event_id rows unbounded preceding), false) then 'slow' else cast(user_id as varchar) end as effective from events""")
def sticky_guard(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("user_id").cast("string").alias("backend"), F.col("value").alias("max_abs"), (F.col("value") * F.col("value")).alias("mean_abs"))
    return guard.guarded(checks, "event_id", "slow", 180.0, 30000.0).select("user_id", "event_id", "triggered", "effective")


@query("""with x as (select vec_id, cast(unnest(embedding) as double) as v, unnest(range(0, 64)) as i from embeddings)
    select vec_id, frame, round(sqrt(sum(v * v) / 16), 6) as rms from x, unnest(range(0, 17)) as f(frame) where i between frame * 4 - 8 and frame * 4 + 7 group by all""")
def rms_envelope(spark, sf_dir):
    samples = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return sound.envelope(samples, "vec_id", "i", "v", 16, 4).withColumn("rms", F.round("rms", 6))


@query("select event_id, round(least(greatest(value / 50 - 1, -1), 1), 9) as v from events")
def clipped_mix(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(sound.clip(F.col("value") / 50 - 1), 9).alias("v"))


@query("select cast(doc_id as varchar) as path, n_chars as ordinal, quality from documents left join labels using (doc_id)")
def results_in_order(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("ordinal"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), "quality")
    return audio.in_order(done, asked)


@query("select count(*) filter (doc_id in (select doc_id from labels)) as existing, count(*) filter (doc_id not in (select doc_id from labels)) as todo from documents")
def plan_counts(spark, sf_dir):
    return stems.plan_counts(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"""with {FRAMES}, kept as (select event_type, us from frames where event_type <> 'error'),
    bars as (select replace(event_type, '_', ' ') as label, us as s, us + 1000 as e from kept where event_type not in ('click', 'view')
    union all select 'post process', min(us), max(us + 1000) from kept where event_type in ('click', 'view'))
    select label, s - min(s) over () as since, e - min(s) over () as until, e - s as duration, max(e) over () - min(s) over () as total from bars""")
def timing_bars(spark, sf_dir):
    """All events as the timings of one track."""
    f = frames(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("us").alias("start"), (F.col("us") + 1000).alias("end"), F.lit("all").alias("track"))
    return rollup.timing_chart(f, ["click", "view"], ["error"])


@query("select round(avg(l_discount), 9) as best_threshold_beat, round(avg(l_tax), 9) as best_threshold_downbeat from lineitem")
def ensemble_thresholds(spark, sf_dir):
    configs = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("best_threshold_beat"), F.col("l_tax").alias("best_threshold_downbeat"))
    return score.ensemble_thresholds(configs).select(*(F.round(c, 9).alias(c) for c in configs.columns))


@query(f"""with {FRAMES}, runs(reference, candidate) as (values ('click', 'purchase'), ('view', 'error')),
    deltas as (select reference, candidate, c.user_id, p.us - c.us as delta from runs join frames c on c.event_type = reference join frames p on p.event_type = candidate and p.user_id = c.user_id
    qualify row_number() over (partition by reference, c.event_id order by abs(p.us - c.us), p.us desc) = 1),
    tracks as (select distinct reference, candidate, user_id from runs join frames on event_type in (reference, candidate)),
    found as (select reference, user_id, count(*) as n, round(avg(delta), 3) as mean_signed, round(median(abs(cast(delta as double))), 3) as median_abs, cast(max(abs(delta)) as double) as max_abs from deltas group by all)
    select t.reference, t.candidate, t.user_id, coalesce(n, 0) as n, mean_signed, median_abs, max_abs from tracks t left join found f on f.reference = t.reference and f.user_id = t.user_id""")
def run_parity(spark, sf_dir):
    """Nearest times of two pairs of runs, track by track."""
    out = parity.beat_parity(frames(spark, sf_dir), [("click", "purchase"), ("view", "error")], "event_type", "user_id", "us")
    return out.select("reference", "candidate", "user_id", "n", F.round("mean_signed", 3).alias("mean_signed"), F.round("median_abs", 3).alias("median_abs"), "max_abs")


@query("""with x as (select abs(cast(unnest(embedding) as double)) as m from embeddings), o as (select p.power, l.log, l.scale from (values (1.0), (2.0)) p(power), (values ('ln', 1.0), ('log10', ln(10))) l(log, scale)),
    d as (select cast(power as double) as power, log, ln(1 + pow(m, power)) / scale - log10(1 + m * m) as d from x, o)
    select power, log, round(avg(abs(d)), 7) as mean_abs, round(max(abs(d)), 7) as max_abs, round(sqrt(avg(d * d)), 7) as rmse from d group by power, log""")
def spectrum_variants(spark, sf_dir):
    """Which power and logarithm give the expected levels."""
    m = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", F.abs(F.col("v").cast("double")).alias("magnitude"))
    expected = m.select("vec_id", "i", F.log10(1 + F.col("magnitude") * F.col("magnitude")).alias("level"))
    out = parity.spectrum_search(expected, m, [1.0, 2.0], ["ln", "log10"], ["vec_id", "i"])
    return out.select("power", "log", *(F.round(c, 7).alias(c) for c in ("mean_abs", "max_abs", "rmse")))


@query("""with x as (select vec_id, cast(unnest(embedding) as double) as v, unnest(range(0, 64)) as i from embeddings), l as (select vec_id, i // 8 as f, i % 8 as b, v from x),
    o as (select * from (values (-1), (0), (1)) s(shift), (values (true), (false)) t(turned), (values (true), (false)) w(whole)),
    laid as (select vec_id, case when turned then b else f end + shift as f, case when turned then f else b end as b, v, shift, turned, whole from l, o where whole or case when turned then f else b end < 7),
    d as (select shift, turned, whole, e.v as a, l.v as b, e.v - l.v as d from (select vec_id, b + 1 as f, f as b, v from l) e join laid l using (vec_id, f, b))
    select shift, turned, whole, round(avg(abs(d)), 7) as mean_abs, round(max(abs(d)), 7) as max_abs, round(sqrt(avg(d * d)), 7) as rmse from d group by all""")
def layout_variants(spark, sf_dir):
    """Vectors as eight frames of eight bands; the expected ones are turned and a frame late, which one layout meets exactly."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    levels = rows.select("vec_id", F.floor(F.col("i") / 8).alias("f"), (F.col("i") % 8).alias("b"), F.col("v").cast("double").alias("level"))
    expected = levels.select("vec_id", (F.col("b") + 1).alias("f"), F.col("f").alias("b"), "level")
    out = parity.layout_search(expected, levels, "vec_id", "f", "b", [-1, 0, 1], 7)
    return out.select("shift", "turned", "whole", *(F.round(c, 7).alias(c) for c in ("mean_abs", "max_abs", "rmse")))


# --- sketches, manifests, caches, open rows

PARTS = [0.05, 0.5, 0.9]


@query("""select l_returnflag, p, count(*) as n, true as within from lineitem, (values (cast(0.05 as double)), (0.5), (0.9)) as t(p) group by all""")
def quantile_sketches(spark, sf_dir):
    """Whether the exact rank of every estimate is within the bound: prices by flag, from sketches of each line status, merged."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    parts = quantiles.sketches(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    found = quantiles.estimates(quantiles.merged(parts, ["l_returnflag"]), ["l_returnflag"], PARTS)
    ranked = quantiles.ranked(rows, ["l_returnflag"], "l_extendedprice", found)
    within = quantiles.within(F.col("p"), F.col("below"), F.col("upto"), 2 * quantiles.rank_error())
    return ranked.select("l_returnflag", "p", "n", within.alias("within"))


@query("""with t as (select d.doc_id, stage, o, case when l.doc_id is null then 'new' when l.toxic = 1 then 'input changed' when l.quality = 1 or stage in ('demix', 'spec') then 'done'
    when stage = 'json' then 'options changed' else 'an earlier stage changed' end as status
    from documents d left join labels l using (doc_id), (values ('demix', 0), ('spec', 1), ('json', 2), ('viz', 3), ('sonify', 4)) as s(stage, o))
    select cast(doc_id as varchar) as track, stage, status from t""")
def stage_plan(spark, sf_dir):
    """Labelled documents as tracks that a manifest knows: those of quality 1 as they are, toxic ones with another input, the rest with another option of json."""
    stages = lambda threshold: [
        manifest.Stage("demix"), manifest.Stage("spec", ("demix",)), manifest.Stage("json", ("spec",), {"threshold": threshold}),
        manifest.Stage("viz", ("json",)), manifest.Stage("sonify", ("json",)),
    ]
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    inputs = docs.select(F.col("doc_id").cast("string").alias("track"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("input"))
    known = inputs.join(labels.select(F.col("doc_id").cast("string").alias("track"), "quality", "toxic"), "track")
    known = known.withColumn("input", F.when(F.col("toxic") == 1, F.lit("another")).otherwise(F.col("input")))
    path = fresh_path(spark, "manifest")
    manifest.record(manifest.expected(known.where("quality = 1"), stages(0.24)), path, 0)
    manifest.record(manifest.expected(known.where("quality <> 1"), stages(0.3)), path, 1)
    return manifest.planned(inputs, stages(0.24), manifest.read(spark, path)).select("track", "stage", "status")


@query("""select item_id, case when item_id % 5 = 0 then 'rejected' when item_id % 7 = 1 then 'replaced' else 'fetched' end as first, case when item_id % 5 = 0 then 'rejected' else 'kept' end as second from benchmark""")
def verified_cache(spark, sf_dir):
    """Passages as files: every fifth source isn't what it should be, every seventh other cached file is spoiled beforehand."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.withColumn("text", F.concat("name", F.lit(": "), "text"))
    sources, kept = fresh_path(spark, "sources"), fresh_path(spark, "cache")
    store.write_files(items, sources, F.col("name"), F.when(F.col("item_id") % 5 == 0, F.lit("spoiled")).otherwise(F.col("text")))
    wanted = items.select("item_id", "name", F.sha2("text", 256).alias("sha256"), F.concat(F.lit(sources + "/"), "name").alias("source"))
    store.write_files(wanted.where("item_id % 7 = 1"), kept, F.concat(F.substring("sha256", 1, 2), F.lit("/"), "sha256"), F.lit("spoiled"))
    runs = [cache.cached(wanted, kept, strict=False).select("name", F.col("status").alias(k)) for k in ("first", "second")]
    return wanted.select("item_id", "name").join(runs[0], "name").join(runs[1], "name").select("item_id", "first", "second")


@query("""select event_id, event_type as stage, round(value, 2) as duration, cast(json_extract(props, '$.k') as bigint) as k, 'BIGINT' as kind, event_id % 3 as deep from events""")
def timing_extras(spark, sf_dir):
    """Events as timing lines with keys of their own, written, read and written again."""
    made = F.struct("event_id", F.col("event_type").alias("stage"), F.col("value").alias("duration"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.struct((F.col("event_id") % 3).alias("x")).alias("more"))
    first, second = fresh_path(spark, "timings"), fresh_path(spark, "timings")
    table(spark, sf_dir, "events").select(F.to_json(made).alias("value")).write.text(first)
    sinks.append_timings(audio.timings(spark, first), second)
    t = audio.timings(spark, second)
    extra = lambda key, path, kind: F.try_variant_get(F.col("extra")[key], path, kind)
    return t.select(extra("event_id", "$", "bigint").alias("event_id"), "stage", "duration", extra("k", "$", "bigint").alias("k"), F.schema_of_variant(F.col("extra")["k"]).alias("kind"), extra("more", "$.x", "bigint").alias("deep"))


# --- files written by the sinks and read back by the sources


@query("""with x as (select vec_id, label, embedding, row_number() over (partition by label order by vec_id) - 1 as "at" from embeddings)
    select cast(label as bigint) as label, "at", unnest(range(0, 64)) as k, cast(unnest(embedding) as double) as v from x""")
def array_files(spark, sf_dir):
    """A file of vectors for each label, read by ranges of a few rows."""
    rows = peaks.frame_numbers(table(spark, sf_dir, "embeddings"), "label", "vec_id", name="at")
    path = fresh_path(spark, "arrays")
    arrays.save(rows.select(F.concat(F.lit("label-"), "label", F.lit(".npy")).alias("file"), "at", F.col("embedding").alias("value")), path)
    back = arrays.read(spark, f"{path}/label-*.npy", split_bytes=4096)
    named = back.select(F.regexp_extract("name", "label-(.*)", 1).cast("bigint").alias("label"), "at", "value")  # once for each vector, not for each entry
    out = named.select("label", "at", F.posexplode("value").alias("k", "v"))
    return out.select("label", "at", F.col("k").cast("bigint").alias("k"), F.col("v").cast("double").alias("v"))


@query(f"""with {FRAMES} select cast(user_id as varchar) as track, frame, cast(cast(value as float) as double) as beat, cast(cast(value / 2 as float) as double) as downbeat,
    cast(cast(value / 4 as float) as double) as section, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as class from frames""")
def side_files(spark, sf_dir):
    """Activations as .npz files beside results, one for each user, and as a table again."""
    f = frames(spark, sf_dir)
    one_hot = F.array(*(F.when(F.col("event_type") == t, 1.0).otherwise(0.0).cast("float") for t in TYPES))
    p = {"p_beat": F.col("value"), "p_downbeat": F.col("value") / 2, "p_section": F.col("value") / 4}
    path = fresh_path(spark, "side")
    sinks.save_activation_files(f.select(F.col("user_id").cast("string").alias("track_id"), F.col("frame").cast("int").alias("frame"), *(c.cast("float").alias(k) for k, c in p.items()), one_hot.alias("p_function")), path)
    back = audio.activation_files(spark, path)
    values = [F.col(c).cast("double").alias(n) for n, c in (("beat", "p_beat"), ("downbeat", "p_downbeat"), ("section", "p_section"))]
    return back.select(F.col("track_id").alias("track"), F.col("frame").cast("bigint").alias("frame"), *values, segments.argmax(F.col("p_function")).alias("class"))


@query(f"""with {FRAMES} select cast(user_id as varchar) as track, frame, round(cast(round_even(least(greatest(value / 500, -1), 1) * 32767, 0) as double) / 32768, 6) as v from frames""")
def wave_files(spark, sf_dir):
    """Users' values as WAV files of 16 bits, read in chunks of 16 samples by byte range."""
    scaled = sound.clip(F.col("value") / 500)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", scaled.alias("v")))), lambda x: x["v"])
    path = fresh_path(spark, "waves")
    signals = frames(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("track_id")).agg(ordered.alias("samples"))
    sinks.save_waves(signals.select("track_id", F.lit("drums").alias("stem"), F.lit(8000).alias("sample_rate"), "samples"), path)
    back = waves.read(spark, f"{path}/*.wav", chunk=16, split_bytes=256)
    named = back.select(F.regexp_extract("path", r"([^/]*)\.drums\.wav$", 1).alias("track"), "at", "samples")  # once for each chunk
    out = named.select("track", "at", F.posexplode("samples").alias("k", "v"))
    return out.select("track", (F.col("at") + F.col("k")).alias("frame"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query(f"""with {SEGMENTED}, spans as (select user_id, segment, min(frame) * 441 / 44100 as s, (max(frame) + 1) * 441 / 44100 as e from segmented group by all)
    select cast(user_id as varchar) as track, segment, round(s, 2) as "start", round(e, 2) as "end" from spans""")
def result_files(spark, sf_dir):
    """Segments as result files of pretty JSON, one for each user, read again."""
    spans = segments.segments(segmented(spark, sf_dir), "user_id", "frame")
    one = F.struct(segments.seconds(F.col("start")).cast("double").alias("start"), segments.seconds(F.col("end")).cast("double").alias("end"), F.lit("verse").alias("label"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("segment", one.alias("s")))), lambda x: x["s"])
    none = F.array().cast("array<double>")
    made = spans.groupBy("user_id").agg(listed.alias("segments")).select(F.concat(F.col("user_id").cast("string"), F.lit(".wav")).alias("path"), F.lit(120).alias("bpm"), none.alias("beats"), none.alias("downbeats"), F.array().cast("array<int>").alias("beat_positions"), "segments")
    path = fresh_path(spark, "results")
    sinks.save_result_files(made, path)
    back = audio.results_with_files(spark, path).where("not has_activations")
    out = back.select(F.col("track_id").alias("track"), F.posexplode("segments").alias("segment", "s"))
    return out.select("track", F.col("segment").cast("bigint").alias("segment"), "s.start", "s.end")


@query("select distinct source || '/' || coalesce(lang, '') as input from documents order by input limit 7")
def first_inputs(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.coalesce("lang", F.lit(""))).alias("input"))
    return audio.first_inputs(named, "input", 7)


@query("""select event_id, event_type as stage, case when event_id % 3 = 0 then 'none' else event_type end as model, cast(json_extract(props, '$.k') as bigint) as k from events""")
def map_merge_default(spark, sf_dir):
    """A record's own entries over its defaults, and a default where a key is missing."""
    events = table(spark, sf_dir, "events")
    base = F.create_map(F.lit("stage"), F.lit("?"), F.lit("k"), F.get_json_object("props", "$.k"))
    own = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("stage"), F.col("event_type"))).otherwise(F.create_map(F.lit("stage"), F.col("event_type"), F.lit("model"), F.col("event_type")))
    merged = events.select("event_id", fn.map_merge(base, own).alias("m"))
    return merged.select("event_id", F.col("m")["stage"].alias("stage"), fn.map_get(F.col("m"), "model", F.lit("none")).alias("model"), fn.map_get(F.col("m"), "k", F.lit("0")).cast("bigint").alias("k"))


@query("""with c as (select event_id, event_id % 5 / 4 as r, event_id % 7 / 6 as g, event_id % 3 / 2 as b from events)
    select event_id, case when 0.299 * r + 0.587 * g + 0.114 * b > 0.5 then 'black' else 'white' end as colour from c where abs(0.299 * r + 0.587 * g + 0.114 * b - 0.5) > 1e-9""")
def text_colours(spark, sf_dir):
    """Black or white upon colours that follow from event numbers; where the weight is 0.5 to a rounding, neither side is asked."""
    r, g, b = (F.col("event_id") % n / (n - 1) for n in (5, 7, 3))
    events = table(spark, sf_dir, "events").where(F.abs(0.299 * r + 0.587 * g + 0.114 * b - 0.5) > 1e-9)
    return events.select("event_id", fn.text_colour(r, g, b).alias("colour"))
