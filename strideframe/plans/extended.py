"""Queries of operators that work by parts, fold within rows, run by folds, or keep late rows of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strideframe.functions import latent
from strideframe.operators import splits, windows
from strideframe.plans import loso
from strideframe.plans.catalogue import EV, EVENT_LABELS, embeddings, events, query, rounded
from strideframe.session import small, stored, work_dir
from strideframe.streaming import ordered
from strideframe.streaming.windows import run_available

# All events as one recording: runs over every part of it.
ONE = f"""{EV}, l as (select *, row_number() over w as rn, lag(label) over w as before from ev window w as (order by ts, event_id)),
 r as (select *, cast(sum(case when rn > 1 and before is not distinct from label then 0 else 1 end) over (order by ts, event_id rows between unbounded preceding and current row) as bigint) as run from l),
 p as (select *, count(*) over (partition by run) as n, row_number() over (partition by run order by ts, event_id) - 1 as pos from r where label is not null)"""


def one_recording(spark, d):
    rows = events(spark, d).select(F.lit(0).alias("subject"), "ts", "event_id", "value", "label")
    return windows.label_runs_by_parts(windows.range_parts(rows, ["subject"], ["ts", "event_id"]), ["subject"], ["ts", "event_id"], "label", "strict", "part")


@query("runs_one_recording", f"with {ONE} select run, max(label) as label, count(*) as n_rows, min(event_id) as least_id from p group by run")
def _(spark, d):
    return one_recording(spark, d).groupBy("run").agg(F.max("label").alias("label"), F.count("*").alias("n_rows"), F.min("event_id").alias("least_id"))


@query("windows_one_recording", f"""with {ONE}, w as (select run, unnest(range(0, n - 2 + 1)) as widx from (select distinct run, n from p where n >= 2))
select w.run, cast(w.widx as bigint) as widx, max(p.label) as label, count(*) as len, round(avg(p.value), 6) as mean_value
from w join p on p.run = w.run and p.pos >= w.widx and p.pos < w.widx + 2 group by 1, 2""")
def _(spark, d):
    cut = windows.cut_windows(one_recording(spark, d), 2, 1)
    return rounded(cut.groupBy("run", "widx").agg(F.max("label").alias("label"), F.count("*").alias("len"), F.avg("value").alias("mean_value")))


# A velocity that depends on the state and the time: towards the class mean, slower as t falls.
@query("euler_state_dependent", """with recursive s as (select vec_id, label, i, cast(embedding[i + 1] as double) as x from (select *, unnest(range(64)) as i from embeddings)),
 m as (select label, i, avg(x) as m from s group by 1, 2),
 r(vec_id, i, m, step, z) as (select s.vec_id, s.i, m.m, 0, s.x from s join m on m.label = s.label and m.i = s.i
  union all select vec_id, i, m, step + 1, z - (z - m) * (5e-1 + (1 - step / 10e0)) / 10 from r where step < 10)
select vec_id, step, round(1 - step / 10e0, 6) as t, round(sum(z), 6) as total, round(max(z), 6) as top from r where step % 5 = 0 group by vec_id, step""")
def _(spark, d):
    e = embeddings(spark, d).select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = means.groupBy(F.col("label").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    met = e.join(small(stored(means, "class-means")), F.col("label") == F.col("of"))
    towards = lambda z, t: F.zip_with(z, "mean", lambda a, b: (a - b) * (0.5 + t))
    out = met.select("vec_id", F.explode(latent.euler_states(F.col("embedding"), towards, 10, 5)).alias("s")).select("vec_id", "s.*")
    return rounded(out.select("vec_id", "step", "t", F.aggregate("state", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("state").alias("top")))


@query("loso_scenarios")
def _(spark, d):
    """Every fold of four: embeddings as windows, every third one synthetic; forests of 10 trees keep four folds of four scenarios short."""
    e = embeddings(spark, d).withColumn("subject", F.col("vec_id") % 4)
    root = f"{work_dir(spark)}/loso-{uuid.uuid4().hex}"
    real, made = e.where("not synthetic"), e.where("synthetic")
    _, summary = loso.run_loso(real, root, subject="subject", label="label", flat="embedding", key="vec_id", classes=10, synthetic=made, trees=10)
    return rounded(summary)


@query("stream_ordered_windows", """with ev as (select *, case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 end as label from events
  where epoch_us(ts) <= (select epoch_ms(max(ts)) * 1000 from events)),
 l as (select *, row_number() over w as rn, lag(label) over w as before from ev window w as (partition by user_id order by ts, event_id)),
 r as (select *, cast(sum(case when rn > 1 and before is not distinct from label then 0 else 1 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as bigint) as run from l),
 p as (select *, count(*) over (partition by user_id, run) as n, row_number() over (partition by user_id, run order by ts, event_id) - 1 as pos from r where label is not null),
 w as (select user_id, run, unnest(range(0, n - 2 + 1)) as widx from (select distinct user_id, run, n from p where n >= 2))
select w.user_id as subject, 'window' as kind, w.run, cast(w.widx as bigint) as widx, max(p.label) as label, count(*) as len, round(avg(p.value), 6) as mean_value
from w join p on p.user_id = w.user_id and p.run = w.run and p.pos >= w.widx and p.pos < w.widx + 2 group by w.user_id, w.run, w.widx""")
def _(spark, d):
    """All events as a stream that waits for nothing: rows of the watermark's own millisecond still wait when it ends."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = windows.encode_labels(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d), "event_type", EVENT_LABELS)
    rows = rows.select(F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value", "label")
    with ordered.rocksdb(spark):
        out = run_available(ordered.ordered_windows(rows, 2, 1, "0 seconds"), f"{work_dir(spark)}/ordered-{uuid.uuid4().hex}")
    return rounded(out.select("subject", "kind", "run", "widx", "label", "len", "mean_value"))


@query("loso_exact_forest")
def _(spark, d):
    """As ``loso_scenarios``, with exact trees without a greatest depth."""
    e = embeddings(spark, d).withColumn("subject", F.col("vec_id") % 4)
    root = f"{work_dir(spark)}/loso-{uuid.uuid4().hex}"
    _, summary = loso.run_loso(e.where("not synthetic"), root, subject="subject", label="label", flat="embedding", key="vec_id", classes=10, synthetic=e.where("synthetic"), exact=True, trees=10)
    return rounded(summary)


@query("class_draws", "select vec_id, label from (select vec_id, label, row_number() over (partition by label order by substring(md5('42/' || vec_id), 1, 15), vec_id) as rn from embeddings) where rn <= 7")
def _(spark, d):
    return splits.draw_rows_per_class(embeddings(spark, d).select("vec_id", "label"), "label", "vec_id", 7)


@query("scenario_draws", """with e as (select vec_id, label, vec_id % 3 = 0 as synthetic from embeddings),
 r as (select *, row_number() over (partition by synthetic, label order by substring(md5('1/' || vec_id), 1, 15), vec_id) as rn from e),
 p as (select 'trtr' as scenario, 'real' as origin, vec_id, label from r where not synthetic union all select 'scarce', 'real', vec_id, label from r where not synthetic and rn <= 2
  union all select 'tstr', 'synthetic', vec_id, label from r where synthetic and rn <= 5 union all select 'tstr_scarce', 'synthetic', vec_id, label from r where synthetic and rn <= 5
  union all select 'tstr_scarce', 'real', vec_id, label from r where not synthetic and rn <= 2)
select scenario, origin, label, count(*) as n, cast(sum(vec_id) as bigint) as ids from p group by 1, 2, 3""")
def _(spark, d):
    e = embeddings(spark, d)
    drawn = splits.scenario_populations(e.where("not synthetic").select("vec_id", "label"), e.where("synthetic").select("vec_id", "label"), "label", "vec_id", scarce=2, synthetic_cap=5, seed=1)
    return drawn.groupBy("scenario", "origin", "label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))
