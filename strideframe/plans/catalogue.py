"""Registered queries of the windowed-signal operators over the driver's tables, each with its SQL.

``events`` are recordings (subject ``user_id``, order ``ts, event_id``, label
by event type with errors excluded), ``embeddings`` are flat windows of 4
channels by 16 samples in 10 classes, and every third one is synthetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import latent, signal, spectral
from strideframe.operators import audit, metrics, privacy, splits, standardize, windows
from strideframe.schema import finite

EVENT_LABELS = {"click": 0, "view": 1, "purchase": 2, "signup": 3}
FLAG_LABELS = {"A": 0, "N": 1}
C, T, RATE = 4, 16, 50.0
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

EV = """ev as (select user_id, ts, event_id, event_type, value, cast(json_extract_string(props, '$.k') as double) as ch1,
  case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 end as label from events)"""
EMB = """emb as (select vec_id, label, vec_id % 3 = 0 as synthetic, vec_id % 12 as fold, (label + (case when vec_id % 5 = 0 then 1 else 0 end)) % 10 as pred, embedding from embeddings),
 s as (select vec_id, label, synthetic, fold, i // 16 as channel, i % 16 as t, cast(embedding[i + 1] as double) as x from (select *, unnest(range(64)) as i from emb))"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ch1", F.get_json_object("props", "$.k").cast("double"))
    return windows.encode_labels(rows, "event_type", EVENT_LABELS)


def embeddings(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    pred = (F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10
    return e.withColumns({"synthetic": F.col("vec_id") % 3 == 0, "fold": F.col("vec_id") % 12, "pred": pred.cast("int")})


def samples(spark, d) -> DataFrame:
    return standardize.explode_channels(embeddings(spark, d), "embedding", T, ["vec_id", "label", "synthetic", "fold"])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def event_windows(spark, d, mode: str, length: int, hop: int) -> DataFrame:
    runs = windows.label_runs(events(spark, d).select("user_id", "ts", "event_id", "value", "ch1", "label"), ["user_id"], ["ts", "event_id"], "label", mode)
    cut = windows.cut_windows(runs, length, hop)
    return cut.groupBy("user_id", "run", "widx").agg(F.max("label").alias("label"), F.count("*").alias("len"), F.avg("value").alias("mean_value"))


def runs_sql(mode: str) -> str:
    src = "(select * from ev where label is not null)" if mode == "compat" else "ev"
    return f"""{EV},
 l as (select *, row_number() over (partition by user_id order by ts, event_id) as rn, lag(label) over (partition by user_id order by ts, event_id) as pl from {src}),
 r as (select *, cast(sum(case when rn > 1 and pl is not distinct from label then 0 else 1 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as bigint) as run from l),
 p as (select *, count(*) over (partition by user_id, run) as n, row_number() over (partition by user_id, run order by ts, event_id) - 1 as pos from r where label is not null)"""


def windows_sql(mode: str, length: int, hop: int) -> str:
    return f"""with {runs_sql(mode)},
 w as (select user_id, run, unnest(range(0, (n - {length}) // {hop} + 1)) as widx from (select distinct user_id, run, n from p where n >= {length}))
select w.user_id, w.run, cast(w.widx as bigint) as widx, max(p.label) as label, count(*) as len, round(avg(p.value), 6) as mean_value
from w join p on p.user_id = w.user_id and p.run = w.run and p.pos >= w.widx * {hop} and p.pos < w.widx * {hop} + {length} group by 1, 2, 3"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Strict windows of the recordings with z-scores by the training subjects' statistics."""
    rows = events(spark, d)
    train = rows.where(F.col("user_id") % 10 != 0).agg(F.avg("value").alias("m"), F.greatest(F.stddev_pop("value"), F.lit(standardize.FLOOR)).alias("s"))
    runs = windows.label_runs(rows.select("user_id", "ts", "event_id", "value", "label"), ["user_id"], ["ts", "event_id"], "label", "strict")
    table_ = windows.window_table(windows.cut_windows(runs, 2, 1), ["user_id"], "label", {"signal": "value"})
    return table_.join(F.broadcast(train), F.lit(True)).select("user_id", "run", "widx", "label", "len", F.transform("signal", lambda x: (x - F.col("m")) / F.col("s")).alias("signal"))


# Scans, projections, validation.


@query("rec_project_cast", "select user_id, event_id, cast(value as float) as ch0, cast(json_extract_string(props, '$.k') as float) as ch1 from events")
def _(spark, d):
    return events(spark, d).select("user_id", "event_id", F.col("value").cast("float").alias("ch0"), F.col("ch1").cast("float").alias("ch1"))


@query("rec_finite_counts", """select count(*) as n_total, count_if(value is null or isnan(value)) as n_nan, count_if(coalesce(isinf(value), false)) as n_inf,
 count_if(value is not null and not isnan(value) and not isinf(value)) as n_finite, coalesce(100e0 * count_if(value is not null and not isnan(value) and not isinf(value)) / nullif(count(*), 0), 100e0) as pct_finite from events""")
def _(spark, d):
    return signal.finite_counts(table(spark, d, "events"), "value")


@query("rec_label_encode", f"with {EV} select user_id, event_id, event_type, coalesce(label, -1) as label from ev")
def _(spark, d):
    return windows.encode_labels(table(spark, d, "events"), "event_type", EVENT_LABELS, excluded=-1).select("user_id", "event_id", "event_type", "label")


@query("rec_unknown_labels_anti", "select event_type, count(*) as n from events where event_type not in ('click', 'view', 'purchase', 'signup') or event_type is null group by 1")
def _(spark, d):
    return windows.unknown_codes(table(spark, d, "events"), "event_type", EVENT_LABELS)


@query("rec_excluded_per_subject", f"with {EV} select user_id, count(*) as n_rows, count_if(label is null) as n_excluded, count(distinct label) as n_classes from ev group by 1")
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label").isNull()).alias("n_excluded"), F.count_distinct("label").alias("n_classes"))


@query("rec_time_monotonic_rate", """with s as (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 as step from events)
select user_id, count(*) as n_rows, min(step) as min_step_s, count_if(coalesce(step <= 0, false)) as n_not_rising, round(1e0 / nullif(quantile_cont(step, 0.5), 0), 9) as rate_hz from s group by 1""")
def _(spark, d):
    from strideframe.sources.recordings import time_steps

    return time_steps(table(spark, d, "events"), ["user_id"], "ts", ["ts", "event_id"]).withColumn("rate_hz", F.round("rate_hz", 9))


@query("rec_validation", "select count_if(not coalesce(value is not null and not isnan(value) and not isinf(value), false)) as bad_value, count_if(user_id is null) as bad_subject, count_if(ts is null) as bad_ts from events")
def _(spark, d):
    return table(spark, d, "events").agg(F.count_if(~finite("value")).alias("bad_value"), F.count_if(F.col("user_id").isNull()).alias("bad_subject"), F.count_if(F.col("ts").isNull()).alias("bad_ts"))


# Runs and windows.


def _register_runs(mode):
    @query(f"runs_{mode}", f"with {runs_sql(mode)} select user_id, run, max(label) as label, count(*) as n_rows from p group by 1, 2")
    def _(spark, d):
        runs = windows.label_runs(events(spark, d).select("user_id", "ts", "event_id", "label"), ["user_id"], ["ts", "event_id"], "label", mode)
        return windows.run_table(runs, ["user_id"], "label")

    @query(f"windows_{mode}", windows_sql(mode, 2, 1))
    def _(spark, d):
        return rounded(event_windows(spark, d, mode, 2, 1))


for _mode in ("compat", "strict"):
    _register_runs(_mode)


@query("windows_grid", f"""with {runs_sql('strict')}, g(win_len, hop) as (values (2, 1), (2, 2), (3, 1), (3, 2)), q as (select distinct user_id, run, n from p)
select cast(win_len as bigint) as win_len, cast(hop as bigint) as hop, cast(sum(case when n >= win_len then (n - win_len) // hop + 1 else 0 end) as bigint) as n_windows, count_if(n >= win_len) as n_runs from q, g group by 1, 2""")
def _(spark, d):
    runs = windows.label_runs(events(spark, d).select("user_id", "ts", "event_id", "label"), ["user_id"], ["ts", "event_id"], "label", "strict")
    return windows.window_grid(runs, ["user_id"], [(2, 1), (2, 2), (3, 1), (3, 2)])


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@query("windows_bench", f"""with l as (select *, case l_returnflag when 'A' then 0 when 'N' then 1 end as label from lineitem),
 a as (select *, row_number() over w as rn, lag(label) over w as pl from l window w as (partition by l_suppkey order by {', '.join(LINE_ORDER)})),
 r as (select *, cast(sum(case when rn > 1 and pl is not distinct from label then 0 else 1 end) over (partition by l_suppkey order by {', '.join(LINE_ORDER)} rows between unbounded preceding and current row) as bigint) as run from a),
 p as (select *, count(*) over (partition by l_suppkey, run) as n, row_number() over (partition by l_suppkey, run order by {', '.join(LINE_ORDER)}) - 1 as pos from r where label is not null),
 w as (select l_suppkey, run, unnest(range(0, (n - 4) // 2 + 1)) as widx from (select distinct l_suppkey, run, n from p where n >= 4))
select w.l_suppkey, w.run, cast(w.widx as bigint) as widx, max(p.label) as label, count(*) as len, round(avg(l_quantity), 6) as mean_quantity, round(avg(l_extendedprice), 6) as mean_price
from w join p on p.l_suppkey = w.l_suppkey and p.run = w.run and p.pos >= w.widx * 2 and p.pos < w.widx * 2 + 4 group by 1, 2, 3""")
def _(spark, d):
    rows = windows.encode_labels(table(spark, d, "lineitem"), "l_returnflag", FLAG_LABELS).select("l_suppkey", *LINE_ORDER, "l_quantity", "label")
    cut = windows.cut_windows(windows.label_runs(rows, ["l_suppkey"], LINE_ORDER, "label", "strict"), 4, 2)
    return rounded(cut.groupBy("l_suppkey", "run", "widx").agg(F.max("label").alias("label"), F.count("*").alias("len"), F.avg("l_quantity").alias("mean_quantity"), F.avg("l_extendedprice").alias("mean_price")))


@query("windows_limit", f"select * from ({windows_sql('strict', 2, 1)}) order by user_id, run, widx limit 100")
def _(spark, d):
    """The limit is the feature."""
    return rounded(windows.first_windows(event_windows(spark, d, "strict", 2, 1), ["user_id", "run", "widx"], 100))


@query("runs_conversations", """with l as (select *, row_number() over w as rn, lag(role) over w as pl from conversations window w as (partition by conv_id order by turn)),
 r as (select *, cast(sum(case when rn > 1 and pl is not distinct from role then 0 else 1 end) over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) as run from l)
select conv_id, run, max(role) as role, count(*) as n_rows from r where role is not null group by 1, 2""")
def _(spark, d):
    return windows.run_table(windows.label_runs(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role", "strict"), ["conv_id"], "role")


@query("class_counts_zero_filled", f"with {windows_sql('strict', 3, 1)[5:].replace('select w.user_id', ', ww as (select w.user_id', 1)}) select k.k as label, count(ww.label) as n from (select unnest(range(0, 4))::int as k) k left join ww on ww.label = k.k group by 1")
def _(spark, d):
    counts = event_windows(spark, d, "strict", 3, 1).groupBy("label").agg(F.count("*").alias("n"))
    return spark.range(4).select(F.col("id").cast("int").alias("label")).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


# Splits.


@query("loso_folds", "with s as (select distinct user_id from events) select a.user_id as held_out, b.user_id, case when a.user_id = b.user_id then 'held_out' else 'pool' end as split from s a, s b")
def _(spark, d):
    return splits.loso_folds(table(spark, d, "events"), "user_id")


@query("loso_fold_numbers", "select user_id, row_number() over (order by user_id) - 1 as fold from (select distinct user_id from events where user_id is not null)")
def _(spark, d):
    return splits.loso_fold_numbers(table(spark, d, "events"), "user_id")


SUBJECT_SPLIT = splits.draw_subjects(list(range(1, 41)), 7)


@query("subject_split", "with a(user_id, split) as (values " + ", ".join(f"({k}, '{v}')" for k, v in SUBJECT_SPLIT.items()) + ") select e.user_id, coalesce(a.split, 'undeclared') as split, count(*) as n_rows from events e left join a using (user_id) group by 1, 2")
def _(spark, d):
    return splits.assign_split(table(spark, d, "events"), "user_id", SUBJECT_SPLIT, outside="undeclared").groupBy("user_id", "split").agg(F.count("*").alias("n_rows"))


@query("split_counts", f"with {windows_sql('strict', 2, 1)[5:].replace('select w.user_id', ', ww as (select w.user_id', 1)}), a(user_id, split) as (values " + ", ".join(f"({k}, '{v}')" for k, v in SUBJECT_SPLIT.items()) + ") select coalesce(a.split, 'undeclared') as split, count(*) as n_windows, cast(count(distinct ww.user_id) as bigint) as n_subjects from ww left join a using (user_id) group by 1")
def _(spark, d):
    return splits.assign_split(event_windows(spark, d, "strict", 2, 1), "user_id", SUBJECT_SPLIT, outside="undeclared").groupBy("split").agg(F.count("*").alias("n_windows"), F.count_distinct("user_id").alias("n_subjects"))


def all_subjects_split(spark, d):
    """A draw over every user of the table, the least one held out."""
    users = sorted(r.user_id for r in table(spark, d, "events").select("user_id").where("user_id is not null").distinct().collect())
    return splits.draw_subjects(users, users[0])


@query("subject_split_all")
def _(spark, d):
    return splits.assign_split(table(spark, d, "events"), "user_id", all_subjects_split(spark, d)).groupBy("user_id", "split").agg(F.count("*").alias("n_rows"))


@query("split_counts_all")
def _(spark, d):
    return splits.assign_split(event_windows(spark, d, "strict", 2, 1), "user_id", all_subjects_split(spark, d)).groupBy("split").agg(F.count("*").alias("n_windows"), F.count_distinct("user_id").alias("n_subjects"))


@query("stratified_allocation", """with c as (select label, count(*) as n from embeddings group by 1), t as (select *, sum(n) over () as total, count(*) over () as k, min(n) over () as least from c),
 u as (select *, cast(greatest(1, ceil(total * 0.2e0)) as bigint) as n_val from t), v as (select *, n * n_val / cast(total as double) as ideal from u), w as (select *, cast(greatest(1, floor(ideal)) as bigint) as base from v),
 x as (select *, n_val - sum(base) over () as rest, row_number() over (order by ideal - floor(ideal) desc, label) as rnk from w)
select label, n, n_val >= k and total - n_val >= k and least >= 2 as stratified, case when n_val >= k and total - n_val >= k and least >= 2 then cast(least(base + case when rnk <= rest then 1 else 0 end, n - 1) as bigint) end as n_validation from x""".replace("least >= 2", '"least" >= 2').replace("min(n) over () as least", 'min(n) over () as "least"'))
def _(spark, d):
    return splits.stratified_allocation(table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")), "label", "n")


@query(
    "stratified_split",
    f"""with r as (select vec_id, label, row_number() over (partition by label order by substring(md5('42/' || vec_id), 1, 15), vec_id) as rn from embeddings)
select vec_id, r.label, case when rn <= n_validation then 'validation' else 'train' end as split from r join ({ORACLE_SQL["stratified_allocation"]}) a on a.label = r.label""",
)
def _(spark, d):
    return splits.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query("scenario_populations", f"""with {EMB}, a as (select *, row_number() over (partition by label order by vec_id) as r from emb where not synthetic), b as (select *, row_number() over (partition by label order by vec_id) as r from emb where synthetic),
 u as (select 'trtr' as scenario, 'real' as origin, label from a union all select 'scarce', 'real', label from a where r <= 5 union all select 'tstr', 'synthetic', label from b where r <= 10
  union all select 'tstr_scarce', 'synthetic', label from b where r <= 10 union all select 'tstr_scarce', 'real', label from a where r <= 5)
select scenario, origin, label, count(*) as n from u group by 1, 2, 3""")
def _(spark, d):
    e = embeddings(spark, d).select("vec_id", "label", "synthetic")
    return splits.scenario_populations(e.where("not synthetic"), e.where("synthetic"), "label", "vec_id", scarce=5, synthetic_cap=10).groupBy("scenario", "origin", "label").agg(F.count("*").alias("n"))


# Standardisation and duplicate audit.

FIT = "f as (select channel, avg(x) as m, greatest(stddev_pop(x), 1e-8) as sd from s where fold <> 0 group by 1)"


@query("zscore_fit", f"with {EMB}, {FIT} select cast(channel as int) as channel, round(m, 8) as mean, round(sd, 8) as std from f")
def _(spark, d):
    return rounded(standardize.fit(samples(spark, d).where("fold <> 0")), 8)


@query("zscore_apply", f"with {EMB}, {FIT} select vec_id, cast(s.channel as int) as channel, cast(t as int) as t, round((x - m) / sd, 6) as z from s join f using (channel)")
def _(spark, d):
    e = embeddings(spark, d)
    z = e.select("vec_id", F.posexplode(fitted(e).apply("embedding", T, "double")).alias("i", "z"))
    return rounded(z.select("vec_id", F.expr(f"i div {T}").cast("int").alias("channel"), (F.col("i") % T).alias("t"), "z"))


def fitted(e: DataFrame) -> standardize.Standardizer:
    return standardize.Standardizer().fit(standardize.explode_channels(e.where("fold <> 0"), "embedding", T, []))


@query("zscore_inverse", f"with {EMB}, {FIT} select vec_id, cast(s.channel as int) as channel, round(sum(abs(((x - m) / sd) * sd + m - x)), 6) as off from s join f using (channel) group by 1, 2")
def _(spark, d):
    e, own = embeddings(spark, d), fitted(embeddings(spark, d))
    back = e.withColumn("z", own.apply("embedding", T, "double")).withColumn("back", own.inverse("z", T, "double"))
    off = lambda c: F.aggregate(F.slice(F.zip_with("back", "embedding", lambda a, b: F.abs(a - b)), c * T + 1, T), F.lit(0.0), lambda s, v: s + v)
    return rounded(back.select("vec_id", F.posexplode(F.array(*[off(c) for c in range(C)])).alias("channel", "off")))


@query("zscore_floor", "select 0 as channel, 1e0 as mean, 1e-8 as std")
def _(spark, d):
    return standardize.fit(table(spark, d, "events").select(F.lit(0).alias("channel"), F.lit(1.0).alias("x")))


DIG = "g as (select case doc_id % 10 when 0 then 'held_out' when 1 then 'validation' else 'train' end as split, sha1(text) as digest, count(*) as n from documents group by 1, 2)"


def digests(spark, d):
    split = F.when(F.col("doc_id") % 10 == 0, "held_out").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    return table(spark, d, "documents").select(split.alias("split"), audit.text_digest(F.col("text")).alias("digest"))


@query("dup_digest", f"with {DIG} select digest, split, n from g")
def _(spark, d):
    return audit.digest_counts(digests(spark, d), "split", "digest")


@query("dup_cross_split", f"with {DIG} select a.split as left_split, b.split as right_split, count(*) as n_digests, cast(sum(a.n) as bigint) as left_windows, cast(sum(b.n) as bigint) as right_windows from g a join g b on a.digest = b.digest and a.split < b.split group by 1, 2")
def _(spark, d):
    return audit.cross_split_duplicates(digests(spark, d), "split", "digest")


@query("dup_within_split", f"with {DIG} select split, count(*) as n_digests, cast(sum(n - 1) as bigint) as n_extra from g where n > 1 group by 1")
def _(spark, d):
    return audit.within_split_duplicates(digests(spark, d), "split", "digest")


@query("dup_train_validation", f"with {DIG} select 'train' as left_split, 'validation' as right_split, count(*) as n_digests, cast(sum(a.n) as bigint) as left_windows, cast(sum(b.n) as bigint) as right_windows from g a join g b on a.digest = b.digest and a.split = 'train' and b.split = 'validation' having count(*) > 0")
def _(spark, d):
    return audit.train_validation_duplicates(digests(spark, d), "split", "digest")


@query("window_sha1_bytes")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", audit.window_digest("embedding").alias("digest"))


# Classification metrics.

CELLS = """k as (select cast(unnest(range(10)) as int) as k), n as (select label, pred, count(*) as n from emb group by 1, 2), cells as (select a.k as truth, b.k as pred, coalesce(n.n, 0) as n from k a cross join k b left join n on n.label = a.k and n.pred = b.k)"""
F1 = "f1 as (select k.k as label, sum(case when truth = k.k and c.pred = k.k then n else 0 end) as tp, sum(case when truth <> k.k and c.pred = k.k then n else 0 end) as fp, sum(case when truth = k.k and c.pred <> k.k then n else 0 end) as fn from k, cells c group by 1)"


def cells(spark, d, by=()):
    return metrics.confusion(embeddings(spark, d), list(by), "label", "pred", 10)


@query("confusion", f"with {EMB}, {CELLS} select * from cells")
def _(spark, d):
    return cells(spark, d)


@query("confusion_normalized", f"with {EMB}, {CELLS} select truth, pred, round(n / nullif(cast(sum(n) over (partition by truth) as double), 0), 8) as share from cells")
def _(spark, d):
    return rounded(metrics.normalized_confusion(cells(spark, d), []), 8)


@query("class_f1", f"with {EMB}, {CELLS}, {F1} select label, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0), 8) as f1 from f1")
def _(spark, d):
    return rounded(metrics.class_f1(cells(spark, d), []), 8)


@query("macro_f1_accuracy", f"with {EMB}, {CELLS}, {F1} select round(avg(coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0)), 8) as macro_f1, round(cast(sum(tp) as double) / sum(tp + fn), 8) as accuracy, cast(sum(tp + fn) as bigint) as n from f1")
def _(spark, d):
    return rounded(metrics.macro_f1_accuracy(cells(spark, d), []), 8)


FOLDS = "fa as (select fold, avg(case when label = pred then 1e0 else 0e0 end) as acc from emb group by 1)"


def fold_accuracy(spark, d):
    return metrics.macro_f1_accuracy(cells(spark, d, ["fold"]), ["fold"]).select("fold", F.col("accuracy").alias("acc"))


@query("fold_metrics_summary", f"with {EMB}, {FOLDS} select count(*) as n, round(avg(acc), 8) as mean, round(stddev_samp(acc), 8) as sd_sample from fa")
def _(spark, d):
    return rounded(metrics.mean_sample_sd(fold_accuracy(spark, d), [], "acc"), 8)


SCEN = "sc as (select fold, case when synthetic then 'tstr' else 'trtr' end as scenario, avg(case when label = pred then 1e0 else 0e0 end) as acc from (select vec_id % 4 as fold, synthetic, label, pred from emb) group by 1, 2)"


def scenario_accuracy(spark, d):
    e = embeddings(spark, d).select((F.col("vec_id") % 4).alias("fold"), F.when(F.col("synthetic"), "tstr").otherwise("trtr").alias("scenario"), (F.col("label") == F.col("pred")).cast("double").alias("hit"))
    return e.groupBy("fold", "scenario").agg(F.avg("hit").alias("acc"))


@query("retention", f"with {EMB}, {SCEN} select a.fold, a.scenario, round(a.acc, 8) as acc, round(case when a.scenario = 'trtr' then 1e0 else a.acc / (b.acc + 1e-8) end, 8) as retention from sc a join sc b on a.fold = b.fold and b.scenario = 'trtr'")
def _(spark, d):
    return rounded(metrics.retention(scenario_accuracy(spark, d), "fold", "scenario", "acc"), 8)


@query("confusion_nanmean", """with e as (select vec_id % 4 as fold, label as truth, (label + (case when vec_id % 5 = 0 then 1 else 0 end)) % 10 as pred from embeddings), k as (select cast(unnest(range(10)) as int) as k),
 f as (select distinct fold from e), n as (select fold, truth, pred, count(*) as n from e group by 1, 2, 3), c as (select f.fold, a.k as truth, b.k as pred, coalesce(n.n, 0) as n from f cross join k a cross join k b left join n on n.fold = f.fold and n.truth = a.k and n.pred = b.k),
 s as (select *, n / nullif(cast(sum(n) over (partition by fold, truth) as double), 0) as share from c) select truth, pred, round(avg(share), 8) as mean_share, count_if(coalesce(share > 1e-6, false)) as n_folds from s group by 1, 2""")
def _(spark, d):
    e = embeddings(spark, d).withColumn("fold", F.col("vec_id") % 4)
    shares = metrics.normalized_confusion(metrics.confusion(e, ["fold"], "label", "pred", 10), ["fold"])
    return rounded(metrics.mean_confusions(shares), 8)


@query("reference_comparison", f"with {EMB}, {SCEN}, r(fold, scenario, expected) as (values (0, 'trtr', 0.8e0), (1, 'trtr', 0.75e0), (2, 'tstr', 0.7e0), (9, 'tstr', 0.7e0)) select cast(sc.fold as bigint) as fold, sc.scenario, round(sc.acc - r.expected, 8) as diff, round(abs(sc.acc - r.expected), 8) as abs_diff from sc join r on r.fold = sc.fold and r.scenario = sc.scenario")
def _(spark, d):
    r = spark.createDataFrame([(0, "trtr", 0.8), (1, "trtr", 0.75), (2, "tstr", 0.7), (9, "tstr", 0.7)], "fold bigint, scenario string, expected double")
    diff = F.col("acc") - F.col("expected")
    return rounded(scenario_accuracy(spark, d).join(F.broadcast(r), ["fold", "scenario"]).select("fold", "scenario", diff.alias("diff"), F.abs(diff).alias("abs_diff")), 8)


GRID = [(length, hop) for length in (1, 2, 3) for hop in (1, 2, 3)]
GRID_SQL = f"""{runs_sql('strict')}, g(win_len, hop) as (values {', '.join(map(str, GRID))}),
 gw as (select user_id, run, win_len, hop, unnest(range(0, (n - win_len) // hop + 1)) as widx from (select distinct user_id, run, n from p), g where n >= win_len),
 x as (select gw.user_id, gw.run, win_len, hop, widx, max(label) as label, max(value) as top from gw join p on p.user_id = gw.user_id and p.run = gw.run and p.pos >= widx * hop and p.pos < widx * hop + win_len group by 1, 2, 3, 4, 5),
 c as (select win_len, hop, user_id % 4 as fold, user_id // 4 % 2 = 1 as syn, label, coalesce(cast(floor(top) as bigint) % 4, 0) as pred from x),
 k as (select unnest(range(4)) as k), fs as (select distinct win_len, hop, fold, syn from c),
 f as (select fs.*, k, coalesce(2e0 * count_if(label = k and pred = k) / nullif(2e0 * count_if(label = k and pred = k) + count_if(label <> k and pred = k) + count_if(label = k and pred <> k), 0), 0) as f1
  from fs join c using (win_len, hop, fold, syn), k group by all),
 m as (select win_len, hop, fold, syn, avg(f1) as f1 from f group by 1, 2, 3, 4), a as (select win_len, hop, fold, syn, avg(case when label = pred then 1e0 else 0e0 end) as acc from c group by 1, 2, 3, 4),
 v as (select win_len, hop, fold, case when syn then 'tstr_macro_f1' else 'trtr_macro_f1' end as metric, f1 as v from m union all select win_len, hop, fold, case when syn then 'tstr_accuracy' else 'trtr_accuracy' end, acc from a
  union all select win_len, hop, fold, 'tstr_f1_' || k, f1 from f where syn
  union all select r.win_len, r.hop, r.fold, 'macro_f1_retention', s.f1 / (r.f1 + 1e-8) from m r join m s on r.win_len = s.win_len and r.hop = s.hop and r.fold = s.fold and s.syn and not r.syn),
 nf as (select win_len, hop, count(distinct fold) as n_folds from c group by 1, 2)"""


@query("sensitivity_summary", f"with {GRID_SQL} select cast(win_len as bigint) as win_len, cast(hop as bigint) as hop, metric, n_folds, count(*) as n, round(avg(v), 8) as mean, round(case when count(*) = 1 then 0 else stddev_samp(v) end, 8) as sd from v join nf using (win_len, hop) group by 1, 2, 3, 4")
def _(spark, d):
    """Real windows of every setting, classed by their greatest value; odd fours of users stand for synthetic ones."""
    runs = windows.label_runs(events(spark, d).select("user_id", "ts", "event_id", "value", "label"), ["user_id"], ["ts", "event_id"], "label", "strict")
    w = windows.cut_grid(runs, GRID).groupBy("win_len", "hop", "user_id", "run", "widx").agg(F.max("label").alias("label"), F.max("value").alias("top"))
    kind = F.when(F.floor(F.col("user_id") / 4) % 2 == 1, "tstr").otherwise("trtr")
    w = w.select("win_len", "hop", (F.col("user_id") % 4).alias("fold"), kind.alias("kind"), "label", F.coalesce(F.floor("top") % 4, F.lit(0)).cast("int").alias("pred"))
    by = ["win_len", "hop", "fold", "kind"]
    cells_ = metrics.confusion(w, by, "label", "pred", 4)
    both = metrics.macro_f1_accuracy(cells_, by)
    side = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}")
    records = both.groupBy(*by[:3]).agg(*[side(c, k) for c in ("macro_f1", "accuracy") for k in ("trtr", "tstr")])
    records = records.withColumn("macro_f1_retention", F.col("tstr_macro_f1") / (F.col("trtr_macro_f1") + metrics.NEAR_ZERO))
    own = metrics.class_f1(cells_, by).where("kind = 'tstr'").groupBy(*by[:3]).agg(F.map_from_entries(F.collect_list(F.struct("label", "f1"))).alias("tstr_per_class_f1"))
    return rounded(privacy.sensitivity_grid(records.join(own, by[:3], "left"), grid=GRID), 8)


# Signals and spectra.


@query("signal_summary", f"""with {EMB}, v as (select vec_id, channel, var_pop(x) as v from s group by 1, 2), vs as (select channel, avg(v) as variance_mean, quantile_cont(v, 0.5) as variance_median, avg(case when v <= 1e-12 then 1e0 else 0e0 end) as near_constant from v group by 1),
 t as (select channel, avg(x) as mean, stddev_pop(x) as std, min(x) as min, max(x) as max, sqrt(avg(x * x)) as rms, var_pop(x) as variance, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr from s group by 1)
select cast(channel as int) as channel, round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min, round(max, 6) as max, round(rms, 6) as rms, round(variance, 6) as variance, round(iqr, 6) as iqr, round(variance_mean, 6) as variance_mean, round(variance_median, 6) as variance_median, round(near_constant, 6) as near_constant from t join vs using (channel)""")
def _(spark, d):
    return rounded(signal.signal_summary(samples(spark, d), ["vec_id"]))


@query("norm_over_windows", f"with {EMB}, a as (select channel, t, sqrt(sum(x * x)) as n from s group by 1, 2) select cast(channel as int) as channel, round(avg(n), 6) as norm_mean, round(stddev_pop(n), 6) as norm_std from a group by 1")
def _(spark, d):
    return rounded(signal.norm_over_windows(samples(spark, d)))


@query("window_variance", f"with {EMB} select vec_id, cast(channel as int) as channel, round(var_pop(x), 6) as variance from s group by 1, 2")
def _(spark, d):
    return rounded(signal.window_variances(samples(spark, d), ["vec_id"]))


@query("near_constant", f"with {EMB}, v as (select vec_id, channel, var_pop(x) as v from s group by 1, 2) select cast(channel as int) as channel, count_if(v <= 1e-12) as n_near_constant, count(*) as n from v group by 1")
def _(spark, d):
    return signal.window_variances(samples(spark, d), ["vec_id"]).groupBy("channel").agg(F.count_if(F.col("variance") <= signal.NEAR_CONSTANT).alias("n_near_constant"), F.count("*").alias("n"))


@query("magnitude_summary", f"""with {EMB}, p as (select vec_id, t, sqrt(sum(x * x)) as m from s where channel < 3 group by 1, 2)
select count(*) as n_points, count_if(m > 0.05 * 9.80665) as n_over, round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std, round(quantile_cont(m, 0.5), 6) as median, round(quantile_cont(m, 0.95), 6) as p95, round(quantile_cont(m, 0.99), 6) as p99, round(max(m), 6) as max, round(100e0 * count_if(m > 0.05 * 9.80665) / count(*), 6) as pct_over from p""")
def _(spark, d):
    e = embeddings(spark, d).select("vec_id", *[F.slice("embedding", 1 + T * c, T).alias(f"c{c}") for c in range(3)])
    p = e.select("vec_id", F.explode(F.arrays_zip("c0", "c1", "c2")).alias("p")).select(*[F.col(f"p.c{c}").cast("double").alias(f"c{c}") for c in range(3)])
    return rounded(signal.magnitude_summary(p, "c0", "c1", "c2", 0.05))


DFT = "d as (select vec_id, label, synthetic, channel, k, case when k = 0 then 0e0 else pow(sum(x * cos(2 * pi() * k * t / 16)), 2) + pow(sum(x * sin(2 * pi() * k * t / 16)), 2) end as power from s, (select unnest(range(9)) as k) group by 1, 2, 3, 4, 5)"


@query("dft_power", f"with {EMB}, {DFT} select vec_id, cast(channel as int) as channel, cast(k as int) as k, round(power, 6) as power from d")
def _(spark, d):
    return rounded(spectral.dft_power(embeddings(spark, d), ["vec_id"], "embedding", T))


@query("spectral_summary", f"""with {EMB}, {DFT}, p as (select channel, k, avg(power) as p, k * 50e0 / 16 as f from d group by 1, 2), q as (select *, (f - lag(f) over (partition by channel order by k)) * (p + lag(p) over (partition by channel order by k)) / 2 as area from p)
select cast(channel as int) as channel, round(sum(area), 5) as total, min_by(f, -p) as dominant, round(sum(f * p) / sum(p), 5) as centroid, round(sum(case when f <= 2 then p else 0 end) / sum(p), 5) as low, round(sum(case when f > 2 and f <= 10 then p else 0 end) / sum(p), 5) as mid, round(sum(case when f > 10 and f <= 25 then p else 0 end) / sum(p), 5) as high from q group by 1""")
def _(spark, d):
    return rounded(spectral.spectral_summary(spectral.dft_power(embeddings(spark, d), ["vec_id"], "embedding", T), ["channel"], RATE, T), 5)


PSD = """h as (select t as ht, 0.5e0 - 0.5e0 * cos(2 * pi() * t / 16) as h from (select unnest(range(16)) as t)), sc as (select 50e0 * sum(h * h) as scale from h), mm as (select *, x - avg(x) over (partition by vec_id, channel) as y from s),
 q as (select vec_id, synthetic, channel, k, sum(y * h * cos(2 * pi() * k * t / 16)) as re, sum(y * h * sin(2 * pi() * k * t / 16)) as im from mm join h on ht = t, (select unnest(range(9)) as k) group by 1, 2, 3, 4),
 psd as (select vec_id, synthetic, channel, k, k * 50e0 / 16 as freq, (case when k in (0, 8) then 1e0 else 2e0 end) * (re * re + im * im) / scale as psd from q, sc)"""


def psd(spark, d):
    return spectral.welch_psd(embeddings(spark, d), ["vec_id", "synthetic"], "embedding", T, RATE)


@query("welch_psd", f"with {EMB}, {PSD} select vec_id, synthetic, cast(channel as int) as channel, cast(k as int) as k, freq, round(psd, 8) as psd from psd")
def _(spark, d):
    return psd(spark, d).withColumn("psd", F.round("psd", 8))


@query("fold_psd", f"""with {EMB}, {PSD}, pf as (select vec_id % 4 as fold, channel, freq, avg(psd) as psd from psd group by 1, 2, 3)
select cast(channel as int) as channel, freq, round(avg(psd), 8) as psd_mean, round(stddev_pop(psd), 8) as psd_sd_pop from pf group by 1, 2""")
def _(spark, d):
    return rounded(spectral.fold_psd(psd(spark, d).withColumn("fold", F.col("vec_id") % 4), "fold", ["channel", "freq"]), 8)


MEANS = "mp as (select case when synthetic then 'synthetic' else 'real' end as kind, freq, avg(psd) as psd from psd group by 1, 2)"


def mean_spectra(spark, d):
    p = psd(spark, d).withColumn("kind", F.when(F.col("synthetic"), "synthetic").otherwise("real"))
    return p.groupBy("kind", "freq").agg(F.avg("psd").alias("psd"))


@query("band_power_ratio", f"with {EMB}, {PSD}, {MEANS}, tr as (select kind, (freq - lag(freq) over (partition by kind order by freq)) * (psd + lag(psd) over (partition by kind order by freq)) / 2 as a from mp where freq between 10 and 25) select round(sum(case when kind = 'synthetic' then a end) / nullif(sum(case when kind = 'real' then a end), 0), 6) as ratio from tr")
def _(spark, d):
    return rounded(spectral.band_ratio(mean_spectra(spark, d), "kind", "real", "synthetic", 10, 25))


@query("log_psd_corr", f"with {EMB}, {PSD}, {MEANS} select round(corr(ln(a.psd), ln(b.psd)), 6) as log_psd_corr, count(*) as n_bins from mp a join mp b on a.freq = b.freq where a.kind = 'real' and b.kind = 'synthetic' and a.freq > 0 and a.psd > 0 and b.psd > 0")
def _(spark, d):
    m = mean_spectra(spark, d).where("freq > 0").groupBy("freq").agg(*[F.max(F.when(F.col("kind") == k, F.col("psd"))).alias(k) for k in ("real", "synthetic")])
    return rounded(spectral.log_correlation(m, "real", "synthetic"))


CHANNEL_BINS = """cb as (select channel, freq, case when synthetic then 'synthetic' else 'real' end as kind, avg(psd) as psd, stddev_pop(psd) as sd from psd group by 1, 2, 3),
 b as (select r.channel, r.freq, r.psd as rp, y.psd as sp, r.sd as rsd, y.sd as ssd from cb r join cb y on y.channel = r.channel and y.freq = r.freq and r.kind = 'real' and y.kind = 'synthetic'),
 tr as (select *, lag(freq) over w as from_, (freq - lag(freq) over w) * (rp + lag(rp) over w) / 2 as ra, (freq - lag(freq) over w) * (sp + lag(sp) over w) / 2 as sa from b window w as (partition by channel order by freq)),
 st as (select cast(channel as int) as channel, corr(case when rp > 0 and sp > 0 then ln(rp) end, case when rp > 0 and sp > 0 then ln(sp) end) as log_psd_corr,
  sum(case when from_ >= 0 and freq <= 25 then sa end) / nullif(sum(case when from_ >= 0 and freq <= 25 then ra end), 0) as ratio_0_25hz,
  sum(case when from_ >= 10 and freq <= 25 then sa end) / nullif(sum(case when from_ >= 10 and freq <= 25 then ra end), 0) as ratio_10_25hz,
  sum(case when from_ >= 0 and freq <= 2 then sa end) / nullif(sum(case when from_ >= 0 and freq <= 2 then ra end), 0) as ratio_0_2hz,
  avg(case when rsd > 0 then ssd / rsd end) as sd_ratio from tr group by 1)"""


def channel_bins(spark, d):
    p = psd(spark, d).groupBy("channel", "freq", "synthetic").agg(F.avg("psd").alias("m"), F.stddev_pop("psd").alias("s"))
    side = lambda c, s: F.max(F.when(F.col("synthetic") == s, F.col(c)))
    return p.groupBy("channel", "freq").agg(side("m", False).alias("real"), side("m", True).alias("synthetic"), side("s", False).alias("real_sd"), side("s", True).alias("synthetic_sd"))


@query("spectral_statistics", f"with {EMB}, {PSD}, {CHANNEL_BINS} select channel, round(log_psd_corr, 6) as log_psd_corr, round(ratio_0_25hz, 6) as ratio_0_25hz, round(ratio_10_25hz, 6) as ratio_10_25hz, round(ratio_0_2hz, 6) as ratio_0_2hz, round(sd_ratio, 6) as sd_ratio from st")
def _(spark, d):
    return rounded(spectral.spectral_statistics(channel_bins(spark, d)))


@query("spectral_statistics_mean", f"""with {EMB}, {PSD}, {CHANNEL_BINS} select round(avg(log_psd_corr), 6) as log_psd_corr, round(avg(ratio_0_25hz), 6) as ratio_0_25hz, round(avg(ratio_10_25hz), 6) as ratio_10_25hz,
 case when count(ratio_0_2hz) = count(*) then round(avg(ratio_0_2hz), 6) end as ratio_0_2hz, round(avg(sd_ratio), 6) as sd_ratio, avg(ratio_10_25hz) < 1 as attenuated from st""")
def _(spark, d):
    return rounded(spectral.mean_statistics(spectral.spectral_statistics(channel_bins(spark, d))))


WELCH8 = """h as (select t as ht, 0.5e0 - 0.5e0 * cos(2 * pi() * t / 8) as h from (select unnest(range(8)) as t)), sc as (select 50e0 * sum(h * h) as scale from h),
 sg as (select vec_id, channel, g, t - 4 * g as t, x from s, (select unnest(range(3)) as g) where t >= 4 * g and t < 4 * g + 8), mm as (select *, x - avg(x) over (partition by vec_id, channel, g) as y from sg),
 q as (select vec_id, channel, g, k, sum(y * h * cos(2 * pi() * k * t / 8)) as re, sum(y * h * sin(2 * pi() * k * t / 8)) as im from mm join h on ht = t, (select unnest(range(5)) as k) group by 1, 2, 3, 4)"""


@query("welch_psd_segments", f"with {EMB}, {WELCH8} select vec_id, cast(channel as int) as channel, cast(k as int) as k, k * 50e0 / 8 as freq, round(avg((case when k in (0, 4) then 1e0 else 2e0 end) * (re * re + im * im) / scale), 8) as psd from q, sc group by 1, 2, 3, 4")
def _(spark, d):
    return rounded(spectral.welch_psd(embeddings(spark, d), ["vec_id"], "embedding", T, RATE, nperseg=8), 8)


@query("compare_mean_windows", f"with {EMB}, a as (select channel, t, avg(case when not synthetic then x end) as r, avg(case when synthetic then x end) as y from s group by 1, 2) select round(avg((r - y) * (r - y)), 8) as mse, round(avg(abs(r - y)), 8) as mae from a")
def _(spark, d):
    s = samples(spark, d)
    return rounded(signal.compare_means(s.where("not synthetic"), s.where("synthetic")), 8)


FEAT = "ft as (select label, channel, unnest(range(6)) as j, [avg(x), stddev_pop(x), min(x), max(x), sqrt(avg(x * x)), quantile_cont(x, 0.75) - quantile_cont(x, 0.25)] as f from s where channel < 3 group by 1, 2), fv as (select label, channel * 6 + j as at, f[j + 1] as v from ft)"


@query("feature_vector", f"with {EMB}, {FEAT} select label, cast(at as int) as at, round(v, 6) as v from fv".replace(" at ", ' "at" ').replace("as at", 'as "at"').replace("(at as", '("at" as'))
def _(spark, d):
    return rounded(signal.features(samples(spark, d), ["label"]).select("label", F.posexplode("features").alias("at", "v")))


@query("class_feature_distance", f"with {EMB}, {FEAT} select a.label, b.label as other, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) as distance from fv a join fv b on a.\"at\" = b.\"at\" group by 1, 2".replace("as at", 'as "at"'))
def _(spark, d):
    return rounded(signal.feature_distances(signal.features(samples(spark, d), ["label"]), "label"))


# Latents and flows.


def pairs(spark, d):
    """Each latent with its reverse as noise and a time in [0, 1)."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("z1"), F.reverse("embedding").alias("z0"), (F.col("vec_id") % 8 / F.lit(8.0)).alias("t"))


PAIR = "pr as (select vec_id, label, i, cast(embedding[i + 1] as double) as z1, cast(embedding[64 - i] as double) as z0, (vec_id % 8) / 8e0 as t from (select *, unnest(range(64)) as i from embeddings))"


@query("latent_class_params", "with p as (select label, unnest(range(64)) as pos, embedding from embeddings) select label, cast(pos as int) as pos, round(avg(cast(embedding[pos + 1] as double)), 8) as mean, round(stddev_pop(cast(embedding[pos + 1] as double)) + 1e-6, 8) as std from p group by 1, 2")
def _(spark, d):
    return rounded(latent.class_parameters(table(spark, d, "embeddings"), "label", "embedding"), 8)


def normal_sql(*keys: str) -> str:
    digest = "md5(concat_ws('/', " + ", ".join(keys) + "))"
    part = lambda first: f"((cast('0x' || substring({digest}, {first}, 8) as bigint) + 0.5e0) / 4294967296e0)"
    return f"sqrt(-2 * ln({part(1)})) * cos(2 * pi() * {part(9)})"


@query(
    "latent_class_samples",
    f"""with p as (select label, unnest(range(64)) as pos, embedding from embeddings),
 c as (select label, pos, avg(cast(embedding[pos + 1] as double)) as m, stddev_pop(cast(embedding[pos + 1] as double)) + 1e-6 as sd from p group by 1, 2),
 d as (select *, unnest(range(20)) as sample from c)
select label, cast(sample as int) as sample, cast(pos as int) as pos, round(cast(cast(m + sd * {normal_sql("'42'", "label", "sample", "pos")} as float) as double), 4) + 0e0 as latent from d""",
)
def _(spark, d):
    drawn = latent.class_samples(latent.class_parameters(table(spark, d, "embeddings"), "label", "embedding"), "label", 20)
    return rounded(drawn.select("label", "sample", F.posexplode("latent").alias("pos", "latent")).withColumn("latent", F.col("latent").cast("double")), 4)


@query(
    "augment_batch",
    f"""with {EMB}, u as (select vec_id, channel, t, x + 0.008e0 * {normal_sql("'42/jitter'", "vec_id", "channel * 16 + t")} as y,
  1 + 0.04e0 * {normal_sql("'42/scale'", "vec_id", "channel")} as f,
  (cast('0x' || substring(md5(concat_ws('/', '42/mask', vec_id, t)), 1, 8) as bigint) + 0.5e0) / 4294967296e0 < 0.05e0 as gone from s)
select vec_id, cast(channel * 16 + t as int) as i, round(cast(cast(case when gone then 0e0 else y * f end as float) as double), 4) + 0e0 as x from u""",
)
def _(spark, d):
    changed = table(spark, d, "embeddings").select("vec_id", latent.augment("embedding", T, F.col("vec_id")).alias("w"))
    return rounded(changed.select("vec_id", F.posexplode("w").alias("i", "x")).withColumn("x", F.col("x").cast("double")), 4)


@query("latent_diagnostics", f"""with {PAIR}, c as (select i, var_pop(z1) as own from (select unnest(embedding)::double as z1, generate_subscripts(embedding, 1) as i from embeddings) group by 1)
select round(avg(abs(z1)), 8) as mean_abs_mu, round(var_pop(z1), 8) as var_mu, round(avg(exp(z0 / 2)), 8) as mean_std, (select round(avg(case when own <= 1e-12 then 1e0 else 0e0 end), 8) from c) as constant_share from pr""")
def _(spark, d):
    return rounded(latent.diagnostics(pairs(spark, d), "z1", "z0"), 8)



@query("batch_mean_mse", f"with {PAIR}, m as (select vec_id, avg((z1 - z0) * (z1 - z0)) as mse from pr group by 1), b as (select vec_id // 128 as b, avg(mse) as m from m group by 1) select round(avg(m), 8) as mean_mse, count(*) as n_batches from b")
def _(spark, d):
    m = pairs(spark, d).select("vec_id", latent.mean_square(F.col("z0"), F.col("z1")).alias("mse"))
    return rounded(latent.mean_of_batch_means(m, "vec_id", "mse"), 8)


@query("flow_interpolate", f"with {PAIR} select vec_id, cast(i as int) as i, round((1 - t) * z0 + t * z1, 8) as zt, round(z1 - z0, 8) as v from pr")
def _(spark, d):
    z0, z1 = F.col("z0"), F.col("z1")
    both = pairs(spark, d).select("vec_id", F.posexplode(F.arrays_zip(latent.interpolate(z0, z1, F.col("t")).alias("zt"), latent.velocity(z0, z1).alias("v"))).alias("i", "x"))
    return both.select("vec_id", "i", F.round("x.zt", 8).alias("zt"), F.round("x.v", 8).alias("v"))


@query("flow_loss", f"with {PAIR} select round(avg((z1 - z0) * (z1 - z0)), 8) as loss, round(avg(1000 * t), 8) as mean_model_time from pr")
def _(spark, d):
    return rounded(pairs(spark, d).agg(F.avg(latent.mean_square(F.col("z0"), F.col("z1"))).alias("loss"), F.avg(1000 * F.col("t")).alias("mean_model_time")), 8)


@query("euler_trajectory", f"with {PAIR}, st as (select unnest([0, 2, 4, 6, 8, 10]) as step) select vec_id, step, round(sum(z1 - (z1 - z0) * step / 10e0), 6) as total, round(max(z1 - (z1 - z0) * step / 10e0), 6) as top from pr, st group by 1, 2")
def _(spark, d):
    return trajectories(pairs(spark, d))


@query("euler_trajectory_all")
def _(spark, d):
    return trajectories(pairs(spark, d))


def trajectories(p):
    p = p.withColumn("v", latent.velocity(F.col("z0"), F.col("z1")))
    out = latent.euler_trajectory(p, "z1", "v", 10, 2)
    return rounded(out.select("vec_id", "step", F.aggregate("state", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("state").alias("top")))


@query("time_embedding", "with g as (select i, j, i / 10e0 as t from (select unnest(range(11)) as i), (select unnest(range(8)) as j)) select i, cast(j as int) as j, round(case when j < 4 then sin(1000 * t * exp(-ln(10000e0) * j / 3)) else cos(1000 * t * exp(-ln(10000e0) * (j - 4) / 3)) end, 6) as v from g")
def _(spark, d):
    e = spark.range(11).select(F.col("id").alias("i"), F.posexplode(latent.time_embedding(1000 * (F.col("id") / F.lit(10.0)), 8)).alias("j", "v"))
    return rounded(e)


@query("overlap_add", """with a as (select label, row_number() over (partition by label order by vec_id) - 1 as g, embedding from embeddings), f as (select *, max(g) over (partition by label) as top from a),
 b as (select label, g, top, i, cast(embedding[i + 1] as double) as v from (select *, unnest(range(64)) as i from f)),
 c as (select label, g * 48 + i as at_, v, (case when g > 0 and i < 16 then i / 16e0 else 1e0 end) * (case when g < top and i >= 48 then 1 - (i - 48) / 16e0 else 1e0 end) as fade from b)
select label, cast(at_ as bigint) as at_, round(sum(v * fade) / greatest(sum(fade), 1e-12), 8) as value from c group by 1, 2""")
def _(spark, d):
    return faded(segments(spark, d), None)


@query("overlap_add_all")
def _(spark, d):
    return faded(segments(spark, d), None)


def segments(spark, d):
    return windows.row_numbers(table(spark, d, "embeddings"), ["label"], ["vec_id"], "sg")


def faded(s, target):
    return rounded(latent.overlap_add(s, ["label"], "sg", "embedding", 64, 16, target).select("label", F.col("at").cast("bigint").alias("at_"), "value"), 8)


# Four vectors in a row are one subject's segments of one activity; a state goes from a vector back to its reverse.
@query("website_trajectories", f"""with {PAIR}, st as (select unnest([0, 4, 8, 10]) as step), sg as (select vec_id // 4 as subject, vec_id % 4 as seg, step, i, z1 - (z1 - z0) * step / 10e0 as v from pr, st),
 ok as (select vec_id // 4 as subject from embeddings group by 1 having count(*) = 4),
 c as (select subject, step, seg * 48 + i as at_, v, (case when seg > 0 and i < 16 then i / 16e0 else 1e0 end) * (case when seg < 3 and i >= 48 then 1 - (i - 48) / 16e0 else 1e0 end) as fade from sg join ok using (subject))
select cast(subject as bigint) as subject, 0 as activity, step, round(1 - step / 10e0, 5) as flow_time, 0 as channel, cast(at_ as int) as at_, round(sum(v * fade) / greatest(sum(fade), 1e-12), 5) as value from c where at_ < 200 group by 1, 2, 3, 4, 5, 6""")
def _(spark, d):
    p = pairs(spark, d).withColumn("v", latent.velocity(F.col("z0"), F.col("z1")))
    native = latent.euler_trajectory(p, "z1", "v", 10, 4).select(F.floor(F.col("vec_id") / 4).alias("subject"), F.lit(0).alias("activity"), "step", (F.col("vec_id") % 4).alias("seg"), F.lit(0).alias("channel"), F.col("state").alias("values"))
    whole = native.groupBy("subject").agg(F.count("*").alias("n")).where("n = 16").select("subject")
    out = latent.website_trajectories(native.join(whole, "subject"), "subject", "activity", num_steps=10, record_every=4, overlap_samples=16, native_window_samples=64, duration_seconds=4.0)
    return out.select("subject", "activity", "step", "flow_time", "channel", F.posexplode("signal").alias("at_", "value"))


@query("vae_loss_terms", f"with {PAIR} select vec_id, round(1e0 * avg((z1 - z0) * (z1 - z0)) + 0.5e0 * avg(abs(z1 - z0)) + 0.1e0 * 0.5e0 * avg(exp(z0) + z1 * z1 - 1 - z0), 8) as loss from pr group by 1")
def _(spark, d):
    z0, z1 = F.col("z0"), F.col("z1")
    return rounded(pairs(spark, d).select("vec_id", latent.vae_loss(z0, z1, z1, z0, 1.0, 0.5, 0.1).alias("loss")), 8)


@query("flatten_transpose", "select vec_id, cast(i as int) as i, embedding[(i % 4) * 16 + i // 4 + 1] as v from (select *, unnest(range(64)) as i from embeddings)")
def _(spark, d):
    return transposed(table(spark, d, "embeddings"))


@query("flatten_transpose_all")
def _(spark, d):
    return transposed(table(spark, d, "embeddings"))


def transposed(e):
    rows = e.withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(C - 1)), lambda c: F.slice("embedding", c * T + 1, T)))
    turned = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(T - 1)), lambda t: F.transform("w", lambda row: F.get(row, t))))
    return rows.select("vec_id", F.posexplode(turned).alias("i", "v"))


@query("website_seeds", "select user_id, 42 + 1000 * user_id + 100 * cast(label as bigint) as seed, count(*) as n from (select user_id, case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 end as label from events) where label is not null group by 1, 2")
def _(spark, d):
    e = events(spark, d).where("label is not null")
    return e.groupBy("user_id", latent.website_seed(42, F.col("user_id"), F.col("label")).alias("seed")).agg(F.count("*").alias("n"))


# Privacy.


ATT = f"{EMB}, at_ as (select vec_id, fold, avg(x * x) as l2 from s group by 1, 2), pf as (select fold, count(*) as n_attempts, count_if(l2 < 0.10e0 * 0.16e0) as n_success, count_if(l2 < 0.10e0 * 0.16e0) / cast(count(*) as double) as rate from at_ group by 1)"


def attacks(spark, d):
    a = samples(spark, d).groupBy("vec_id", "fold").agg(F.avg(F.col("x") * F.col("x")).alias("l2")).withColumn("baseline", F.lit(0.16))
    return privacy.reconstruction_success(a, "fold", "l2", "baseline")


@query("mia_summary", f"""with {ATT}, r as (select fold, (vec_id // 12) % 2 = 0 as member, round(l2, 9) as score from at_),
 w as (select a.fold, sum(case when a.score > b.score then 1e0 when a.score = b.score then 0.5e0 else 0e0 end) / count(*) as auc from r a join r b on a.fold = b.fold and a.member and not b.member group by 1),
 m as (select case when fold % 2 = 0 then 'holdout' else 'posthoc' end as model, auc from w)
select model, count(*) as n, round(avg(auc), 8) as mean, round(stddev_samp(auc), 8) as sd_sample, round(min(auc), 8) as min, round(max(auc), 8) as max from m group by 1""")
def _(spark, d):
    scores = samples(spark, d).groupBy("vec_id", "fold").agg(F.round(F.avg(F.col("x") * F.col("x")), 9).alias("score")).withColumn("member", F.floor(F.col("vec_id") / 12) % 2 == 0)
    r = privacy.roc_auc(scores, ["fold"], "member", "score").where("auc is not null")
    r = r.select(F.when(F.col("fold") % 2 == 0, "holdout").otherwise("posthoc").alias("model"), "auc")
    return rounded(privacy.membership_summary(r, "model", "auc"), 8)


@query("reconstruction_success", f"with {ATT} select fold, n_attempts, n_success, round(rate, 8) as rate from pf")
def _(spark, d):
    return rounded(attacks(spark, d), 8)


@query("reconstruction_summary", f"with {ATT} select round(avg(rate), 8) as fold_mean_rate, round(sum(n_success) / cast(sum(n_attempts) as double), 8) as pooled_rate, cast(sum(n_attempts) as bigint) as n_attempts from pf")
def _(spark, d):
    return rounded(privacy.reconstruction_summary(attacks(spark, d)), 8)


# Files, streams and models.


@query("manifest_verify")
def _(spark, d):
    """All table files, those of tables that are folders too, against manifests in which one digest and one size are wrong and one file too many is named."""
    from strideframe.sources import artifacts

    found, below = artifacts.describe_folders(spark, f"{d}/*.parquet", "table"), f"/{d.rstrip('/').split('/')[-1]}/"
    for t, wrong in (("nation", {"sha256": "0" * 64}), ("region", {"bytes": 1})):
        folder, entry = next((folder, e) for folder, own in found.items() for e in own if f"{folder}/{e['filename']}".rsplit(below, 1)[-1].startswith(f"{t}.parquet"))
        entry |= wrong
    found[folder].append({"filename": "absent.parquet", "role": "table", "bytes": 1, "sha256": "0" * 64})
    name = F.substring_index(F.concat_ws("/", "folder", "filename"), below, -1).alias("filename")
    return artifacts.verify_folders(spark, found, f"{d}/*.parquet").select(name, "role", "status")


@query("stream_windows")
def _(spark, d):
    import uuid

    from strideframe.session import work_dir

    return streamed(spark, d, "events.parquet", f"{work_dir(spark)}/stream-{uuid.uuid4().hex}")


def streamed(spark, folder, glob, path):
    """Windows of all files there are so far; with the same ``path`` a later call goes on from the state of the last."""
    from strideframe.streaming.windows import run_available, stream_windows

    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    rows = windows.encode_labels(rows, "event_type", EVENT_LABELS).select(F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value", "label")
    return run_available(stream_windows(rows, 2, 1), path)


@query("rf_scenarios")
def _(spark, d):
    """The four scenarios with one fold held out: forests of 100 trees."""
    from strideframe.operators import evaluate

    e = embeddings(spark, d).select("vec_id", "label", "synthetic", "fold", "embedding")
    real = e.where("not synthetic")
    return evaluate.evaluate_scenarios(real.where("fold <> 1"), real.where("fold = 1"), e.where("synthetic and fold <> 1"), "label", "embedding", "vec_id", 10)


@query("scenario_summary", f"""with {EMB}, sc as (select vec_id % 4 as fold, case when synthetic then 'tstr' else 'trtr' end as scenario, label, pred from emb), n as (select fold, scenario, label, pred, count(*) as n from sc group by 1, 2, 3, 4),
 k as (select unnest(range(10)) as k), f as (select fold, scenario, k, coalesce(2e0 * sum(case when label = k and pred = k then n else 0 end) / nullif(sum(case when label = k then n else 0 end) + sum(case when pred = k then n else 0 end), 0), 0) as f1 from n, k group by 1, 2, 3),
 m as (select fold, scenario, avg(f1) as f1 from f group by 1, 2), a as (select fold, scenario, avg(case when label = pred then 1e0 else 0e0 end) as acc from sc group by 1, 2),
 r as (select m.fold, m.scenario, acc, m.f1, case when m.scenario = 'trtr' then 1e0 else m.f1 / (b.f1 + 1e-8) end as ret from m join a using (fold, scenario) join m b on b.fold = m.fold and b.scenario = 'trtr')
select case scenario when 'trtr' then 0 else 2 end as place, scenario, count(*) as n_folds, round(avg(acc), 8) as accuracy_mean, round(stddev_samp(acc), 8) as accuracy_sd, round(avg(f1), 8) as macro_f1_mean, round(stddev_samp(f1), 8) as macro_f1_sd,
 round(avg(ret), 8) as retention_mean, round(stddev_samp(ret), 8) as retention_sd from r group by 1, 2""")
def _(spark, d):
    from strideframe.operators import evaluate

    e = embeddings(spark, d).select((F.col("vec_id") % 4).alias("fold"), F.when(F.col("synthetic"), "tstr").otherwise("trtr").alias("scenario"), "label", "pred")
    scores = metrics.macro_f1_accuracy(metrics.confusion(e, ["fold", "scenario"], "label", "pred", 10), ["fold", "scenario"])
    return rounded(evaluate.summarize_scenarios(metrics.retention(scores, "fold", "scenario", "macro_f1")), 8)
