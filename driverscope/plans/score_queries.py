"""Folds, sampling, clips, task metrics and the paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverscope.operators import folds, metrics, stats
from driverscope.operators.chunks import mix
from driverscope.operators.index import with_conditions
from driverscope.plans import reports
from driverscope.plans.catalogue import query, rounded, table
from driverscope.plans.standins import INDEX_SQL, PREDICTIONS_SQL, SIGNAL_SQL, predictions, raw_scenarios, signal


def mix_sql(value: str, seed: int) -> str:
    v = f"(({value}) % 2147483647)"
    return f"((({v} * {v}) % 2147483647) * 48271 + {v} * 16807 + {seed}) % 2147483647"


def draw(column: str, seed: int = 42):
    return mix(F.col(column), seed)


@query(
    "folds_by_group",
    f"""SELECT o_custkey, fold, CASE WHEN fold = 4 THEN 'test' WHEN fold = 0 THEN 'val' ELSE 'train' END AS role
    FROM (SELECT o_custkey, CAST((row_number() OVER (ORDER BY {mix_sql('o_custkey', 42)}, o_custkey) - 1) % 5 AS INT) AS fold
      FROM (SELECT DISTINCT o_custkey FROM orders))""",
)
def folds_by_group(spark, folder):
    found = folds.group_folds(table(spark, folder, "orders"), folds.FoldConfig("o_custkey", 5), draw=draw("o_custkey"), bits=31)
    return found.withColumn("role", folds.fold_role(F.col("fold"), 4, 5))


@query(
    "folds_nested",
    f"""WITH a AS (SELECT o_custkey, (row_number() OVER (ORDER BY {mix_sql('o_custkey', 42)}, o_custkey) - 1) % 3 AS f
      FROM (SELECT DISTINCT o_custkey FROM orders)),
    r AS (SELECT o.*, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS fam FROM orders o JOIN a USING (o_custkey) WHERE f = 0),
    b AS (SELECT fam, (row_number() OVER (ORDER BY {mix_sql('fam', 42)}, fam) - 1) % 4 AS f FROM (SELECT DISTINCT fam FROM r))
    SELECT o_orderkey FROM r JOIN b USING (fam) WHERE f NOT IN (1, 2)""",
)
def folds_nested(spark, folder):
    """Split 5 of 3 x 4: digits 2 and 1. Train of the second level within val of the first."""
    o = table(spark, folder, "orders").withColumn("fam", F.substring("o_orderpriority", 1, 1).cast("long"))
    outer = folds.filter_folds(o, [folds.FoldConfig("o_custkey", 3)], 5, "val", draws=[draw("o_custkey")], bits=31)
    digit = folds.mixed_radix(5, [3, 4])[1]
    inner = folds.filter_folds(outer, [folds.FoldConfig("fam", 4)], digit, "train", draws=[draw("fam")], bits=31)
    return inner.select("o_orderkey")


@query(
    "folds_fixed",
    """WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 6 < 5 THEN CAST(c_custkey % 6 AS INT) END AS fold FROM customer)
    SELECT CASE WHEN fold = 1 THEN 'test' WHEN fold = 2 THEN 'val' ELSE 'train' END AS role, count(*) AS n, count(DISTINCT c_custkey) AS people
    FROM orders JOIN f ON o_custkey = c_custkey WHERE fold IS NOT NULL GROUP BY 1""",
)
def folds_fixed(spark, folder):
    given = table(spark, folder, "customer").where("c_custkey % 6 < 5").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 6).cast("int").alias("fold")
    )
    rows = folds.with_role(folds.fixed_folds(table(spark, folder, "orders"), given, "o_custkey"), test=1)
    per_person = rows.groupBy("role", "o_custkey").agg(F.count("*").alias("n"))
    return per_person.groupBy("role").agg(F.sum("n").alias("n"), F.count("*").alias("people"))


@query(
    "folds_stratified",
    f"""WITH p AS (SELECT o_custkey, max(CAST(o_orderstatus = 'P' AS INT)) AS label FROM orders GROUP BY 1)
    SELECT o_custkey, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {mix_sql('o_custkey', 7)}, o_custkey) - 1) % 5 AS INT) AS fold FROM p""",
)
def folds_stratified(spark, folder):
    o = table(spark, folder, "orders").withColumn("label", (F.col("o_orderstatus") == "P").cast("int"))
    return folds.stratified_folds(o, "o_custkey", "label", 5, draw=draw("o_custkey", 7), bits=31)


@query(
    "sample_fraction",
    f"""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {mix_sql('o_orderkey', 3)}, o_orderkey) AS r, count(*) OVER () AS n
      FROM orders) WHERE r <= round_even(0.37 * n, 0)""",
)
def sample_fraction(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    return folds.take_fraction(o, 0.37, ["o_orderkey"], draw=draw("o_orderkey", 3), bits=31)


@query(
    "sample_thin_class",
    f"""SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'P' ORDER BY {mix_sql('o_orderkey', 5)}, o_orderkey) AS r,
      count(*) OVER (PARTITION BY o_orderstatus = 'P') AS n FROM orders) WHERE o_orderstatus <> 'P' OR r <= round_even(0.25 * n, 0)""",
)
def sample_thin_class(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return folds.thin_class(o, F.col("o_orderstatus") == "P", 0.25, ["o_orderkey"], draw=draw("o_orderkey", 5), bits=31)


@query(
    "sample_balanced",
    f"""WITH l AS (SELECT o_orderkey, CAST(o_orderstatus = 'P' AS INT) AS label FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {mix_sql('o_orderkey', 11)}, o_orderkey) AS r FROM l)
    SELECT o_orderkey, label FROM r WHERE label = 1 OR r <= (SELECT count(*) FROM l WHERE label = 1)""",
)
def sample_balanced(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").cast("int").alias("label"))
    return folds.undersample(o, "label", ["o_orderkey"], draw=draw("o_orderkey", 11), bits=31)


@query(
    "sample_oversample",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {mix_sql('o_orderkey', 1)}, o_orderkey) - 1 AS k FROM orders),
    n AS (SELECT count(*) AS n FROM orders),
    d AS (SELECT unnest(range(CAST(ceil(n * 1.3) AS BIGINT))) AS draw, n FROM n)
    SELECT draw, o_orderkey FROM (SELECT draw, ({mix_sql('draw', 9)}) % n AS k FROM d) JOIN r USING (k)""",
)
def sample_oversample(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    return folds.oversample(o, 1.3, ["o_orderkey"], draw=draw("o_orderkey", 1), bits=31, pick=mix(F.col("draw"), 9))


CLIPS = folds.ClipSpec(length=20, buffer=5, stride=10, validation=4)
SEQUENCES_SQL = """
seq AS (SELECT user_id, count(*) AS n_frames, greatest(1, (count(*) - 10) // 20) AS n_train_chunks FROM events
        WHERE user_id NOT IN (3, 14) GROUP BY 1 HAVING count(*) - 10 >= 20)
"""


def sequences(spark, folder):
    return folds.scan_sequences(table(spark, folder, "events"), ["user_id"], CLIPS, exclude=[3, 14], participant="user_id")


@query(
    "clip_sequences",
    f"WITH {SEQUENCES_SQL} SELECT user_id, n_frames, CAST(n_train_chunks AS BIGINT) AS n_train_chunks FROM seq",
)
def clip_sequences(spark, folder):
    return sequences(spark, folder)


@query(
    "clip_starts",
    f"""WITH {SEQUENCES_SQL}, t AS (SELECT user_id, n_frames, unnest(range(n_train_chunks)) AS clip FROM seq),
    v AS (SELECT user_id, n_frames, unnest(range(4)) AS clip FROM seq)
    SELECT 'train' AS part, user_id, CAST(clip AS BIGINT) AS clip, ({mix_sql('user_id * 1009 + clip', 42)}) % (greatest(0, n_frames - 30) + 1) + 5 AS start FROM t
    UNION ALL SELECT 'val', user_id, CAST(clip AS BIGINT), n_frames - 25 - clip * 10 FROM v WHERE n_frames - 25 - clip * 10 >= 5""",
)
def clip_starts(spark, folder):
    found = sequences(spark, folder)
    train = folds.train_clips(found, ["user_id"], CLIPS, draw=mix(F.col("user_id") * 1009 + F.col("clip"), 42))
    val = folds.validation_clips(found, CLIPS)

    def part(df, name):
        return df.select(F.lit(name).alias("part"), "user_id", F.col("clip").cast("long").alias("clip"), F.col("start").cast("long").alias("start"))

    return part(train, "train").unionByName(part(val, "val"))


@query(
    "clip_centre_frames",
    f"""WITH {SIGNAL_SQL}, p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t_ns, event_id) - 1 AS position,
      count(*) OVER (PARTITION BY user_id) AS n FROM signal)
    SELECT user_id, event_id, position, greatest(0, (n - 20) // 2) + 10 AS middle FROM p
    WHERE n >= 20 AND position >= (n - 20) // 2 AND position <= (n - 20) // 2 + 19 AND (position - (n - 20) // 2) % 3 = 0""",
)
def clip_centre_frames(spark, folder):
    """Every third frame of each recording's 20-frame centre clip, and the clip's middle frame."""
    from driverscope.operators.ordered import row_index, time_bin

    rows = row_index(signal(spark, folder), ["user_id"], time_bin("t_ns", 60_000_000_000), ["t_ns", "event_id"], "position")
    counted = signal(spark, folder).groupBy("user_id").agg(F.count("*").alias("n_frames")).where("n_frames >= 20")
    clips = counted.select("user_id", folds.centre_clip(F.col("n_frames"), 20)[0].alias("start"))
    clips = clips.withColumn("middle", folds.middle_frame(F.col("start"), 20))
    return folds.clip_frames(rows, clips, ["user_id"], 20, stride=3).select("user_id", "event_id", "position", "middle")


@query(
    "clip_align_modalities",
    """SELECT a.user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) >= 14) a
    JOIN (SELECT user_id FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 15) b ON a.user_id = b.user_id""",
)
def clip_align_modalities(spark, folder):
    e = table(spark, folder, "events")
    return folds.align_modalities(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], 14)


@query(
    "recording_tail",
    f"""WITH {SIGNAL_SQL} SELECT event_id FROM signal s JOIN recordings r ON s.user_id = r.user_id WHERE t_ns >= end_time - 45000000000""",
)
def recording_tail(spark, folder):
    return folds.last_frames(signal(spark, folder), ["user_id"], "t_ns", 45_000_000_000, 60_000_000_000).select("event_id")


RATES = ("sensitivity", "specificity", "uar", "accuracy", "f1")
CONFUSION_SQL = f"""
WITH {PREDICTIONS_SQL},
c AS (SELECT task, fold, count(*) FILTER (prob >= 0.5 AND gt = 1) AS tp, count(*) FILTER (prob < 0.5 AND gt = 0) AS tn,
        count(*) FILTER (prob >= 0.5 AND gt = 0) AS fp, count(*) FILTER (prob < 0.5 AND gt = 1) AS fn FROM predictions WHERE gt <> -1 GROUP BY 1, 2),
m AS (SELECT *, tp::DOUBLE / nullif(tp + fn, 0) AS sensitivity, tn::DOUBLE / nullif(tn + fp, 0) AS specificity,
        (tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2 AS uar, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
        2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c)
"""


def task_scores(spark, folder):
    return metrics.confusion(predictions(spark, folder), ["task", "fold"])


@query("task_confusion", CONFUSION_SQL + "SELECT task, fold, tp, tn, fp, fn, " + ", ".join(f"round({r}, 6) AS {r}" for r in RATES) + " FROM m")
def task_confusion(spark, folder):
    return task_scores(spark, folder).select("task", "fold", "tp", "tn", "fp", "fn", *[rounded(r).alias(r) for r in RATES])


@query(
    "task_auc",
    f"""WITH {PREDICTIONS_SQL},
    d AS (SELECT task, fold, prob, count(*) FILTER (gt = 1) AS pos, count(*) FILTER (gt = 0) AS neg FROM predictions WHERE gt <> -1 GROUP BY 1, 2, 3),
    b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task, fold ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
    SELECT task, fold, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc,
      CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM b GROUP BY 1, 2""",
)
def task_auc(spark, folder):
    return metrics.roc_auc(predictions(spark, folder), ["task", "fold"]).withColumn("auc", rounded("auc"))


@query(
    "task_auc_missing_scores",
    f"""WITH {PREDICTIONS_SQL},
    d AS (SELECT task, fold, prob, count(*) FILTER (gt = 1) AS pos, count(*) FILTER (gt = 0) AS neg FROM predictions WHERE gt <> -1 AND sample % 7 <> 0 GROUP BY 1, 2, 3),
    b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task, fold ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
    SELECT task, fold, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc,
      CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM b GROUP BY 1, 2""",
)
def task_auc_missing_scores(spark, folder):
    """Rows without a score have no rank and no part."""
    rows = predictions(spark, folder).withColumn("prob", F.when(F.col("sample") % 7 != 0, F.col("prob")))
    return metrics.roc_auc(rows, ["task", "fold"]).withColumn("auc", rounded("auc"))


THRESHOLD_SQL = f"""
WITH {PREDICTIONS_SQL},
d AS (SELECT task, fold, prob, count(*) FILTER (gt = 1) AS pos, count(*) FILTER (gt = 0) AS neg FROM predictions WHERE gt <> -1 GROUP BY 1, 2, 3),
b AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM d
      WINDOW w AS (PARTITION BY task, fold ORDER BY prob DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY task, fold)),
u AS (SELECT *, CASE WHEN p > 0 AND n > 0 THEN tp * n - fp * p END AS gain, (tp::DOUBLE / nullif(p, 0) + 1 - fp::DOUBLE / nullif(n, 0)) / 2 AS uar FROM b),
t AS (SELECT task, fold, CASE WHEN gain > 0 THEN prob ELSE 'inf'::DOUBLE END AS threshold, greatest(uar, 0.5::DOUBLE) AS uar
      FROM (SELECT *, row_number() OVER (PARTITION BY task, fold ORDER BY gain DESC, prob DESC) AS r FROM u) WHERE r = 1)
"""


@query("task_threshold", THRESHOLD_SQL + "SELECT task, fold, threshold, round(uar, 6) AS uar FROM t")
def task_threshold(spark, folder):
    return metrics.best_threshold(predictions(spark, folder), ["task", "fold"]).withColumn("uar", rounded("uar"))


@query(
    "task_test_at_threshold",
    THRESHOLD_SQL
    + """, x AS (SELECT p.*, coalesce(threshold, 0.5) AS thr FROM predictions p LEFT JOIN t ON p.task = t.task AND p.fold = (t.fold + 4) % 5 WHERE gt <> -1)
    SELECT task, fold, count(*) FILTER (prob >= thr AND gt = 1) AS tp, count(*) FILTER (prob < thr AND gt = 0) AS tn,
      count(*) FILTER (prob >= thr AND gt = 0) AS fp, count(*) FILTER (prob < thr AND gt = 1) AS fn FROM x GROUP BY 1, 2""",
)
def task_test_at_threshold(spark, folder):
    """Each test fold is scored at the threshold chosen on the next fold, its validation fold."""
    rows = predictions(spark, folder)
    chosen = metrics.best_threshold(rows, ["task", "fold"]).withColumn("fold", (F.col("fold") + 4) % 5)
    return metrics.confusion_at(rows, chosen, ["task", "fold"]).select("task", "fold", "tp", "tn", "fp", "fn")


WEIGHTS = {"cd": 1.0, "intox": 2.0, "impaired": 0.5, "impaired_intox": 0.5}


@query(
    "task_joint",
    CONFUSION_SQL
    + """, w AS (SELECT *, CASE task WHEN 'cd' THEN 0.25 WHEN 'intox' THEN 0.5 ELSE 0.125 END::DOUBLE AS w FROM m)
    SELECT fold, round(sum(w * uar) / sum(w) FILTER (uar IS NOT NULL), 6) AS joint_uar, round(sum(w * f1) / sum(w) FILTER (f1 IS NOT NULL), 6) AS joint_f1
    FROM w GROUP BY 1""",
)
def task_joint(spark, folder):
    out = metrics.joint_metric(task_scores(spark, folder), WEIGHTS, ["uar", "f1"], ["fold"])
    return out.select("fold", rounded("joint_uar").alias("joint_uar"), rounded("joint_f1").alias("joint_f1"))


def wide_predictions(spark, folder):
    """One row per sample with the four scores side by side and the actual state."""
    rows = predictions(spark, folder)
    names = ["cd", "intox", "impaired", "impaired_intox"]
    scores = [F.max(F.when(F.col("task") == n, F.col("prob"))).alias(n) for n in names]
    actual = F.max(F.when(F.col("task") == "impaired_intox", F.col("gt"))) + 1
    return rows.groupBy("fold", "sample").agg(*scores, actual.alias("gt3"))


def _states_sql(guess: str) -> str:
    return f"""WITH {PREDICTIONS_SQL},
    w AS (SELECT fold, sample, max(prob) FILTER (task = 'cd') AS cd, max(prob) FILTER (task = 'intox') AS intox, max(prob) FILTER (task = 'impaired') AS impaired,
            max(prob) FILTER (task = 'impaired_intox') AS ii, max(gt) FILTER (task = 'impaired_intox') + 1 AS actual FROM predictions GROUP BY 1, 2),
    g AS (SELECT fold, actual, {guess} AS predicted FROM w),
    c AS (SELECT fold, actual, predicted, count(*) AS n FROM g GROUP BY 1, 2, 3),
    k AS (SELECT fold, a AS actual, p AS predicted FROM (SELECT DISTINCT fold FROM g), (VALUES (0), (1), (2)) x(a), (VALUES (0), (1), (2)) y(p))
    SELECT k.fold, k.actual, k.predicted, round(coalesce(n::DOUBLE / sum(n) OVER (PARTITION BY k.fold, k.actual), 0), 6) AS share
    FROM k LEFT JOIN c ON k.fold = c.fold AND k.actual = c.actual AND k.predicted = c.predicted"""


def _states(rule: str):
    def run(spark, folder):
        return metrics.three_class_confusion(wide_predictions(spark, folder), ["fold"], rule).withColumn("share", rounded("share"))

    return run


query("state_confusion_impaired_first", _states_sql("CASE WHEN impaired < 0.5 THEN 0 WHEN ii >= 0.5 THEN 2 ELSE 1 END"))(_states("impaired_first"))
query("state_confusion_intox_first", _states_sql("CASE WHEN intox >= 0.5 THEN 2 WHEN cd >= 0.5 THEN 1 ELSE 0 END"))(_states("intox_first"))


@query(
    "task_cross_entropy",
    f"""WITH {PREDICTIONS_SQL}, z AS (SELECT *, prob * 8 - 4 AS z, CASE task WHEN 'cd' THEN 0.5 WHEN 'intox' THEN 2 ELSE 1.5 END::DOUBLE AS pw,
      CASE task WHEN 'cd' THEN 1 WHEN 'intox' THEN 2 ELSE 0.5 END::DOUBLE AS w FROM predictions WHERE gt >= 0)
    SELECT fold, round(sum(w * (pw * gt * ln(1 + exp(-z)) + (1 - gt) * ln(1 + exp(z)))) / sum(w), 6) AS loss FROM z GROUP BY 1""",
)
def task_cross_entropy(spark, folder):
    rows = predictions(spark, folder).withColumn("logit", F.col("prob") * 8 - 4)
    pos = {"cd": 0.5, "intox": 2.0, "impaired": 1.5, "impaired_intox": 1.5}
    return metrics.cross_entropy(rows, WEIGHTS, pos, ["fold"]).withColumn("loss", rounded("loss"))


@query(
    "fold_summary",
    CONFUSION_SQL + "SELECT task, round(avg(uar), 6) AS uar_mean, round(stddev_pop(uar), 6) AS uar_std, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM m GROUP BY 1",
)
def fold_summary(spark, folder):
    out = reports.fold_summary(task_scores(spark, folder), ["uar", "f1"], ["task"])
    return out.select("task", *[rounded(c).alias(c) for c in out.columns if c != "task"])


@query(
    "repeat_summary",
    f"""WITH {PREDICTIONS_SQL}, c AS (SELECT task, sample % 3 AS repeat, fold, avg(CAST(prob >= 0.5 AND gt = 1 OR prob < 0.5 AND gt = 0 AS INT)) AS accuracy
      FROM predictions WHERE gt <> -1 GROUP BY 1, 2, 3), r AS (SELECT task, repeat, avg(accuracy) AS m, stddev_pop(accuracy) AS s FROM c GROUP BY 1, 2)
    SELECT task, round(avg(m), 6) AS accuracy_mean, round(avg(s), 6) AS accuracy_std FROM r GROUP BY 1""",
)
def repeat_summary(spark, folder):
    rows = predictions(spark, folder).withColumn("repeat", F.col("sample") % 3)
    scores = metrics.confusion(rows, ["task", "repeat", "fold"])
    out = reports.repeat_summary(scores, ["accuracy"], ["task"])
    return out.select("task", rounded("accuracy_mean").alias("accuracy_mean"), rounded("accuracy_std").alias("accuracy_std"))


@query(
    "best_epoch",
    f"""WITH {PREDICTIONS_SQL}, c AS (SELECT task, sample % 20 AS epoch, fold, count(*) FILTER (prob >= 0.5 AND gt = 1)::DOUBLE / nullif(count(*) FILTER (gt = 1), 0) AS se,
        count(*) FILTER (prob < 0.5 AND gt = 0)::DOUBLE / nullif(count(*) FILTER (gt = 0), 0) AS sp FROM predictions WHERE gt <> -1 GROUP BY 1, 2, 3),
      u AS (SELECT *, (se + sp) / 2 AS uar FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY task, fold ORDER BY uar DESC NULLS LAST, epoch) AS r FROM u)
    SELECT task, fold, epoch, round(uar, 6) AS uar, round(se, 6) AS sensitivity FROM r WHERE r = 1""",
)
def best_epoch(spark, folder):
    rows = predictions(spark, folder).withColumn("epoch", F.col("sample") % 20)
    scores = metrics.confusion(rows, ["task", "fold", "epoch"])
    best = metrics.best_epoch(scores, ["task", "fold"], "uar", ["sensitivity"])
    return best.select("task", "fold", "epoch", rounded("uar").alias("uar"), rounded("sensitivity").alias("sensitivity"))


def ranked_clips(spark, folder):
    o = table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.select(
        (F.col("o_custkey") % 5).alias("fold"),
        (cents % 400 / F.lit(100.0) - 2).alias("score"),
        (F.col("o_orderstatus") == "P").cast("int").alias("label"),
        (cents % 77 / F.lit(100.0)).alias("spread"),
    )


@query(
    "ranking_loss",
    """WITH s AS (SELECT o_custkey % 5 AS fold, CAST(round(o_totalprice * 100) AS BIGINT) % 400 / 100.0::DOUBLE - 2 AS score, o_orderstatus = 'P' AS pos,
        CAST(round(o_totalprice * 100) AS BIGINT) % 77 / 100.0::DOUBLE AS spread FROM orders),
    d AS (SELECT fold, pos, score, count(*) AS n FROM s GROUP BY 1, 2, 3),
    r AS (SELECT a.fold, sum(a.n * b.n * greatest(0, 1 - (a.score - b.score))) / sum(a.n * b.n) AS rank_loss
          FROM d a JOIN d b ON a.fold = b.fold AND a.pos AND NOT b.pos GROUP BY 1),
    t AS (SELECT fold, avg(spread) FILTER (NOT pos) - avg(spread) FILTER (pos) AS std_loss FROM s GROUP BY 1)
    SELECT fold, round(rank_loss, 6) AS rank_loss, round(std_loss, 6) AS std_loss, round(rank_loss + 0.1 * std_loss, 6) AS loss FROM r JOIN t USING (fold)""",
)
def ranking_loss(spark, folder):
    out = metrics.ranking_loss_with_spread(ranked_clips(spark, folder), ["fold"])
    return out.select("fold", *[rounded(c).alias(c) for c in ("rank_loss", "std_loss", "loss")])


FEATURES = ["minutes", "tenths", "steps"]
PAIRS_SQL = f"""
WITH {INDEX_SQL},
rows0 AS (SELECT participant_name, k AS condition, CASE k WHEN 'cd' THEN cd ELSE i END AS side, duration_ds / 600.0::DOUBLE AS minutes,
    CAST(duration_ds % 97 AS DOUBLE) AS tenths, CAST(duration_ds % 3 AS DOUBLE) AS steps
  FROM (SELECT *, cognitive_task <> 'no_task' AS cd, intoxicated AS i FROM scenarios), (VALUES ('intoxicated'), ('cd'), ('joint')) x(k)
  WHERE CASE k WHEN 'intoxicated' THEN experiment_version = 1 AND NOT cd WHEN 'cd' THEN NOT i ELSE experiment_version = 1 AND i = cd END),
pairs AS (
  SELECT condition, feature, participant_name, avg(v) FILTER (NOT side) AS baseline, avg(v) FILTER (side) AS impaired
  FROM rows0 CROSS JOIN LATERAL (VALUES ('minutes', minutes), ('tenths', tenths), ('steps', steps)) f(feature, v)
  GROUP BY 1, 2, 3 HAVING count(*) FILTER (side) > 0 AND count(*) FILTER (NOT side) > 0),
diffs AS (SELECT condition, feature, round(impaired - baseline, 9) AS d FROM pairs),
ranks AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY condition, feature, abs(d)) - 1) / 2.0::DOUBLE AS r,
            count(*) OVER (PARTITION BY condition, feature, abs(d)) AS t
          FROM diffs WHERE d <> 0 WINDOW w AS (PARTITION BY condition, feature ORDER BY abs(d))),
sums AS (SELECT condition, feature, coalesce(sum(r) FILTER (d > 0), 0) AS plus, count(*)::DOUBLE AS m, sum(t::DOUBLE * t - 1) AS ties FROM ranks GROUP BY 1, 2),
tests AS (SELECT e.condition, e.feature, n, mean_diff, (plus - m * (m + 1) / 4) / nullif(sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 0) AS z
  FROM (SELECT condition, feature, count(*) AS n, avg(d) AS mean_diff FROM diffs GROUP BY 1, 2) e LEFT JOIN sums USING (condition, feature))
"""


def tested(spark, folder):
    index = with_conditions(raw_scenarios(spark, folder)).select(
        "participant_name",
        "experiment_version",
        "intoxicated",
        (F.col("cognitive_task") != "no_task").alias("cd"),
        (F.col("duration_ds") / 600.0).alias("minutes"),
        (F.col("duration_ds") % 97).cast("double").alias("tenths"),
        (F.col("duration_ds") % 3).cast("double").alias("steps"),
    )
    means = stats.paired_means(stats.condition_rows(index), FEATURES, drop_unpaired=True)
    return stats.signed_rank(means, ["condition", "feature"])


@query(
    "paired_signed_rank",
    PAIRS_SQL + "SELECT condition, feature, n, round(mean_diff, 6) AS mean_diff, round(z, 5) AS z, round(abs(z) / sqrt(n), 6) AS effect FROM tests",
)
def paired_signed_rank(spark, folder):
    return tested(spark, folder).select(
        "condition", "feature", "n", rounded("mean_diff").alias("mean_diff"), rounded("z", 5).alias("z"), rounded("effect").alias("effect")
    )


RESULT_CELLS = ", ".join(
    f"round(max(mean_diff) FILTER (condition = '{c}'), 6) AS {c}_mean_diff, round(max(abs(z) / sqrt(n)) FILTER (condition = '{c}'), 6) AS {c}_effect, "
    f"bool_or(abs(z) > 1.959963984540054) FILTER (condition = '{c}') AS {c}_significant"
    for c in ("intoxicated", "cd", "joint")
)


@query("paired_result_table", PAIRS_SQL + f"SELECT feature, {RESULT_CELLS} FROM tests GROUP BY 1")
def paired_result_table(spark, folder):
    wide = stats.result_table(tested(spark, folder))
    names = [c for c in wide.columns if c != "feature" and not c.endswith("significant")]
    return wide.withColumns({c: rounded(c) for c in names})


@query(
    "paired_p_values",
    PAIRS_SQL
    + """, h AS (SELECT *, abs(z) / 2000 AS h FROM tests)
    SELECT condition, feature, round(1 - 2 * h / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * i * h * i * h))), 8) AS p_value FROM h""",
)
def paired_p_values(spark, folder):
    """The SQL integrates the density, the query takes series."""
    return tested(spark, folder).select("condition", "feature", rounded(stats.two_sided_normal("z"), 8).alias("p_value"))
