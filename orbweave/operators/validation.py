"""Judging training sets: the rules of trajectory rows, and how well scores predict the expert's choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.operators.trajectories import KEY, steps
from orbweave.tables import BOUND, RUNS, Scenarios

COMMON = ("state_features", "candidate_features", "candidate_keys", "valid_mask", "expert_action_index")
#: What rows of each schema version need besides; rows without a version are like v1.
TARGETS = {"v1": ("reward", "future_return_h"), "v2": ("objective_delta", "observed_return_h")}
TOLERANCE = 1e-12


def row_faults(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with columns of faults (E19), judged by the widths and version that the first rows of their group set.

    rows: COMMON, the fields of TARGETS, schema struct<version, state_dim, candidate_dim>; a field that is missing or of
    another type is null. missing is the number of missing fields; a row with any is judged by nothing else. Expected widths
    are those of the first row, by order, that declares or has them; the expected version is the first declared one. Rules
    after label_range hold for rows whose label is in range: the first candidate is the skip, in its key and its first
    feature; v2 targets are finite and a skip adds nothing. An empty table gives an empty one.
    """
    version = F.col("schema.version")
    need = lambda v: sum((F.col(c).isNull().cast("int") for c in (*COMMON, *TARGETS[v])), F.lit(0))
    rows = rows.withColumn("missing", F.when(F.coalesce(version == "v2", F.lit(False)), need("v2")).otherwise(need("v1")))
    whole = F.col("missing") == 0
    dim = lambda c: F.when(F.col(c) > 0, F.col(c))
    size = lambda c: F.when(F.size(c) > 0, F.size(c))
    own = {
        "expected_state": F.coalesce(dim("schema.state_dim"), size("state_features")),
        "expected_candidate": F.coalesce(dim("schema.candidate_dim"), size(F.get("candidate_features", F.lit(0)))),
        "expected_version": version,
    }
    at = F.struct(*order)
    expected = rows.where(whole).groupBy(*group).agg(*[F.min_by(c, F.when(c.isNotNull(), at)).alias(n) for n, c in own.items()])
    rows = rows.join(expected, group, "left")
    n = F.size("candidate_features")
    label = F.col("expert_action_index")
    in_range = (label >= 0) & (label < n)
    differs = lambda c, e: ~F.coalesce(F.col(c) == F.col(e), F.lit(False))
    bad_schema = ~F.coalesce(version.isin(*TARGETS), F.lit(False)) | differs("schema.version", "expected_version")
    bad_schema = bad_schema | ~F.coalesce(F.col("schema.state_dim") > 0, F.lit(False)) | ~F.coalesce(F.col("schema.candidate_dim") > 0, F.lit(False))
    bad_schema = bad_schema | differs("schema.state_dim", "expected_state") | differs("schema.candidate_dim", "expected_candidate")
    first_key = F.coalesce(F.get("candidate_keys", F.lit(0))["is_skip"], F.lit(False))
    first_feature = F.coalesce(F.get(F.get("candidate_features", F.lit(0)), F.lit(0)) == 1.0, F.lit(False))
    number = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    target = ~number("objective_delta") | ~number("observed_return_h") | ((label == 0) & (F.abs("objective_delta") > TOLERANCE))
    wrong_width = F.exists("candidate_features", lambda x: ~F.coalesce(F.size(x) == F.col("expected_candidate"), F.lit(False)))
    faults = {
        "bad_schema": F.col("schema").isNotNull() & bad_schema,
        "bad_state_dim": ~F.coalesce(F.size("state_features") == F.col("expected_state"), F.lit(False)),
        "bad_length": (n != F.size("candidate_keys")) | (n != F.size("valid_mask")),
        "bad_candidate_dim": (n == 0) | wrong_width,
        "bad_label": ~in_range,
        "bad_skip": in_range & ~(first_key & first_feature),
        "bad_target": in_range & (version == "v2") & target,
        "at_skip": in_range & (label == 0),
        "at_choice": in_range & (label > 0),
    }
    return rows.withColumns({f: F.coalesce(whole & c, F.lit(False)) for f, c in faults.items()}).withColumn("candidates", F.when(whole, n))


FAULTS = ("bad_schema", "bad_state_dim", "bad_length", "bad_candidate_dim", "bad_label", "bad_skip", "bad_target")


def validation_report(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Per group: rows, missing fields, rows with each fault, labels, sizes of candidate sets (the mean over all rows), and
    the verdict: PASS if nothing is missing and no row has a fault (E19)."""
    judged = row_faults(rows, group, order)
    out = judged.groupBy(*group).agg(
        F.count("*").alias("rows"), F.sum("missing").alias("missing"), *[F.count_if(c).alias(c) for c in (*FAULTS, "at_skip", "at_choice")],
        F.min("candidates").alias("min_size"), F.round(F.coalesce(F.sum("candidates"), F.lit(0)) / F.count("*"), 6).alias("mean_size"), F.max("candidates").alias("max_size"),
    )
    total = sum((F.col(c) for c in FAULTS), F.col("missing"))
    return out.withColumn("verdict", F.when(total == 0, "PASS").otherwise("FAIL"))


def first_errors(rows: DataFrame, group: list[str], order: list[str], limit: int = 20) -> DataFrame:
    """The first rows of each group that have a fault, with their faults by name: what a report quotes."""
    judged = row_faults(rows, group, order)
    named = F.array_compact(F.array(F.when(F.col("missing") > 0, F.lit("missing")), *[F.when(F.col(c), F.lit(c)) for c in FAULTS]))
    bad = judged.select(*group, *order, named.alias("faults")).where(F.size("faults") > 0)
    return bad.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("n") <= limit)


def trajectory_rows(t: Scenarios) -> DataFrame:
    """Training rows of the bound schedules: per step the state, a skip and the task's windows as candidates, the expert's
    place among them. In the schedule `returned` some steps, by their number, are damaged in one of twelve ways."""
    one = F.array_sort(F.collect_list(F.struct("start_s", "window_id", "end_s")))
    w = t.task_window.groupBy("scenario_id", "task_id").agg(one.alias("ws"))
    s = steps(t.kept_assignment, t.task).join(w, ["scenario_id", "task_id"])
    d = F.when(F.col("schedule_id") == "returned", F.col("step") % 64).otherwise(0)
    real = lambda c: F.col(c).cast("double")
    state = F.array(real("priority"), real("duration_s"), real("step"))
    skip_feature = F.array(F.when(d == 5, 0.0).otherwise(1.0), F.lit(0.0), F.lit(0.0))
    features = F.concat(F.array(skip_feature), F.transform("ws", lambda x: F.array(F.lit(0.0), x["start_s"].cast("double"), x["end_s"].cast("double"))))
    keys = F.concat(
        F.array(F.struct((d != 4).alias("is_skip"), F.lit(None).cast("long").alias("window_id"))),
        F.transform("ws", lambda x: F.struct(F.lit(False).alias("is_skip"), x["window_id"].alias("window_id"))),
    )
    place = F.coalesce(F.array_position(F.transform("ws", lambda x: x["window_id"]), F.col("window_id")), F.lit(0)).cast("long")
    delta = F.when(d == 6, F.lit(None)).when(d == 7, F.lit("NaN").cast("double")).when((d == 8) & (place == 0), 1.0).otherwise(real("delta"))
    return s.select(
        *KEY, "step", "task_id",
        F.when(d == 12, F.lit(None)).when(d == 1, F.slice(state, 1, 2)).otherwise(state).alias("state_features"),
        F.when(d == 9, F.transform(features, lambda x: F.slice(x, 1, 2))).otherwise(features).alias("candidate_features"), keys.alias("candidate_keys"),
        F.array_repeat(F.lit(1), F.size("ws") + F.when(d == 2, 0).otherwise(1)).alias("valid_mask"),
        F.when(d == 3, F.size("ws") + 1).otherwise(place).cast("long").alias("expert_action_index"),
        F.lit(None).cast("double").alias("reward"), F.lit(None).cast("double").alias("future_return_h"), delta.alias("objective_delta"), F.lit(0.0).alias("observed_return_h"),
        F.struct(F.when(d == 10, "v1").otherwise("v2").alias("version"), F.when(d == 11, 7).otherwise(3).alias("state_dim"), F.lit(3).alias("candidate_dim")).alias("schema"),
    )


def trajectory_validation(spark, sf_dir: str) -> DataFrame:
    """The report of each bound schedule's training rows."""
    return validation_report(trajectory_rows(Scenarios(spark, sf_dir)), KEY, ["step"])


def prediction_quality_of(scores: DataFrame, group: list[str], state: list[str]) -> DataFrame:
    """Per group: how well scores predict labels.

    scores: group, state, action (0 is the skip), score, label (of the state), n_before (candidates before sampling). The
    predicted action has the highest score, of equal ones the lowest number; the loss is the negative log of the label's share
    in the softmax. A state whose label is not among its actions counts as missed and has no loss. Rates over nothing are
    null. Nulls among scores are the lowest.
    """
    by = Window.partitionBy(*group, *state)
    key = F.struct("score", -F.col("action"))
    rows = scores.withColumns({"own": F.max(F.when(F.col("action") == F.col("label"), key)).over(by), "top": F.max("score").over(by)})
    per = rows.groupBy(*group, *state).agg(
        F.first("label").alias("label"), F.max("n_before").alias("n_before"), F.count("*").alias("n"), F.max_by("action", key).alias("predicted"),
        F.when(F.max("own").isNotNull(), F.count_if(key > F.col("own")) + 1).alias("place"),
        (F.log(F.sum(F.exp(F.col("score") - F.col("top")))) + F.max("top") - F.max("own")["score"]).alias("loss"),
    )
    truth, said = F.col("label") == 0, F.col("predicted") == 0
    rate = lambda hit, of: F.round(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), 6)
    every = F.lit(True)
    return per.groupBy(*group).agg(
        F.count("*").alias("examples"), F.round(F.avg("loss"), 6).alias("loss"), rate(F.col("place") <= 1, every).alias("top1"), rate(F.col("place") <= 5, every).alias("top5"),
        rate(said, truth).alias("skip_recall"), rate(truth, said).alias("skip_precision"), rate(F.col("predicted") == F.col("label"), F.col("label") != 0).alias("choice_accuracy"),
        F.round(F.avg("n_before"), 6).alias("size_before"), F.round(F.avg("n"), 6).alias("size_after"),
    )


def _score(start: Column, length: Column) -> Column:
    """Early and long windows first."""
    return (length - start / 8) / 64


def prediction_quality(spark, sf_dir: str) -> DataFrame:
    """How well a linear score of start and length predicts the bound schedules; the skip has a score of its own."""
    t = Scenarios(spark, sf_dir)
    # windows are dealt once, by tasks; a task's windows, its schedules and what is predicted of it stay where they are
    task = ["part", "scenario_id", "step"]
    w = t.dealt_window.withColumn("action", F.row_number().over(Window.partitionBy(*task).orderBy("start_s", "window_id")))
    w = w.withColumn("n_before", F.count("*").over(Window.partitionBy(*task)) + 1)
    labels = [F.coalesce(F.max(F.when(F.col("picks").bitwiseAND(1 << i) > 0, F.col("action"))).over(Window.partitionBy(*task)), F.lit(0)).alias(f"label{i}") for i in range(len(RUNS))]
    w = w.select(*task, "action", "n_before", _score(F.col("start_s"), F.col("end_s") - F.col("start_s")).alias("score"), *labels)
    skip = F.struct(F.lit(0).alias("action"), F.lit(-4.0).alias("score"))
    own = F.struct("action", "score")
    w = w.select(*task, "n_before", F.inline(F.when(F.col("action") == 1, F.array(skip, own)).otherwise(F.array(own))), F.array(*[f"label{i}" for i in range(len(RUNS))]).alias("labels"))
    c = w.join(F.broadcast(t.runs), "scenario_id").select("*", F.inline("runs")).withColumn("label", F.get("labels", F.col("run")))
    return prediction_quality_of(c.drop("runs", "labels", "run"), ["schedule_id"], task)


_ROWS = """o AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY priority DESC, task_id) - 1 AS step FROM task),
  ac AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, task_id ORDER BY start_s, window_id) AS action FROM task_window),
  tw AS (SELECT scenario_id, task_id, list([0.0::DOUBLE, start_s::DOUBLE, end_s::DOUBLE] ORDER BY action) AS fs, count(*) AS m FROM ac GROUP BY ALL),
  st AS (SELECT r.schedule_id, o.*, a.window_id, fs, m, coalesce(ac.action, 0) AS place, CASE WHEN r.schedule_id = 'returned' THEN step % 64 ELSE 0 END AS d
    FROM (SELECT DISTINCT scenario_id, schedule_id FROM assignment) r JOIN o USING (scenario_id) JOIN tw USING (scenario_id, task_id)
    LEFT JOIN assignment a ON a.scenario_id = r.scenario_id AND a.schedule_id = r.schedule_id AND a.task_id = o.task_id
    LEFT JOIN ac ON ac.scenario_id = a.scenario_id AND ac.task_id = a.task_id AND ac.window_id = a.window_id)"""

QUERIES = {
    "trajectory_validation": (
        trajectory_validation,
        BOUND + "," + _ROWS + """, rw AS (SELECT *, CASE WHEN d = 1 THEN [1.0::DOUBLE, 2.0] WHEN d = 12 THEN NULL ELSE [1.0::DOUBLE, 2.0, 3.0] END AS sf,
          CASE WHEN d = 9 THEN [x[1:2] FOR x IN list_prepend([1.0::DOUBLE, 0, 0], fs)] ELSE list_prepend([CASE WHEN d = 5 THEN 0.0::DOUBLE ELSE 1 END, 0, 0], fs) END AS cf,
          m + 1 AS n_keys, d <> 4 AS skip_key, CASE WHEN d = 2 THEN m ELSE m + 1 END AS n_mask, CASE WHEN d = 3 THEN m + 1 ELSE place END AS label,
          CASE WHEN d = 6 THEN NULL WHEN d = 7 THEN 'nan'::DOUBLE WHEN d = 8 AND place = 0 THEN 1 WHEN window_id IS NULL THEN 0 ELSE priority END AS delta,
          CASE WHEN d = 10 THEN 'v1' ELSE 'v2' END AS v, CASE WHEN d = 11 THEN 7 ELSE 3 END AS sdim FROM st),
        mi AS (SELECT *, CASE WHEN v = 'v1' THEN 2 ELSE (CASE WHEN sf IS NULL THEN 1 ELSE 0 END) + (CASE WHEN delta IS NULL THEN 1 ELSE 0 END) END AS missing FROM rw),
        ex AS (SELECT scenario_id, schedule_id, arg_min(sdim, step) AS es, arg_min(v, step) AS ev FROM mi WHERE missing = 0 GROUP BY ALL),
        j AS (SELECT *, missing = 0 AS ok, label >= 0 AND label < len(cf) AS inside FROM mi JOIN ex USING (scenario_id, schedule_id)),
        rp AS (SELECT scenario_id, schedule_id, count(*) AS "rows", CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (ok AND (v <> ev OR sdim <> es)) AS bad_schema,
          count(*) FILTER (ok AND len(sf) <> es) AS bad_state_dim, count(*) FILTER (ok AND (len(cf) <> n_keys OR len(cf) <> n_mask)) AS bad_length,
          count(*) FILTER (ok AND len([x FOR x IN cf IF len(x) <> 3]) > 0) AS bad_candidate_dim, count(*) FILTER (ok AND NOT inside) AS bad_label,
          count(*) FILTER (ok AND inside AND NOT (skip_key AND cf[1][1] = 1)) AS bad_skip,
          count(*) FILTER (ok AND inside AND v = 'v2' AND (NOT isfinite(delta) OR (label = 0 AND abs(delta) > 1e-12))) AS bad_target,
          count(*) FILTER (ok AND inside AND label = 0) AS at_skip, count(*) FILTER (ok AND inside AND label > 0) AS at_choice,
          min(len(cf)) FILTER (ok) AS min_size, round(sum(CASE WHEN ok THEN len(cf) ELSE 0 END) / count(*)::DOUBLE, 6) AS mean_size, max(len(cf)) FILTER (ok) AS max_size FROM j GROUP BY ALL)
        SELECT *, CASE WHEN missing + bad_schema + bad_state_dim + bad_length + bad_candidate_dim + bad_label + bad_skip + bad_target = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM rp""",
    ),
    "prediction_quality": (
        prediction_quality,
        BOUND + "," + _ROWS + """, sc AS (SELECT schedule_id, scenario_id, step, place AS label, m + 1 AS n, unnest(list_prepend({'a': 0, 's': -4.0::DOUBLE},
            [{'a': i, 's': ((x[3] - x[2]) - x[2] / 8) / 64} FOR x, i IN fs])) AS c FROM st),
        rk AS (SELECT *, row_number() OVER (PARTITION BY schedule_id, scenario_id, step ORDER BY c.s DESC, c.a) AS r FROM sc),
        per AS (SELECT schedule_id, scenario_id, step, label, n, max(CASE WHEN r = 1 THEN c.a END) AS p, max(CASE WHEN c.a = label THEN r END) AS place,
          ln(sum(exp(c.s))) - max(CASE WHEN c.a = label THEN c.s END) AS loss FROM rk GROUP BY ALL)
        SELECT schedule_id, count(*) AS examples, round(avg(loss), 6) AS loss, round(avg((place = 1)::INT::DOUBLE), 6) AS top1, round(avg((place <= 5)::INT::DOUBLE), 6) AS top5,
          round(avg((p = 0)::INT::DOUBLE) FILTER (label = 0), 6) AS skip_recall, round(avg((label = 0)::INT::DOUBLE) FILTER (p = 0), 6) AS skip_precision,
          round(avg((p = label)::INT::DOUBLE) FILTER (label <> 0), 6) AS choice_accuracy, round(avg(n), 6) AS size_before, round(avg(n), 6) AS size_after FROM per GROUP BY ALL""",
    ),
}
