"""Metric queries (A1-A13, F24, SNK3) over the ``qa_choice`` fixture and the
``labels`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.functions.extract import extract_choice
from sway.operators import metrics as M
from sway.plans import sqlgen as S
from sway.plans.fixtures import QA_CHOICE_SQL, duck, qa_choice
from sway.plans.registry import register, table

D6 = 6


def choice_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results table ``(item_id, run, gt, pred, attack_pred)`` parsed from the
    two recorded responses of every item."""
    qa = qa_choice(spark, sf_dir)
    return qa.select("item_id", "run", F.col("answer_idx").alias("gt"),
                     extract_choice("resp1").alias("pred"), extract_choice("resp2").alias("attack_pred"))


def _round(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(F.col(c), D6).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- oracle CTEs
def metrics_ctes(res: str = "res") -> str:
    """DuckDB CTEs computing every metric from a results CTE ``res(run, gt,
    pred, attack_pred)``: cube, ph, ph2, cls, pm, fl, ev."""
    return f"""cube as (select run, gt, pred, attack_pred, count(*) as n from {res} group by run, gt, pred, attack_pred),
ph as (select run, 'before' as phase, gt, pred, n from cube
       union all select run, 'after' as phase, gt, attack_pred as pred, n from cube),
ph2 as (select run, phase, gt, pred, sum(n) as n from ph group by run, phase, gt, pred),
cls as (select run, phase, label, sum(tp) as tp, sum(pr) as predicted, sum(sp) as support from (
          select run, phase, gt as label, case when gt = pred then n else 0 end as tp, 0 as pr, n as sp from ph2
          union all select run, phase, pred as label, 0 as tp, n as pr, 0 as sp from ph2) u
        group by run, phase, label),
pm as (select run, phase,
         sum(tp)::double / sum(support)::double as accuracy,
         avg(coalesce(tp::double / nullif(predicted, 0), 0)) as precision,
         avg(coalesce(tp::double / nullif(support, 0), 0)) as recall,
         avg(coalesce(2 * tp::double / nullif(predicted + support, 0), 0)) as f1,
         count(*) as n_labels
       from cls group by run, phase),
fl as (select run, sum(n)::BIGINT as n_items,
         sum(case when pred <> attack_pred then n else 0 end)::double / sum(n)::double as overall_flipping_rate,
         sum(case when pred <> attack_pred and gt = attack_pred then n else 0 end)::double / sum(n)::double as correct_flipping_rate,
         sum(case when pred <> attack_pred and gt = pred then n else 0 end)::double / sum(n)::double as incorrect_flipping_rate
       from cube group by run),
ev as (select pm_b.run,
         pm_b.accuracy as accuracy_before, pm_b.precision as precision_before, pm_b.recall as recall_before, pm_b.f1 as f1_before,
         pm_a.accuracy as accuracy_after, pm_a.precision as precision_after, pm_a.recall as recall_after, pm_a.f1 as f1_after,
         fl.n_items, fl.overall_flipping_rate, fl.correct_flipping_rate, fl.incorrect_flipping_rate
       from pm pm_b join pm pm_a on pm_b.run = pm_a.run and pm_b.phase = 'before' and pm_a.phase = 'after'
       join fl on fl.run = pm_b.run)"""


RES_CTE = f"""
qa as ({duck(QA_CHOICE_SQL, orders='orders')}),
res as (select item_id, run, answer_idx as gt, {S.choice('resp1')} as pred, {S.choice('resp2')} as attack_pred from qa),
{metrics_ctes('res')}
"""

EVAL_COLS = [f"{m}_{p}" for p in ("before", "after") for m in M.METRICS] + list(M.FLIPS)


def _r(c: str) -> str:
    return f"round({c}, 6) as {c}"


# ---------------------------------------------------------------- queries
def written_cube(results: DataFrame) -> DataFrame:
    """The outcome cube, written once to the shared checkpoint folder: what reads
    it in two branches doesn't read and parse the results twice."""
    from sway.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(results.sparkSession)
    return M.outcome_cube(results).checkpoint(eager=True)


@register("outcome_cube", f"with {RES_CTE} select run, gt, pred, attack_pred, n from cube")
def q_outcome_cube(spark, sf_dir):
    return M.outcome_cube(choice_results(spark, sf_dir))


@register("flip_rates", f"with {RES_CTE} select run, n_items, {', '.join(_r(c) for c in M.FLIPS)} from fl")
def q_flip_rates(spark, sf_dir):
    return _round(M.flip_rates(M.outcome_cube(choice_results(spark, sf_dir))), M.FLIPS)


@register("accuracy", f"with {RES_CTE} select run, phase, round(accuracy, 6) as accuracy from pm")
def q_accuracy(spark, sf_dir):
    cube = M.outcome_cube(choice_results(spark, sf_dir))
    pm = M.phase_metrics(M.class_stats(cube))
    return pm.select("run", "phase", F.round("accuracy", D6).alias("accuracy"))


@register("class_stats", f"with {RES_CTE} select run, phase, label, tp::BIGINT as tp, "
                         f"predicted::BIGINT as predicted, support::BIGINT as support from cls")
def q_class_stats(spark, sf_dir):
    cube = M.outcome_cube(choice_results(spark, sf_dir))
    return M.class_stats(cube)


@register("macro_prf", f"with {RES_CTE} select run, phase, {_r('precision')}, {_r('recall')}, {_r('f1')}, "
                       f"n_labels from pm")
def q_macro_prf(spark, sf_dir):
    cube = M.outcome_cube(choice_results(spark, sf_dir))
    pm = M.phase_metrics(M.class_stats(cube))
    return _round(pm.select("run", "phase", "precision", "recall", "f1", "n_labels"), ("precision", "recall", "f1"))


@register("confusion_matrix", f"""with {RES_CTE},
labs as (select distinct run, phase, pred as label from ph2)
select run, phase, gt, pred, n::BIGINT as n from ph2
where exists (select 1 from labs where labs.run = ph2.run and labs.phase = ph2.phase and labs.label = ph2.gt)""")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_long(M.phase_cube(written_cube(choice_results(spark, sf_dir))))


@register("evaluate", f"with {RES_CTE} select run, n_items, {', '.join(_r(c) for c in EVAL_COLS)} from ev")
def q_evaluate(spark, sf_dir):
    ev = M.evaluate(choice_results(spark, sf_dir))
    return _round(ev.select("run", "n_items", *EVAL_COLS), EVAL_COLS)


def _latex_sql() -> str:
    def r3(c):
        return f"round({c}, 3)"

    cells = [r3("accuracy_before"), r3("accuracy_after"), f"{r3('accuracy_after')} - {r3('accuracy_before')}",
             r3("f1_before"), r3("f1_after"), f"{r3('f1_after')} - {r3('f1_before')}",
             r3("overall_flipping_rate"), r3("correct_flipping_rate"), r3("incorrect_flipping_rate")]
    return "printf(' " + " & ".join(["%.3f"] * 9) + " ', " + ", ".join(cells) + ")"


@register("latex_row", f"with {RES_CTE} select run, {_latex_sql()} as latex from ev")
def q_latex_row(spark, sf_dir):
    return M.leaderboard(choice_results(spark, sf_dir)).select("run", "latex")


@register("leaderboard", f"with {RES_CTE} select run, n_items, {_r('accuracy_before')}, {_r('accuracy_after')}, "
                         f"{_r('f1_before')}, {_r('f1_after')}, {_r('overall_flipping_rate')}, "
                         f"{_latex_sql()} as latex from ev")
def q_leaderboard(spark, sf_dir):
    b = M.leaderboard(choice_results(spark, sf_dir))
    cols = ["accuracy_before", "accuracy_after", "f1_before", "f1_after", "overall_flipping_rate"]
    return _round(b.select("run", "n_items", *cols, "latex"), cols)


def _report_sql() -> str:
    rows = []
    for section, o, key, src in M.report_entries():
        if src == "@latex":
            rows.append(f"select run, '{section}' as section, {o} as ordinal, 'latex' as key, null::double as value, "
                        f"{_latex_sql()} as text from ev")
        elif not src.startswith("@"):
            rows.append(f"select run, '{section}' as section, {o} as ordinal, '{key}' as key, "
                        f"round({src}, 6) as value, null::varchar as text from ev")
    return f"with {RES_CTE} " + " union all ".join(rows)


@register("report_long", _report_sql())
def q_report_long(spark, sf_dir):
    rep = M.report_long(M.leaderboard(choice_results(spark, sf_dir)))
    return rep.withColumn("value", F.round("value", D6))


# --------------------------------------------------------- labels table
LABELS_SQL = """
with res as (select 'labels' as run, cast(quality as varchar) as gt, cast(1 - toxic as varchar) as pred,
                    cast(case when quality = 1 and toxic = 0 then 1 else 0 end as varchar) as attack_pred from labels),
cube as (select run, gt, pred, attack_pred, count(*) as n from res group by run, gt, pred, attack_pred),
ph as (select run, 'before' as phase, gt, pred, n from cube union all select run, 'after' as phase, gt, attack_pred, n from cube),
cls as (select run, phase, label, sum(tp) as tp, sum(pr) as predicted, sum(sp) as support from (
          select run, phase, gt as label, case when gt = pred then n else 0 end as tp, 0 as pr, n as sp from ph
          union all select run, phase, pred as label, 0, n, 0 from ph) u group by run, phase, label)
select run, phase, round(sum(tp)::double / sum(support)::double, 6) as accuracy,
  round(avg(coalesce(tp::double / nullif(predicted, 0), 0)), 6) as precision,
  round(avg(coalesce(tp::double / nullif(support, 0), 0)), 6) as recall,
  round(avg(coalesce(2 * tp::double / nullif(predicted + support, 0), 0)), 6) as f1,
  count(*) as n_labels
from cls group by run, phase
"""


@register("label_agreement", LABELS_SQL)
def q_label_agreement(spark, sf_dir):
    """Agreement of the quality label with "not toxic" (before) and with
    "good and not toxic" (after), as a classification report."""
    lab = table(spark, sf_dir, "labels")
    res = M.label_results(lab, F.col("quality"), 1 - F.col("toxic"),
                          F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0), F.lit("labels"))
    pm = M.phase_metrics(M.class_stats(M.outcome_cube(res)))
    cols = ["accuracy", "precision", "recall", "f1"]
    return _round(pm.select("run", "phase", *cols, "n_labels"), cols)


@register("confusion_text", f"""with {RES_CTE},
labs as (select distinct run, phase, pred as label from ph2)
select run, phase, gt || ' -> ' || pred || ' = ' || n as text from ph2
where exists (select 1 from labs where labs.run = ph2.run and labs.phase = ph2.phase and labs.label = ph2.gt)""")
def q_confusion_text(spark, sf_dir):
    """A7 as printed in the report: a line for each non-zero cell of every run."""
    return M.confusion_lines(M.phase_cube(written_cube(choice_results(spark, sf_dir))))
