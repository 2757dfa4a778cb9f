"""Consistency metrics (A1-A13, F24, SNK3 content).

Design: one aggregation, the *outcome cube* ``(run, gt, pred, attack_pred) ->
n``, is a sufficient statistic for every metric. It is computed with a
partial (map-side) + final hash aggregate, so a run holding a third of all
rows costs no more than any other run; every later step reads the cube, whose
size is the number of distinct outcome triples, not the number of items.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RunCols = Sequence[str]
METRICS = ("accuracy", "precision", "recall", "f1")
FLIPS = ("overall_flipping_rate", "correct_flipping_rate", "incorrect_flipping_rate")


def _eq(a: Column, b: Column) -> Column:
    """Equal and known: a missing outcome is never a hit."""
    return F.coalesce(a == b, F.lit(False))


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def outcome_cube(results: DataFrame, run_cols: RunCols = ("run",), gt: str = "gt", pred: str = "pred",
                 attack_pred: str = "attack_pred") -> DataFrame:
    """A1: ``(run..., gt, pred, attack_pred, n)``."""
    return results.groupBy(*run_cols, F.col(gt).alias("gt"), F.col(pred).alias("pred"),
                           F.col(attack_pred).alias("attack_pred")).agg(F.count(F.lit(1)).alias("n"))


def phase_cube(cube: DataFrame, run_cols: RunCols = ("run",)) -> DataFrame:
    """Unpivot the cube into ``(run..., phase, gt, pred, n)`` with phase
    ``before`` (first answer) and ``after`` (answer after the challenge)."""
    long = cube.select(
        *run_cols, "gt", "n",
        F.inline(F.array(
            F.struct(F.lit("before").alias("phase"), F.col("pred").alias("label_pred")),
            F.struct(F.lit("after").alias("phase"), F.col("attack_pred").alias("label_pred")),
        )),
    )
    return long.groupBy(*run_cols, "phase", "gt", F.col("label_pred").alias("pred")).agg(F.sum("n").alias("n"))


def class_stats(cube: DataFrame, run_cols: RunCols = ("run",)) -> DataFrame:
    """A3: per ``(run, phase, label)``: tp, predicted, support over the union of
    gold and predicted labels (the empty string is a label). Takes the outcome
    cube (``gt, pred, attack_pred, n``: both phases, read directly with no
    intermediate aggregation) or a phase cube (``phase, gt, pred, n``)."""
    gt, n, zero = F.col("gt"), F.col("n"), F.lit(0).cast("bigint")

    def both(phase, pred: Column) -> list[Column]:
        return [
            F.struct(phase.alias("phase"), gt.alias("label"), n.alias("support"), zero.alias("predicted"),
                     F.when(_eq(gt, pred), n).otherwise(zero).alias("tp")),
            F.struct(phase.alias("phase"), pred.alias("label"), zero.alias("support"), n.alias("predicted"),
                     zero.alias("tp")),
        ]

    if "attack_pred" in cube.columns:
        parts = both(F.lit("before"), F.col("pred")) + both(F.lit("after"), F.col("attack_pred"))
    else:
        parts = both(F.col("phase"), F.col("pred"))
    rows = cube.select(*run_cols, F.inline(F.array(*parts)))
    return rows.groupBy(*run_cols, "phase", "label").agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))


def phase_metrics(stats: DataFrame, run_cols: RunCols = ("run",)) -> DataFrame:
    """Accuracy and macro precision / recall / F1 (zero division
    counts as 0) per ``(run, phase)``."""
    zero = F.lit(0.0)
    return stats.groupBy(*run_cols, "phase").agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.coalesce(_ratio(F.col("tp"), F.col("predicted")), zero)).alias("precision"),
        F.avg(F.coalesce(_ratio(F.col("tp"), F.col("support")), zero)).alias("recall"),
        F.avg(F.coalesce(_ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")), zero)).alias("f1"),
        F.count(F.lit(1)).alias("n_labels"),
    )


def flip_rates(cube: DataFrame, run_cols: RunCols = ("run",)) -> DataFrame:
    """Overall, correct (wrong -> right) and incorrect (right -> wrong)
    flipping rates per run; empty input gives nulls, not a division error."""
    flipped = ~_eq(F.col("pred"), F.col("attack_pred"))
    n = F.col("n")

    def share(cond: Column) -> Column:
        return _ratio(F.sum(F.when(cond, n).otherwise(F.lit(0))), F.sum(n))

    return cube.groupBy(*run_cols).agg(
        F.sum(n).alias("n_items"),
        share(flipped).alias("overall_flipping_rate"),
        share(flipped & _eq(F.col("gt"), F.col("attack_pred"))).alias("correct_flipping_rate"),
        share(flipped & _eq(F.col("gt"), F.col("pred"))).alias("incorrect_flipping_rate"),
    )


def confusion_long(pcube: DataFrame, run_cols: RunCols = ("run",)) -> DataFrame:
    """Confusion cells ``(run, phase, gt, pred, n)`` restricted to the
    labels that were predicted at least once; gold labels never predicted drop
    out. Only non-zero cells are emitted (the matrix is implied), so the output
    never grows quadratically with the number of labels."""
    keys = [*run_cols, "phase"]
    labels = pcube.select(*keys, F.col("pred").alias("gt")).distinct()
    return pcube.join(labels, on=[*keys, "gt"], how="left_semi").select(*keys, "gt", "pred", "n")


def predicted_labels(pcube: DataFrame, run_cols: RunCols = ("run",)) -> DataFrame:
    """The distinct predicted labels ``(run, phase, label)`` of every run."""
    return pcube.select(*run_cols, "phase", F.col("pred").alias("label")).distinct()


def evaluate(results: DataFrame, run_cols: RunCols = ("run",), gt: str = "gt", pred: str = "pred",
             attack_pred: str = "attack_pred") -> DataFrame:
    """One row per run with accuracy / precision / recall / f1 before and
    after the challenge plus the three flipping rates."""
    cube = outcome_cube(results, run_cols, gt, pred, attack_pred)
    return evaluate_cube(cube, run_cols)


def evaluate_cube(cube: DataFrame, run_cols: RunCols = ("run",)) -> DataFrame:
    """A12 from the cube in one chain (cube -> per-label sums -> per-run row):
    every cube row expands into its four class contributions (gold/predicted,
    before/after) and one flip contribution, so the cube is read once and no
    join is needed."""
    gt, pr, at, n = F.col("gt"), F.col("pred"), F.col("attack_pred"), F.col("n")
    zero = F.lit(0).cast("bigint")
    flipped = ~_eq(pr, at)

    def row(phase: str, label: Column, tp: Column, predicted: Column, support: Column,
            flip: Column = zero, correct: Column = zero, incorrect: Column = zero, items: Column = zero) -> Column:
        return F.struct(F.lit(phase).alias("phase"), label.alias("label"), tp.alias("tp"),
                        predicted.alias("predicted"), support.alias("support"), flip.alias("flip"),
                        correct.alias("correct"), incorrect.alias("incorrect"), items.alias("items"))

    def hit(c: Column) -> Column:
        return F.when(c, n).otherwise(zero)

    rows = cube.select(*run_cols, F.inline(F.array(
        row("before", gt, hit(_eq(gt, pr)), zero, n),
        row("before", pr, zero, n, zero),
        row("after", gt, hit(_eq(gt, at)), zero, n),
        row("after", at, zero, n, zero),
        row("flip", F.lit(None).cast("string"), zero, zero, zero, hit(flipped), hit(flipped & _eq(gt, at)),
            hit(flipped & _eq(gt, pr)), n),
    )))
    sums = ["tp", "predicted", "support", "flip", "correct", "incorrect", "items"]
    per_label = rows.groupBy(*run_cols, "phase", "label").agg(*[F.sum(c).alias(c) for c in sums])
    ph, tp, p, sp = F.col("phase"), F.col("tp"), F.col("predicted"), F.col("support")
    aggs = []
    for phase in ("before", "after"):
        on = ph == phase

        def within(x: Column) -> Column:
            return F.when(on, x)

        aggs += [
            _ratio(F.sum(within(tp)), F.sum(within(sp))).alias(f"accuracy_{phase}"),
            F.avg(within(F.coalesce(_ratio(tp, p), F.lit(0.0)))).alias(f"precision_{phase}"),
            F.avg(within(F.coalesce(_ratio(tp, sp), F.lit(0.0)))).alias(f"recall_{phase}"),
            F.avg(within(F.coalesce(_ratio(2 * tp, p + sp), F.lit(0.0)))).alias(f"f1_{phase}"),
        ]
    items = F.sum(F.when(ph == "flip", F.col("items")))
    aggs += [items.alias("n_items")]
    for name, c in zip(FLIPS, ("flip", "correct", "incorrect")):
        aggs.append(_ratio(F.sum(F.when(ph == "flip", F.col(c))), items).alias(name))
    return per_label.groupBy(*run_cols).agg(*aggs)


def _r3(c: Column) -> Column:
    return F.round(c, 3)


def latex_row(metrics: DataFrame) -> Column:
    """the 9-cell LaTeX row (3 decimals, deltas of the rounded values)."""
    cells = [
        _r3(F.col("accuracy_before")), _r3(F.col("accuracy_after")),
        _r3(F.col("accuracy_after")) - _r3(F.col("accuracy_before")),
        _r3(F.col("f1_before")), _r3(F.col("f1_after")), _r3(F.col("f1_after")) - _r3(F.col("f1_before")),
        _r3(F.col("overall_flipping_rate")), _r3(F.col("correct_flipping_rate")),
        _r3(F.col("incorrect_flipping_rate")),
    ]
    return F.format_string(" " + " & ".join(["%.3f"] * 9) + " ", *cells)


def leaderboard(results: DataFrame, run_cols: RunCols = ("run",), **cols) -> DataFrame:
    """Per-run rollup with the LaTeX row."""
    m = evaluate(results, run_cols, **cols)
    return m.withColumn("latex", latex_row(m))


REPORT_SECTIONS = (
    ("Before questioning", [(m, f"{m}_before") for m in METRICS] + [("confusion_matrix", "@before")]),
    ("After questioning", [(m, f"{m}_after") for m in METRICS] + [("confusion_matrix", "@after")]),
    ("Flipping", [(m, m) for m in FLIPS]),
    ("Latex table", [("latex", "@latex")]),
)


def report_entries() -> list[tuple[str, int, str, str]]:
    """``(section, ordinal, key, source)`` in report order; ``source`` is a
    board column, ``@before``/``@after`` (confusion text) or ``@latex``."""
    out, o = [], 0
    for section, items in REPORT_SECTIONS:
        for key, src in items:
            out.append((section, o, key, src))
            o += 1
    return out


def report_long(board: DataFrame, run_cols: RunCols = ("run",), confusion: DataFrame | None = None) -> DataFrame:
    """SNK3 content: ``(run, section, ordinal, key, value, text)`` rows — the
    report as a long table (value for numbers, text for the LaTeX row). With
    ``confusion`` (the cells of ``confusion_long``) there is one row per non-zero
    cell, ``gold -> predicted = n``, however many labels a run has."""
    entries = []
    for section, o, key, src in report_entries():
        if src == "@latex":
            value, text = F.lit(None).cast("double"), F.col("latex")
        elif src.startswith("@"):
            continue
        else:
            value, text = F.col(src).cast("double"), F.lit(None).cast("string")
        entries.append(F.struct(F.lit(section).alias("section"), F.lit(o).alias("ordinal"), F.lit(key).alias("key"),
                                value.alias("value"), text.alias("text")))
    rows = board.select(*run_cols, F.inline(F.array(*entries)))
    if confusion is None:
        return rows
    where = {src[1:]: (section, o) for section, o, key, src in report_entries() if src in ("@before", "@after")}
    ph = F.col("phase")
    cells = confusion.join(board.select(*run_cols), list(run_cols), "left_semi").select(
        *run_cols,
        F.when(ph == "before", F.lit(where["before"][0])).otherwise(F.lit(where["after"][0])).alias("section"),
        F.when(ph == "before", F.lit(where["before"][1])).otherwise(F.lit(where["after"][1])).alias("ordinal"),
        F.lit("confusion_matrix").alias("key"), F.lit(None).cast("double").alias("value"), cell_text().alias("text"))
    return rows.unionByName(cells)


def cell_text() -> Column:
    """A confusion cell as a line of text."""
    return F.format_string("%s -> %s = %d", F.col("gt"), F.col("pred"), F.col("n"))


def confusion_lines(pcube: DataFrame, run_cols: RunCols = ("run",)) -> DataFrame:
    """A7 for print: a line ``(run, phase, text)`` for each non-zero cell of every
    run, whatever its number of labels."""
    return confusion_long(pcube, run_cols).select(*run_cols, "phase", cell_text().alias("text"))


def label_results(df: DataFrame, gt: Column, pred: Column, attack_pred: Column, run: Column) -> DataFrame:
    """Shape any table into the ``(run, gt, pred, attack_pred)`` results form."""
    return df.select(run.alias("run"), gt.cast("string").alias("gt"), pred.cast("string").alias("pred"),
                     attack_pred.cast("string").alias("attack_pred"))


def step_budget(df: DataFrame, epochs: int, batch_size: int) -> DataFrame:
    """Corpus size and the training step budget ``epochs * ceil(n / batch)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", (F.lit(epochs) * F.ceil(F.col("n_rows") / F.lit(batch_size))).cast("bigint").alias("total_steps"))
