"""Metrics against hand-computed cases and a brute-force Python statement of
macro precision / recall / F1 (zero division = 0) and flip rates."""

import random

import pytest

from sway.operators import metrics as M


def _results(spark, triples, run="r"):
    return spark.createDataFrame([(run, g, p, a) for g, p, a in triples], "run string, gt string, pred string, attack_pred string")


def py_macro(gt, pred):
    labels = sorted(set(gt) | set(pred))
    ps, rs, fs = [], [], []
    for lab in labels:
        tp = sum(1 for g, p in zip(gt, pred) if g == p == lab)
        npred = sum(1 for p in pred if p == lab)
        sup = sum(1 for g in gt if g == lab)
        ps.append(tp / npred if npred else 0.0)
        rs.append(tp / sup if sup else 0.0)
        fs.append(2 * tp / (npred + sup) if npred + sup else 0.0)
    acc = sum(1 for g, p in zip(gt, pred) if g == p) / len(gt)
    return acc, sum(ps) / len(ps), sum(rs) / len(rs), sum(fs) / len(fs)


def py_flips(gt, pred, att):
    n = len(gt)
    flip = sum(1 for p, a in zip(pred, att) if p != a)
    cor = sum(1 for g, p, a in zip(gt, pred, att) if g == a and p != a)
    inc = sum(1 for g, p, a in zip(gt, pred, att) if g == p and p != a)
    return flip / n, cor / n, inc / n


def test_macro_f1_paper_case(spark):
    ev = M.evaluate(_results(spark, [("A", "A", "A"), ("A", "B", "A"), ("B", "B", "A")])).first()
    assert ev.f1_before == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_flip_rates_paper_case(spark):
    ev = M.evaluate(_results(spark, [("A", "A", "B"), ("A", "B", "A"), ("A", "B", "C")])).first()
    assert (ev.overall_flipping_rate, ev.correct_flipping_rate, ev.incorrect_flipping_rate) == pytest.approx(
        (1.0, 1 / 3, 1 / 3))
    # invariant: flips = correct + incorrect + wrong-to-wrong
    assert ev.overall_flipping_rate >= ev.correct_flipping_rate + ev.incorrect_flipping_rate


def test_confusion_keeps_only_predicted_labels(spark):
    res = _results(spark, [("A", "A", "A"), ("B", "A", "A"), ("C", "B", "B")])
    cells = M.confusion_long(M.phase_cube(M.outcome_cube(res))).filter("phase = 'before'").collect()
    assert sorted((r.gt, r.pred, r.n) for r in cells) == [("A", "A", 1), ("B", "A", 1)]


def test_confusion_no_predicted_label_in_gold_is_empty(spark):
    res = _results(spark, [("A", "X", "X"), ("B", "Y", "Y")])
    assert M.confusion_long(M.phase_cube(M.outcome_cube(res))).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_runs_match_python(spark, seed):
    rnd = random.Random(seed)
    labels = ["A", "B", "C", "D", ""]
    data = {}
    for run in ("r1", "r2", "r3"):
        n = rnd.randint(5, 60)
        data[run] = [(rnd.choice(labels[:4]), rnd.choice(labels), rnd.choice(labels)) for _ in range(n)]
    df = None
    for run, triples in data.items():
        d = _results(spark, triples, run)
        df = d if df is None else df.unionByName(d)
    got = {r.run: r for r in M.evaluate(df).collect()}
    std = {r.run: r for r in M.phase_metrics(M.class_stats(M.phase_cube(M.outcome_cube(df)))).collect()}
    assert set(std) == set(data)
    for run, triples in data.items():
        gt, pred, att = map(list, zip(*triples))
        r = got[run]
        assert (r.accuracy_before, r.precision_before, r.recall_before, r.f1_before) == pytest.approx(py_macro(gt, pred))
        assert (r.accuracy_after, r.precision_after, r.recall_after, r.f1_after) == pytest.approx(py_macro(gt, att))
        assert (r.overall_flipping_rate, r.correct_flipping_rate, r.incorrect_flipping_rate) == pytest.approx(
            py_flips(gt, pred, att))
        assert r.n_items == len(triples)


def test_cube_counts_sum_to_rows(spark):
    from sway.plans.q_metrics import choice_results

    res = choice_results(spark, "/root/testdata/sf0.001")
    cube = M.outcome_cube(res)
    assert cube.agg({"n": "sum"}).first()[0] == res.count()


def test_latex_row_format(spark):
    ev = M.leaderboard(_results(spark, [("A", "A", "B"), ("A", "A", "A")])).first()
    assert ev.latex == " 1.000 & 0.500 & -0.500 & 1.000 & 0.333 & -0.667 & 0.500 & 0.000 & 0.500 "


def test_empty_input_gives_no_division_error(spark):
    empty = _results(spark, [("A", "A", "A")]).filter("false")
    assert M.evaluate(empty).count() == 0


@pytest.mark.parametrize("n_labels", [3, 71, 5000])
def test_every_label_and_cell_of_every_run_is_there(spark, n_labels):
    """No cap on labels: distinct labels, cells and their printed lines."""
    triples = [(f"L{i}", f"L{i * 7 % n_labels}", f"L{(i + 1) % n_labels}") for i in range(n_labels)]
    pcube = M.phase_cube(M.outcome_cube(_results(spark, triples)))
    assert M.predicted_labels(pcube).count() == 2 * n_labels
    for phase, col in (("before", 1), ("after", 2)):
        predicted = {t[col] for t in triples}
        want = {}
        for t in triples:
            if t[0] in predicted:
                want[t[0], t[col]] = want.get((t[0], t[col]), 0) + 1
        got = M.confusion_lines(pcube).filter(f"phase = '{phase}'").collect()
        assert sorted(r.text for r in got) == sorted(f"{g} -> {p} = {n}" for (g, p), n in want.items())


def test_missing_outcomes_are_no_hits(spark):
    ev = M.evaluate(_results(spark, [(None, None, None)] * 10)).first()
    assert ev.accuracy_before == 0.0 and ev.accuracy_after == 0.0
