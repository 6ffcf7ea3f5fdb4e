import math
import random

import pytest
from pyspark.sql import functions as F

from outrider.operators import metrics, ordering, splits


def frame(spark, rows):
    return spark.createDataFrame([(k, float(p), y) for k, (p, y) in enumerate(rows)], "id bigint, p double, label int")


SIX = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.6, 1), (0.1, 0)]


def test_average_precision_is_in_steps(spark):
    assert metrics.ranking_metrics(frame(spark, SIX), "label", "p").first().pr_auc == pytest.approx(0.7)
    five = frame(spark, [SIX[0], SIX[1], SIX[2], SIX[3], SIX[5]])
    assert metrics.ranking_metrics(five, "label", "p").first().roc_auc == pytest.approx(0.75)


def test_constant_scores(spark):
    got = metrics.evaluate(frame(spark, [(0.4, 1), (0.4, 0), (0.4, 0), (0.4, 0)])).first()
    assert got.pr_auc == pytest.approx(0.25) and got.roc_auc == pytest.approx(0.5)


def test_one_class_only(spark):
    got = metrics.evaluate(frame(spark, [(0.4, 0), (0.2, 0)])).first()
    assert got.pr_auc is None and got.roc_auc is None and got.brier == pytest.approx(0.1)


def test_weights_equal_repeated_rows(spark):
    random.seed(0)
    rows = [(random.choice([0.1, 0.4, 0.4, 0.9, random.random()]), random.randint(0, 1), random.randint(1, 4)) for _ in range(60)]
    once = spark.createDataFrame(rows, "p double, label int, w bigint")
    many = spark.createDataFrame([(p, y) for p, y, w in rows for _ in range(w)], "p double, label int")
    a, b = metrics.evaluate(once, weight="w").first(), metrics.evaluate(many).first()
    assert all(a[c] == pytest.approx(b[c]) for c in ("n", "prevalence", "mean_p", "brier", "logloss", "pr_auc", "roc_auc"))


def test_calibration_error_with_and_without_the_top(spark):
    rows = frame(spark, [(1.0, 0), (0.05, 0), (0.95, 1)])
    closed = metrics.expected_calibration_error(rows).first().ece
    open_ = metrics.expected_calibration_error(rows, closed_top=False).first().ece
    assert closed == pytest.approx((0.05 + 2 * abs(0.5 - 0.975)) / 3)
    assert open_ == pytest.approx((0.05 + 0.05) / 3)


def test_ranks_and_quantiles_equal_sorting(spark):
    random.seed(1)
    for pool in ([0.5], [0.0, 1.0], [random.random() for _ in range(30)], [-5.0, 1e6, 3.0]):
        rows = [(k, random.choice([*pool, None])) for k in range(400)]
        random.shuffle(rows)
        df = spark.createDataFrame(rows, "id bigint, v double")
        want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        got = {r.id: r["rank"] for r in ordering.global_rank(df, "v", "id").collect()}
        assert [got[i] for i, _ in want] == list(range(1, 401))
        known = sorted(v for _, v in rows if v is not None)
        q = ordering.quantiles(df, "v", [0, 0.25, 0.333, 1])
        for s, x in zip([0, 0.25, 0.333, 1], q, strict=True):
            at = (len(known) - 1) * s
            assert x == pytest.approx(known[int(at)] + (known[min(int(at) + 1, len(known) - 1)] - known[int(at)]) * (at - int(at)))
    wild = [float("nan"), float("inf"), -float("inf"), None, 1e12, 0.5]
    rows = [(k, wild[k % 9] if k % 9 < 6 and k % 5 else k / 1000) for k in range(900)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    missing = lambda v: v is None or v != v
    for down in (True, False):
        want = sorted(rows, key=lambda r: (missing(r[1]), 0 if missing(r[1]) else (-r[1] if down else r[1]), r[0]))
        got = {r.id: r["rank"] for r in ordering.global_rank(df, "v", "id", descending=down).collect()}
        assert [got[i] for i, _ in want] == list(range(1, 901))
    assert ordering.quantiles(spark.createDataFrame([(0.5,), (float("nan"),), (0.1,), (float("inf"),)], "v double"), "v", [0, 0.5]) == [0.1, 0.5]
    empty = spark.createDataFrame([], "id bigint, v double")
    assert ordering.global_rank(empty, "v", "id").count() == 0 and ordering.quantiles(empty, "v", [0.5]) == [None]


def test_top_fractions_capture_more_with_more_rows(spark):
    random.seed(2)
    df = frame(spark, [(random.choice([0.2, 0.5, 0.8]), random.randint(0, 1)) for _ in range(300)])
    for kind in ("quantile", "kth"):
        rows = metrics.top_fractions(df, "id", threshold=kind).collect()
        assert [r.k for r in rows] == [3, 15, 30, 60]
        assert all(a.captured <= b.captured for a, b in zip(rows, rows[1:], strict=False))


def test_threshold_metrics_without_flags(spark):
    got = metrics.threshold_metrics(frame(spark, SIX), 0.95).first()
    assert (got.precision, got.recall, got.flagged_fraction) == (0.0, 0.0, 0.0)


def test_running_sums_over_blocks(spark):
    df = frame(spark, [(k / 100, k % 3 == 0 and 1 or 0) for k in range(100)])
    got = {r["rank"]: r.running for r in metrics.running_sum(ordering.global_rank(df, "p", "id"), "rank", "label", 100, blocks=7).collect()}
    labels = [1 if k % 3 == 0 else 0 for k in range(99, -1, -1)]
    assert [got[k + 1] for k in range(100)] == [sum(labels[: k + 1]) for k in range(100)]


def test_no_cell_has_many_rows(spark):
    n = 40_000
    df = spark.range(n).select("id", F.when(F.col("id") == 7, 1e12).when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / n).alias("v"))
    plan = ordering.global_rank(df, "v", "id")
    cells, subs = df.agg(F.percentile_approx("v", [k / ordering.CELLS for k in range(1, ordering.CELLS)], 4 * ordering.CELLS), F.percentile_approx("id", [k / ordering.SUBS for k in range(1, ordering.SUBS)], 16 * ordering.SUBS)).first()
    dealt = ordering._dealt(ordering._dealt(df.withColumn("_t", F.col("id").cast("double")), "v", "_cell", ordering.edges(cells)), "_t", "_sub", ordering.edges(subs))
    sizes = dealt.groupBy("_cell").agg(F.count("*").alias("n"), F.count_distinct("v").alias("k"))
    assert sizes.filter("k > 1").agg(F.max("n")).first()[0] <= 20 * n / ordering.CELLS
    assert dealt.filter("v = 0.25").groupBy("_cell", "_sub").count().agg(F.max("count")).first()[0] <= 3 * n / ordering.SUBS
    assert plan.filter("id = 7").first()["rank"] == 1


def test_manifest(spark, tmp_path):
    import json

    from outrider.sources.writers import write_json

    df = spark.range(90).select("id", (F.col("id") % 30).alias("person"), (F.col("id") % 2).cast("int").alias("label"))
    told = splits.manifest(splits.group_split(df, "person", 0.2), "person", "label")
    assert told["straddling"] == 0 and {k: (v["rows"], v["people"]) for k, v in told["parts"].items()} == {"train": (72, 24), "test": (18, 6)}
    write_json(told, tmp_path / "manifest.json")
    assert json.loads((tmp_path / "manifest.json").read_text()) == told


def test_rows_without_an_entity_stay(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 6), (4, None)], "id bigint, person bigint")
    assert {r.id: r.split for r in splits.group_split(df, "person", 0.5).collect() if r.person is None} == {2: "train", 4: "train"}
    assert splits.three_way_split(df, "person").count() == 4


def test_splits_never_share_an_entity(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 137).alias("person"), (F.col("id") % 2).cast("int").alias("label"))
    for seed in (1, 42):
        parts = splits.three_way_split(df, "person", seed)
        assert parts.count() == 2000 and splits.straddling(parts, "person").first()[0] == 0
        people = {r.split: r.people for r in splits.split_quality(parts, "person", "label").collect()}
        assert people == {"test": 28, "valid": 28, "train": 81}
    folds = splits.group_folds(df, "person").groupBy("person").agg(F.count_distinct("fold").alias("k"))
    assert folds.filter("k > 1").count() == 0


def test_bootstrap_draws_as_many_entities_as_there_are(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 40).alias("person"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 300).alias("p"))
    weights = splits.bootstrap_weights(df, "person", 12)
    assert {r.s for r in weights.groupBy("draw").agg(F.sum("weight").alias("s")).collect()} == {40}
    draws = splits.cluster_bootstrap(df, "person", draws=12)
    again = splits.cluster_bootstrap(df, "person", draws=12)
    assert draws.count() == 12 and sorted(map(tuple, draws.collect())) == sorted(map(tuple, again.collect()))
    top = splits.bootstrap_top(df, "person", draws=12).collect()
    assert all(0 <= r["prec_top_10"] <= 1 and r["captured_top_1"] <= r["captured_top_20"] for r in top)
    ci = splits.intervals(draws, metrics.evaluate(df), ["brier", "pr_auc"]).collect()
    assert all(r.ci95_low <= r.ci95_high for r in ci)


def test_all_intervals(spark):
    import numpy as np

    from outrider.operators import splits
    from outrider.plans import catalog
    from outrider.plans.fixtures import scored_events

    folder = "/root/testdata/sf0.001"
    got = {r.metric: r for r in catalog.QUERIES["M_09_all_intervals"](spark, folder).collect()}
    tops = [f"{m}_top_{k}" for m in ("prec", "captured") for k in (1, 5, 10, 20)]
    assert sorted(got) == sorted(["pr_auc", "roc_auc", "brier", "logloss", *tops])
    rows = scored_events(spark, folder).select("person_id", "label", "p").toPandas().sort_values("p", ascending=False)
    draws = splits.bootstrap_top(spark.createDataFrame(rows), "person_id").toPandas()
    assert len(draws) == 500
    for c in tops:
        low, high = np.percentile(draws[c], [2.5, 97.5])
        assert abs(got[c].ci95_low - low) < 2e-5 and abs(got[c].ci95_high - high) < 2e-5
    for k in (1, 5, 10, 20):
        n = max(1, len(rows) * k // 100)
        edge = rows.p.iloc[n - 1]
        above, at = rows[rows.p > edge], rows[rows.p == edge]
        hits = above.label.sum() + at.label.sum() * (n - len(above)) / len(at)
        assert abs(got[f"captured_top_{k}"].point_estimate - hits) < 2e-5 and abs(got[f"prec_top_{k}"].point_estimate - hits / n) < 2e-5


def test_bootstrap_equals_copied_rows(spark):
    """Ties over many entities, an entity with most rows, missing scores, labels and entities: as if each draw's rows were written out."""
    from outrider.operators import bootstrap

    rows = [(i, 1 if i % 3 == 0 else 10 + i % 23, None if i % 17 == 0 else int(i % 4 == 0), 0.5 if i % 5 < 2 else None if i % 31 == 0 else float("nan") if i % 37 == 0 else (i * 7 % 1000) / 1000) for i in range(2600)]
    rows += [(3000, None, 1, 0.9)]
    df = spark.createDataFrame(rows, "id int, person int, label int, p double")
    fractions = (0.01, 0.2)
    got = {r.draw: r for r in splits.cluster_bootstrap(df, "person", draws=9, fractions=fractions).collect()}
    weights = {(r.draw, r.person): r.weight for r in splits.bootstrap_weights(df, "person", 9).collect()}
    assert sorted(got) == list(range(9))
    for d in range(9):
        steps: dict[float, list[int]] = {}
        for _, person, label, p in rows:
            w = weights.get((d, person), 0) if person is not None else 0
            at = steps.setdefault(p if p is not None and p == p else float("-inf"), [0, 0])
            at[0] += w
            at[1] += w * (label or 0)
        n, pos = (sum(v[k] for v in steps.values()) for k in (0, 1))
        assert got[d].n == n
        seen = tp = area = ranks = 0
        hits = dict.fromkeys(fractions, 0.0)
        for _, (a, b) in sorted(((k, v) for k, v in steps.items() if v[0]), reverse=True):
            for f in fractions:
                hits[f] += b * min(max(max(1, int(f * n)) - seen, 0), a) / a
            ranks += b * ((n - pos) - (seen - tp) - (a - b) / 2)
            seen, tp = seen + a, tp + b
            area += b * tp / seen
        assert math.isclose(got[d].pr_auc, area / pos) and math.isclose(got[d].roc_auc, ranks / (pos * (n - pos)))
        assert math.isclose(got[d].captured_top_1, hits[0.01]) and math.isclose(got[d].captured_top_20, hits[0.2])
    kinds = df.filter("person is not null").withColumn("p", F.when(~F.isnan("p"), F.col("p"))).select("person", "p").distinct().count()
    for draws in (3, 60):
        assert bootstrap.steps(df, "person", "label", "p", bootstrap.picked(df, "person", draws)).count() <= kinds


def test_bootstrap_of_nothing(spark):
    empty = spark.createDataFrame([], "person int, label int, p double")
    assert splits.cluster_bootstrap(empty, "person", draws=4).count() == 0
    one = spark.createDataFrame([(1, 1, 0.3)], "person int, label int, p double")
    got = splits.cluster_bootstrap(one, "person", draws=4).collect()
    assert len(got) == 4 and all(r.pr_auc == 1 and r.roc_auc is None for r in got)


def test_quantiles_of_several_columns(spark):
    """Outliers of many magnitudes, ties, infinite and missing values, the largest and the smallest doubles."""
    import numpy as np

    rng = np.random.default_rng(5)
    n = 1501
    columns = {
        "even": rng.random(n), "ties": rng.integers(0, 3, n) * 1.0, "one": np.full(n, -2.5), "far": np.append(rng.random(n - 1), 1e300),
        "magnitudes": 10.0 ** -np.arange(n, dtype=float).clip(0, 320), "ends": np.append(rng.normal(size=n - 4), [np.inf, -np.inf, 1.7e308, -1.7e308]), "tiny": rng.integers(0, 9, n) * 5e-324,
    }
    rows = [tuple(float(v[i]) for v in columns.values()) + (float("nan") if i % 2 else None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "missing"])).repartition(5)
    shares = [0, 0.1, 0.5, 0.975, 1]
    got = ordering.quantiles_of(df, [*columns, "missing"], shares)
    assert got.pop("missing") == [None] * 5
    for c, v in columns.items():
        ordered = sorted(v.tolist())
        for s, q in zip(shares, got[c], strict=True):
            k, part = int((n - 1) * s), (n - 1) * s % 1
            low, high = ordered[k], ordered[min(k + 1, n - 1)]
            assert q == (low if part == 0 or low == high else low + (high - low) * part), (c, s)
    assert ordering.quantiles_of(df, [], shares) == {}


def test_modes_of_several_columns(spark):
    from outrider.operators import profile

    df = spark.createDataFrame([("b", 10, None), ("a", 9, None), ("b", 10, None), ("a", 9, None), (None, 11, None)], "s string, n int, void string")
    assert profile.modes_of(df, ["s", "n", "void"]) == {"s": "a", "n": "9", "void": None}
    assert profile.scales_of(df, ["n"])["n"][0] == 9.8 and profile.modes_of(df, []) == {} and profile.scales_of(df, []) == {}


def test_running_counts_of_crowded_and_missing_scores(spark):
    """Scores crowded near 0, outside of [0, 1], and missing ones, which come last; windows within cells stay small."""
    rows = [(k, None if k % 50 == 0 else float("nan") if k % 50 == 1 else 3.0 if k % 50 == 2 else k * 1e-9, int(k % 3 == 0)) for k in range(4000)]
    out = ordering.cumulative_by_score(spark.createDataFrame(rows, "id int, p double, label int"), "label", "p").collect()
    seen = tp = 0
    order = sorted(out, key=lambda r: (r.score is None, -(r.score or 0)))
    for r in order:
        mine = [x for x in rows if (x[1] is None or x[1] != x[1] if r.score is None else x[1] == r.score)]
        seen, tp = seen + len(mine), tp + sum(x[2] for x in mine)
        assert (r.n, r.seen, r.tp, r.all_n) == (len(mine), seen, tp, 4000)
    assert order[-1].score is None and order[0].score == 3.0
