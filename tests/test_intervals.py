import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heartlake.catalog.core import catalog
from heartlake.functions.names import LABELS
from heartlake.plans import bootstrap
from tests.oracle import differences


def by_hand(rows, replicates):
    """Intervals of one cell's ``record_id, label, y, p``, pair by pair."""
    names = sorted({r[0] for r in rows})
    got = {}
    for rep in range(replicates):
        drawn = [names[int(hashlib.md5(f"42_{rep}_{d}".encode()).hexdigest()[:8], 16) % len(names)] for d in range(len(names))]
        areas = {}
        for label in {r[1] for r in rows}:
            per = {}
            for name, x, y, p in rows:
                if x == label and y is not None and p is not None and np.isfinite(p):
                    per.setdefault(name, []).append((y, p))
            many = [yp for d in drawn for yp in per.get(d, ())]
            one, none = (np.array([p for y, p in many if y == side]) for side in (1, 0))
            if many:
                areas[label] = ((one[:, None] > none).mean() + (one[:, None] == none).mean() / 2) if len(one) and len(none) else None
        for label, a in areas.items():
            if a is not None:
                got.setdefault(label, []).append(a)
        if areas and None not in areas.values():
            got.setdefault("macro", []).append(np.mean(list(areas.values())))
    return {m: (len(v), *np.quantile(v, [0.025, 0.975])) for m, v in got.items()}


def test_intervals_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(c, f"r{i:02d}", x, int(rng.random() < share), float(rng.integers(0, 6)) / 5) for c, n in (("a", 12), ("b", 12), ("c", 7)) for i in range(n) for x, share in (("u", 0.4), ("v", 0.15))]
    rows += [("a", "r03", "u", None, 0.5), ("a", "r04", "u", 1, float("nan")), ("b", "r05", "v", 1, None), ("b", "r99", "u", 1, 0.4)]
    df = spark.createDataFrame(rows, "cell string, record_id string, label string, y int, p double")
    got = {(r.cell, r.metric): (r.replicates_used, r.ci_low, r.ci_high) for r in bootstrap.record_intervals(df, ["cell"], replicates=300).collect()}
    want = {(c, m): v for c in "abc" for m, v in by_hand([r[1:] for r in rows if r[0] == c], 300).items()}
    assert set(got) == set(want)
    for key, v in want.items():
        assert got[key] == pytest.approx(v), key


def test_every_cell_has_all_replicates(spark, small):
    got = catalog.queries["auroc_intervals"](spark, small).cache()
    cells = got.groupBy("architecture", "source_dataset", "target_dataset").agg(F.max("replicates_used").alias("n"), F.count(F.lit(1)).alias("metrics")).collect()
    # a replicate counts only where both truths were drawn
    assert len(cells) == 50 and all(900 < r.n <= 1000 and r.metrics <= len(LABELS) + 1 for r in cells)
    macro = [r for r in got.where("metric = 'macro'").collect()]
    got.unpersist()
    widths = {(r.architecture, r.target_dataset): r for r in catalog.queries["auroc_interval_widths"](spark, small).collect()}
    for key in widths:
        w = [r.ci_high - r.ci_low for r in macro if (r.architecture, r.target_dataset) == key]
        assert widths[key].mean_width == pytest.approx(np.mean(w), abs=2e-6) and widths[key].sd_width == pytest.approx(np.std(w, ddof=1), abs=2e-6)
    assert len(widths) == len({(r.architecture, r.target_dataset) for r in macro})


def test_gap_intervals_agree_with_sql(spark, small):
    names = {"gap_intervals", "paired_gap_intervals"}
    assert names <= set(catalog.sql) and differences(catalog, spark, small, names) == {}
