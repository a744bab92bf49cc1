import math
import random
from collections import defaultdict

import numpy as np
import pytest

from heartlake.operators.implausible import SpikeRule, implausible_readings, impossible_or_spike, off_profile, profiled, readings, stuck, stuck_runs
from heartlake.operators.quantiles import exact_quantiles
from heartlake.operators.robust_pca import separate

SCHEMA = "reading_id bigint, signal_path string, device string, lead string, second_no int, amp double, unit string"


def brute(rows, rule=SpikeRule()):
    """Row by row: the three tests as they are stated."""
    out = {"impossible": set(), "spike": set(), "stuck": set()}
    mv, by_device, series = {}, defaultdict(list), defaultdict(dict)
    for i, path, device, lead, second, amp, unit in rows:
        if amp is None:
            continue
        v = amp / 1000 if unit and unit.strip().lower() == "uv" else amp
        v = round(v, 9) if math.isfinite(v) else v
        mv[i] = v
        if not math.isfinite(v) or v < 0:
            out["impossible"].add(i)
        if math.isfinite(v) and v >= 0 and device is not None:
            by_device[device].append(v)
        if math.isfinite(v) and second is not None:
            series[(path, device, lead)].setdefault(second, v)
    for i, _, device, _, _, _, _ in rows:
        if i in mv and math.isfinite(mv[i]) and by_device.get(device):
            a, m, b = np.quantile(by_device[device], [(1 - rule.middle) / 2, 0.5, (1 + rule.middle) / 2])
            if abs(mv[i] - m) > rule.spreads * (b - a) / 2:
                out["spike"].add(i)
    stuck = set()
    for key, at in series.items():
        run = []
        for s in [*sorted(at), None]:
            if s is not None and run and at[run[-1]] == at[s]:
                run.append(s)
                continue
            if len(run) >= rule.run:
                stuck |= {(key, x, at[x]) for x in run}
            run = [s]
    for i, path, device, lead, second, _, _ in rows:
        if i in mv and ((path, device, lead), second, mv[i]) in stuck:
            out["stuck"].add(i)
    return out


def made(seed, n=3000):
    r = random.Random(seed)
    rows, i = [], 0
    for path in range(6):
        device = ["a", "a", "b", "flat", None, "c"][path]
        for lead in ("I", "V1"):
            v = 1.0
            for second in range(n // 12):
                i += 1
                if device == "flat" or r.random() < 0.03:
                    pass
                elif r.random() < 0.9:
                    v = round(r.gauss(1.5, 0.1), 3)
                amp = v
                if second in range(120, 120 + 14) and lead == "I":
                    amp = 1.25
                if r.random() < 0.01:
                    amp = r.choice([None, float("nan"), float("inf"), -amp, amp + 40, amp * 1.4])
                unit = r.choice(["mV", "uV"])
                rows.append((i, f"f{path}", device, lead, second, amp if amp is None or unit == "mV" else amp * 1000, unit))
                if r.random() < 0.02:
                    i += 1
                    rows.append((i, *rows[-1][1:]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    got = implausible_readings(spark.createDataFrame(rows, SCHEMA), SpikeRule(chunk=64)).collect()
    want = brute(rows)
    for kind, ids in want.items():
        assert {r.reading_id for r in got if r.kind == kind} == ids, kind
    assert all(want.values())


def test_runs_over_pieces_nulls_and_repeats(spark):
    rows = [(k, "f", "d", "I", 250 + k, 2.0, "mV") for k in range(12)]
    rows += [(100, "f", "d", "I", 262, None, "mV"), (101, "f", "d", "I", 263, 2.0, "mV"), (102, "f", "d", "I", 263, 2.0, "mV")]
    rows += [(200 + k, "g", "d", "I", 0, 3.0, "mV") for k in range(20)]  # one second, delivered twenty times
    runs = stuck_runs(readings(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.from_second, r.to_second) for r in runs] == [(250, 263)]


def test_empty_null_and_one_device(spark):
    assert implausible_readings(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = [(1, None, None, None, None, None, None), (2, None, None, None, None, 1.0, None), (3, None, None, None, 1, float("nan"), "")]
    assert {(r.reading_id, r.kind) for r in implausible_readings(spark.createDataFrame(nulls, SCHEMA)).collect()} == {(3, "impossible")}
    flat = [(k, "f", "d", "I", k * 2, 1.0 + (k == 5), "mV") for k in range(9)]
    assert {r.reading_id for r in implausible_readings(spark.createDataFrame(flat, SCHEMA)).collect()} == {5}


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(1, "f", "d", "I", 1, -1.0, "mV", 7, 8, 9)], SCHEMA + ", mv int, series int, kind int")
    assert [(r.reading_id, r.kind) for r in implausible_readings(df).collect()] == [(1, "impossible")]


def test_low_rank_part_stays_in_its_box():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 1)) @ rng.normal(size=(1, 32)) + rng.normal(size=(40, 32)) * 0.1
    spiky = m.copy()
    spiky[::2] += 500  # every other row is out of all bounds
    low = separate(spiky, np.ones(m.shape, bool), 4.0)
    assert np.abs(low).max() <= 4.0
    assert np.abs(spiky[::2] - low[::2]).min() > 5
    assert np.abs(separate(m, np.ones(m.shape, bool), 4.0) - np.clip(m, -4, 4)).mean() < 0.5


def profile_rows(odd=()):
    """A device whose level swings widely with the second, and readings at the level of another second."""
    level = lambda k: 10 + 3 * math.sin(2 * math.pi * k / 64)
    r = random.Random(5)
    return [(f * 64 + k, f"f{f}", "d", "I", k, (level(k + 32) if f * 64 + k in odd else level(k)) + r.gauss(0, 0.02) if k else 10.0, "mV") for f in range(120) for k in range(64)]


def test_readings_off_the_profile_but_within_range(spark):
    odd = {64 * f + 16 + f % 3 for f in range(5, 100, 9)}
    read = readings(spark.createDataFrame(profile_rows(odd), SCHEMA))
    rule = SpikeRule(least=1.5, box=4.0, spreads=10.0)
    assert {x.reading_id for x in off_profile(read, rule).collect()} == odd
    # range alone finds none of them
    assert impossible_or_spike(read, rule).count() == 0
    z = {x.reading_id: abs(x.z) for x in profiled(read, rule).collect()}
    assert max(z[i] for i in odd) < 2


def test_blocks_hold_one_device_each(spark, monkeypatch):
    rows = [(d * 5000 + i, f"f{i // 100}", f"d{d}", "I", i % 100, 5.0 * (d + 1) + random.Random(i).gauss(0, 0.1), "mV") for d in range(3) for i in range(4000)]
    read = readings(spark.createDataFrame(rows, SCHEMA))
    a = {x.reading_id: round(x.usual, 3) for x in profiled(read, SpikeRule(block_rows=16)).collect()}
    b = {x.reading_id: round(x.usual, 3) for x in profiled(read.repartition(7), SpikeRule(block_rows=16)).collect()}
    assert a == b and len(a) == 12_000  # however the rows are laid out


def test_long_runs_and_readings_without_a_file(spark):
    rows = [(k, "f", "d", "I", k, 2.0, "mV") for k in range(3000)] + [(5000 + k, None, "d", "I", k, 2.0, "mV") for k in range(30)]
    read = readings(spark.createDataFrame(rows, SCHEMA))
    assert {x.reading_id for x in stuck(read, SpikeRule(chunk=64)).collect()} == set(range(3000))


def test_rule_must_leave_room():
    with pytest.raises(ValueError):
        SpikeRule(box=6, least=5)


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_numpys(spark, seed):
    r = np.random.default_rng(seed)
    values = {"a": r.normal(size=501) * 10.0 ** r.integers(-6, 6), "b": np.repeat([1.0, 2.0], [7, 1]), "c": np.array([-3.0]), "d": np.array([0.0, -0.0, 5e-324, 1e308, -1e308])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan")), ("n", None)]
    got = {x.g: x for x in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"lo": 0.16, "mid": 0.5, "hi": 0.84}).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k].n_values == len(v)
        np.testing.assert_allclose([got[k].lo, got[k].mid, got[k].hi], np.quantile(v, [0.16, 0.5, 0.84]), rtol=1e-12)
