"""Signals in one form: leads, unit, rate and length; their windows and fingerprints.

A signal is one row; the numeric work runs in NumPy on Arrow batches, a record
at a time, and the tables stay tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Canonical leads, and units in millivolts.
LEADS = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")
MILLIVOLTS = {"mv": 1.0, "millivolt": 1.0, "millivolts": 1.0, "uv": 1e-3, "microvolt": 1e-3, "microvolts": 1e-3, "v": 1e3, "volt": 1e3, "volts": 1e3}


@dataclass(frozen=True)
class Form:
    """The common form: rate, seconds and leads; its unit is the millivolt."""

    rate: int = 500
    seconds: int = 10
    leads: tuple[str, ...] = LEADS
    window: int = 2500
    coarse: int = 64

    @property
    def samples(self) -> int:
        return self.rate * self.seconds


FORM = Form()


def lead_name(name: str) -> str:
    """Canonical spelling of a lead; anything that is no lead raises."""
    compact = str(name).replace(" ", "").strip().lower()
    for lead in LEADS:
        if lead.lower() == compact:
            return lead
    raise ValueError(f"unknown lead {name!r}")


def fourier_resample(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``x`` with ``n`` samples, by cutting or padding their spectrum.

    The component at half the rate counts half on each side when its partner
    is cut off, and is split when it gains one.
    """
    m = x.shape[-1]
    if n == m:
        return x
    spectrum = np.fft.rfft(x, axis=-1)
    keep = min(m, n)
    out = np.zeros((*x.shape[:-1], n // 2 + 1), dtype=complex)
    out[..., : keep // 2 + 1] = spectrum[..., : keep // 2 + 1]
    if keep % 2 == 0:
        out[..., keep // 2] *= 2.0 if n < m else 0.5
    return np.fft.irfft(out, n, axis=-1) * (n / m)


def in_form(signal: np.ndarray, rate: float, leads: Sequence[str], units: str | Sequence[str], form: Form = FORM) -> np.ndarray:
    """A signal in the common form: leads by row and in order, millivolts, ``rate`` and length; float32.

    Missing, repeated or unknown leads, an unknown unit, a rate that isn't
    positive and a shape that fits neither way round raise.  Short signals are
    filled with zeros on the right, long ones cut.
    """
    names = [lead_name(x) for x in leads]
    if sorted(names) != sorted(form.leads):
        raise ValueError(f"leads {names} are not those of the form")
    x = np.asarray(signal, dtype=np.float64)
    if x.ndim != 2 or x.shape[0] == x.shape[1] or len(names) not in x.shape:
        raise ValueError(f"shape {x.shape} doesn't say which axis holds the {len(names)} leads")
    if x.shape[0] != len(names):
        x = x.T
    if not np.isfinite(rate) or rate <= 0:
        raise ValueError(f"rate {rate} is not positive")
    each = [units] * len(names) if isinstance(units, str) else list(units)
    if len(each) != len(names):
        raise ValueError("one unit per lead, or one for all")
    scale = []
    for u in each:
        key = str(u).strip().lower().replace("μ", "u").replace("µ", "u")
        if key not in MILLIVOLTS:
            raise ValueError(f"unknown unit {u!r}")
        scale.append(MILLIVOLTS[key])
    x = (x * np.array(scale)[:, None])[[names.index(lead) for lead in form.leads]]
    n = int(round(x.shape[1] * form.rate / rate))
    if n <= 0:
        raise ValueError("nothing is left at the common rate")
    x = fourier_resample(x, n)[:, : form.samples]
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, form.samples - x.shape[1]))), dtype=np.float32)


def quality(signal: np.ndarray, form: Form = FORM, flat: float = 1e-8) -> dict[str, bool]:
    """Flags of a signal in the common form; one flat lead alone doesn't fail it."""
    x = np.asarray(signal)
    shape, kind, finite = x.shape == (len(form.leads), form.samples), x.dtype == np.float32, bool(np.isfinite(x).all())
    usable = shape and finite
    out = {
        "shape_ok": shape,
        "dtype_ok": kind,
        "finite_ok": finite,
        "not_all_zero": bool(usable and np.ptp(x) > flat),
        "no_flat_leads": bool(usable and (np.ptp(x, axis=1) > flat).all()),
        "amplitude_ok": bool(finite and x.size and np.abs(x).max() < 100.0),
    }
    return out | {"passed": all(v for k, v in out.items() if k != "no_flat_leads")}


def _standard(x: np.ndarray, least: float) -> np.ndarray:
    mean, sd = x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True)
    return np.where(sd > least, (x - mean) / (sd + 1e-8), 0.0).astype(np.float32)


def model_windows(signal: np.ndarray, valid: int, form: Form = FORM) -> np.ndarray:
    """``(windows, leads, window)``: the valid samples standardised per lead, cut in five-second windows."""
    x = np.asarray(signal, dtype=np.float32)
    if x.shape != (len(form.leads), form.samples) or not np.isfinite(x).all() or valid not in (form.window, 2 * form.window):
        raise ValueError("a finite signal in the common form with one or two valid windows is needed")
    return _standard(x[:, :valid], 0.0).reshape(len(form.leads), -1, form.window).transpose(1, 0, 2).copy()


def window_hash(window: np.ndarray, microvolts: float = 1.0) -> str:
    """SHA-256 of a window in whole steps of ``microvolts``."""
    x = np.asarray(window, dtype=np.float64)
    if not np.isfinite(x).all():
        raise ValueError("a window must be finite")
    return hashlib.sha256(np.rint(x * (1000.0 / microvolts)).astype("<i4").tobytes()).hexdigest()


def fingerprint(window: np.ndarray, form: Form = FORM) -> np.ndarray:
    """Unit vector of the window's shape: standardised per lead and made coarse; a flat window raises."""
    v = fourier_resample(_standard(np.asarray(window, np.float32), 1e-8), form.coarse).astype(np.float32).ravel()
    length = float(np.linalg.norm(v))
    if not np.isfinite(length) or length <= 1e-8:
        raise ValueError("a flat window has no fingerprint")
    return v / length


def similarity(a: np.ndarray, b: np.ndarray, rate: int = 100, lag_ms: int = 100, seconds: int = 5) -> tuple[float, float, int]:
    """Median correlation, median normalised error and lag of two windows at their best lag.

    The best lag has the highest correlation, then the lowest error, then comes
    first.  Two windows without any common moving lead give NaN and infinity.
    """
    n, most = seconds * rate, int(round(lag_ms * rate / 1000.0))
    x, y = (fourier_resample(_standard(np.asarray(w, np.float32), 1e-8), n).astype(np.float32) for w in (a, b))
    best = (float("nan"), float("inf"), 0)
    for lag in range(-most, most + 1):
        p, q = x[:, max(0, -lag) : n - max(0, lag)], y[:, max(0, lag) : n - max(0, -lag)]
        size = np.sqrt((p * p).sum(1) * (q * q).sum(1))
        ok = size > 1e-8
        if ok.any():
            corr = float(np.median((p * q).sum(1)[ok] / size[ok]))
            error = float(np.median(np.sqrt(((p - q) ** 2).mean(1)[ok])))
            if np.isnan(best[0]) or (corr, -error) > (best[0], -best[1]):
                best = (corr, error, lag)
    return best


def _matrix(x: object) -> np.ndarray:
    return np.stack([np.asarray(row, dtype=np.float64) for row in x])


def standardized(df: DataFrame, form: Form = FORM) -> DataFrame:
    """Raw signals in the common form: ``record_id, signal, <flags>, resampled, padded, truncated, error``.

    ``df`` has ``record_id, rate, leads, units, samples`` (a list per lead, or
    per sample).  There are two verdicts: ``passed`` by the flags of ``quality``,
    and ``basic_passed`` by shape, rate, NaN and all zeros alone.  A signal that can't be brought into the form has a null
    ``signal`` and says why in ``error``.
    """
    flags = ["shape_ok", "dtype_ok", "finite_ok", "not_all_zero", "no_flat_leads", "amplitude_ok", "passed"]
    extra = ["resampled", "padded", "truncated", "leads_reordered", "unit_converted", "has_nan", "has_infinite", "is_flatline", "basic_passed"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    raw = _matrix(r.samples)
                    x = in_form(raw, float(r.rate), list(r.leads), list(r.units), form)
                    n, q = max(raw.shape), quality(x, form)
                    same_rate = float(r.rate) == form.rate
                    nan, flat = bool(np.isnan(x).any()), bool((np.abs(x) <= 1e-6).all())
                    seen = (not same_rate, n < form.samples, n > form.samples, tuple(map(lead_name, r.leads)) != form.leads, any(str(u).strip().lower() != "mv" for u in r.units), nan, bool(np.isinf(x).any()), flat)
                    rows.append((r.record_id, x.ravel(), *q.values(), *seen, q["shape_ok"] and same_rate and not nan and not flat, ""))
                except (ValueError, TypeError) as e:
                    rows.append((r.record_id, None, *[False] * (len(flags) + len(extra)), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["record_id", "signal", *flags, *extra, "error"])

    schema = "record_id string, signal array<float>, " + ", ".join(f"{c} boolean" for c in [*flags, *extra]) + ", error string"
    return df.select("record_id", "rate", "leads", "units", "samples").mapInPandas(run, schema)


def quality_totals(df: DataFrame) -> DataFrame:
    """One row of counts over ``standardized`` signals."""
    names = ["passed", "no_flat_leads", "amplitude_ok", "resampled", "padded", "truncated"]
    return df.agg(F.count(F.lit(1)).alias("records"), *[F.count_if(c).alias(c) for c in names], F.count_if(F.col("error") != "").alias("errors"))


def patterns(df: DataFrame) -> DataFrame:
    """How often each sequence of leads and of units occurs among raw signals."""
    return df.groupBy(F.array_join("leads", "|").alias("leads"), F.array_join("units", "|").alias("units")).agg(F.count(F.lit(1)).alias("records"))


def windows(df: DataFrame, form: Form = FORM) -> DataFrame:
    """``record_id, window_index, exact_hash, features``: fingerprints of the valid windows.

    ``df`` has ``record_id, signal, valid_num_samples``.  A window that isn't
    finite has neither hash nor features, a flat one no features.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                x = np.asarray(r.signal, np.float32).reshape(len(form.leads), form.samples)
                for i in range(int(r.valid_num_samples) // form.window):
                    w = x[:, i * form.window : (i + 1) * form.window]
                    rows.append((r.record_id, i, _or_none(window_hash, w), _or_none(lambda v: fingerprint(v, form), w)))
            yield pd.DataFrame(rows, columns=["record_id", "window_index", "exact_hash", "features"])

    usable = df.where(F.col("signal").isNotNull() & F.col("valid_num_samples").isNotNull())
    return usable.select("record_id", "signal", "valid_num_samples").mapInPandas(run, "record_id string, window_index int, exact_hash string, features array<float>")


def _or_none(f: Callable, x: np.ndarray):
    try:
        return f(x)
    except ValueError:
        return None


def verified(pairs: DataFrame, rate: int = 100, lag_ms: int = 100, form: Form = FORM) -> DataFrame:
    """``pairs`` (with flat windows ``left`` and ``right``) plus ``median_correlation, median_nrmse, lag``."""
    keep = [c for c in pairs.columns if c not in ("left", "right")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shape = (len(form.leads), form.window)
            got = [similarity(np.asarray(a).reshape(shape), np.asarray(b).reshape(shape), rate, lag_ms) for a, b in zip(batch["left"], batch["right"])]
            out = batch[keep].copy()
            for i, name in enumerate(("median_correlation", "median_nrmse", "lag")):
                out[name] = [g[i] for g in got]
            yield out

    kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in keep)
    return pairs.mapInPandas(run, f"{kinds}, median_correlation double, median_nrmse double, lag int")
