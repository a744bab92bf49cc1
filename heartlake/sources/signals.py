"""Signal files: arrays, headers with their digital samples, and packed archives."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import safe_relative_path
from ..operators.checks import require_rows, require_unique

#: ``gain(baseline)/unit`` of a header's signal line; the baseline may be missing.
_GAIN = re.compile(r"([-+0-9.eE]+)(?:\(([-+0-9.eE]+)\))?/(.+)")
RAW = "record_id string, rate double, leads array<string>, units array<string>, samples array<array<double>>, error string"


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, stem, length, modified_at`` of the files below ``root`` whose names match; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"), "length", F.col("modificationTime").alias("modified_at"))


def paths_of_records(manifest: DataFrame, files: DataFrame, key: str = "record_id") -> DataFrame:
    """``manifest`` with the ``path`` of each record's file; a stem found twice or not at all raises."""
    require_unique(files, ["stem"], "files")
    out = manifest.join(files.select(F.col("stem").alias(key), "path"), key, "left")
    require_rows(out, {"file exists": F.col("path").isNotNull()}, "records")
    return out


def missing_files(manifest: DataFrame, files: DataFrame, root: str, path: str = "signal_path") -> DataFrame:
    """Rows whose file isn't there; ``path`` is relative to ``root`` and must stay below it."""
    require_rows(manifest, {"safe path": safe_relative_path(F.col(path))}, "listing", allow_empty=True)
    there = files.select(F.regexp_replace("path", "^file:/+", "/").alias("__there"))
    return manifest.withColumn("__there", F.concat(F.lit(root.rstrip("/") + "/"), F.col(path))).join(there, "__there", "left_anti").drop("__there")


def verify_checksums(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``name, ok`` of files (``binaryFile`` rows) against ``name, sha256`` or ``name, md5``; a missing file isn't ok."""
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("got_sha256"), F.md5("content").alias("got_md5"))
    column = "sha256" if "sha256" in wanted.columns else "md5"
    return wanted.join(named, "name", "left").select("name", F.coalesce(F.lower(column) == F.col(f"got_{column}"), F.lit(False)).alias("ok"))


def read_arrays(spark: SparkSession, root: str, rate: float = 500.0) -> DataFrame:
    """``.npy`` files below ``root`` as raw signals in canonical leads and millivolts; broken files say why."""
    from ..plans.signals import LEADS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                stem = path.rsplit("/", 1)[-1].removesuffix(".npy")
                try:
                    x = np.load(io.BytesIO(content), allow_pickle=False)
                    rows.append((stem, rate, list(LEADS), ["mV"] * len(LEADS), [list(map(float, r)) for r in np.atleast_2d(x)], ""))
                except (ValueError, OSError, EOFError) as e:
                    rows.append((stem, rate, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["record_id", "rate", "leads", "units", "samples", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root)
    return files.select("path", "content").mapInPandas(run, RAW)


def parse_header(text: str) -> dict:
    """Rate, sample count and, per signal, lead, gain, baseline and unit of a header text.

    A line without a baseline uses its ADC zero.  Comments give age, sex and
    diagnosis codes.  A header that declares more signals than it has, or a
    gain of zero, raises.
    """
    lines = [x for x in text.splitlines() if x.strip()]
    top = lines[0].split() if lines else []
    if len(top) < 4:
        raise ValueError("the header has no record line")
    count = int(top[1])
    body = [x for x in lines[1:] if not x.startswith("#")]
    if len(body) < count:
        raise ValueError("the header declares more signals than it has")
    out = {"rate": float(top[2].split("/")[0]), "samples": int(top[3]), "leads": [], "gains": [], "baselines": [], "units": [], "age": "", "sex": "", "codes": []}
    for line in body[:count]:
        f = line.split()
        m = _GAIN.fullmatch(f[2]) if len(f) >= 9 else None
        if m is None or float(m[1]) == 0:
            raise ValueError(f"no gain in signal line {line!r}")
        out["gains"].append(float(m[1]))
        out["baselines"].append(float(m[2]) if m[2] is not None else float(f[4]))
        out["units"].append(m[3])
        out["leads"].append(f[-1])
    for line in lines:
        key, sign, value = line.lstrip("#").partition(":")
        if line.startswith("#") and sign:
            name = key.strip().lower()
            if name in ("age", "sex"):
                out[name] = value.strip()
            elif name == "dx":
                out["codes"] = [c.strip() for c in value.split(",") if c.strip()]
    return out


#: Number types of MATLAB level 4 matrices, by their code.
_MAT4 = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}


def read_mat4(data: bytes, name: str = "val") -> np.ndarray:
    """One matrix of a MATLAB level 4 file, which stores columns one after another."""
    at = 0
    while at + 20 <= len(data):
        order = "<" if struct.unpack_from("<i", data, at)[0] < 10000 else ">"
        kind, rows, cols, imaginary, length = struct.unpack_from(f"{order}5i", data, at)
        dtype = np.dtype(order + _MAT4[kind // 10 % 10])
        at += 20
        title = data[at : at + length].rstrip(b"\0").decode("latin-1")
        at += length
        size = rows * cols * dtype.itemsize
        if title == name:
            return np.frombuffer(data, dtype, rows * cols, at).reshape(cols, rows).T
        at += size * (2 if imaginary else 1)
    raise ValueError(f"no matrix {name!r}")


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """Headers (``.hea``) with their samples (``.mat``) below ``root`` as raw signals in physical units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stem, hea, mat in zip(batch["stem"], batch["hea"], batch["mat"]):
                try:
                    h = parse_header(bytes(hea).decode("utf-8"))
                    if mat is None:
                        raise ValueError("no samples")
                    x = read_mat4(bytes(mat)).astype(np.float64)
                    x = x.T if x.shape == (h["samples"], len(h["leads"])) else x
                    if x.shape != (len(h["leads"]), h["samples"]):
                        raise ValueError(f"shape {x.shape} isn't the header's")
                    x = (x - np.array(h["baselines"])[:, None]) / np.array(h["gains"])[:, None]
                    rows.append((stem, h["rate"], h["leads"], h["units"], [list(map(float, r)) for r in x], ""))
                except (ValueError, KeyError, UnicodeDecodeError, struct.error) as e:
                    rows.append((stem, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["record_id", "rate", "leads", "units", "samples", "error"])

    def files(suffix: str, name: str) -> DataFrame:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
        return f.select(F.regexp_replace("path", re.escape(suffix) + "$", "").alias("base"), F.col("content").alias(name))

    both = files(".hea", "hea").join(files(".mat", "mat"), "base", "left")
    return both.select(F.regexp_extract("base", r"([^/]+)$", 1).alias("stem"), "hea", "mat").mapInPandas(run, RAW)


def read_records(manifest: DataFrame, root: str) -> DataFrame:
    """Signals of the listing's wfdb rows; needs the ``wfdb`` package in the workers."""
    try:
        import wfdb  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading wfdb records needs the wfdb package; read_headers reads header and mat files without it") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import wfdb

        for batch in batches:
            rows = []
            for rid, path in zip(batch["record_id"], batch["signal_path"]):
                try:
                    r = wfdb.rdrecord(f"{root}/{path}")
                    rows.append((rid, float(r.fs), list(r.sig_name), list(r.units), [list(map(float, x)) for x in r.p_signal.T], ""))
                except Exception as e:  # noqa: BLE001 - whatever the package raises is the record's error, not the job's
                    rows.append((rid, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["record_id", "rate", "leads", "units", "samples", "error"])

    return manifest.select("record_id", "signal_path").mapInPandas(run, RAW)


def read_archives(manifest: DataFrame, root: str, rate: float = 400.0) -> DataFrame:
    """Signals of ``FILE::EXAM_ID`` rows, each file opened once per group; needs ``h5py`` in the workers."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading archives needs the h5py package") from e
    from ..plans.signals import LEADS

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import h5py

        with h5py.File(f"{root}/{group['file'].iloc[0]}", "r") as f:
            ids = f["exam_id" if "exam_id" in f else "id_exam"][:]
            signals = f["tracings" if "tracings" in f else "signal"]
            place = {str(int(x)): i for i, x in enumerate(ids)}
            rows = [(rid, rate, list(LEADS), ["mV"] * 12, [list(map(float, x)) for x in np.asarray(signals[place[e]]).T], "") if e in place else (rid, rate, None, None, None, f"no exam {e}") for rid, e in zip(group["record_id"], group["exam"])]
        return pd.DataFrame(rows, columns=["record_id", "rate", "leads", "units", "samples", "error"])

    # exams of one file are read in blocks, so a file with very many has several tasks
    split = manifest.select("record_id", F.split_part("signal_path", F.lit("::"), F.lit(1)).alias("file"), F.split_part("signal_path", F.lit("::"), F.lit(2)).alias("exam"))
    return split.withColumn("block", F.pmod(F.xxhash64("exam"), F.lit(16))).groupBy("file", "block").applyInPandas(run, RAW)
