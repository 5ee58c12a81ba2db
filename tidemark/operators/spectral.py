"""Spectral operators: numpy kernels on Arrow batches.

Coherence works on segments; the others transform a series whole, so a series is one group and the unit of memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.session import ship
from tidemark.spec import SeriesSpec


def _by_series(df: DataFrame, spec: SeriesSpec, kernel, columns: dict[str, object], keep_rows: bool = True) -> DataFrame:
    """Applies kernel(values sorted in order) -> {column: array}; added to the rows, or as new rows beside the keys."""
    fields = list(df.schema.fields) if keep_rows else [df.schema[k] for k in spec.keys]
    schema = StructType([*fields, *(StructField(k, t) for k, t in columns.items())])
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(spec.order))
        out = kernel(pdf)
        base = pdf.assign(**out) if keep_rows else pd.DataFrame({**{k: pdf[k].iloc[0] for k in spec.keys}, **out})
        return base[names]

    ship(df.sparkSession)
    return df.groupBy(*spec.keys).applyInPandas(run, schema)


def _segments(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[:: size - overlap] if len(x) >= size else np.zeros((0, size))


def _detrended(s: np.ndarray, how: str) -> np.ndarray:
    if how == "constant":
        return s - s.mean(axis=1, keepdims=True)
    t = np.arange(s.shape[1]) - (s.shape[1] - 1) / 2
    return s - s.mean(axis=1, keepdims=True) - ((s @ t) / (t @ t))[:, None] * t


def _window(name: str, size: int) -> np.ndarray:
    """Periodic windows."""
    return {"hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman, "boxcar": np.ones}[name](size + (name != "boxcar"))[:size]


def welch_coherence(x: np.ndarray, y: np.ndarray, fs: float = 1.0, nperseg: int = 256, noverlap: int | None = None, nfft: int | None = None, window: str = "hann", detrend: str = "constant") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, magnitude-squared coherence) averaged over segments, of two arrays."""
    noverlap, nfft = nperseg // 2 if noverlap is None else noverlap, nfft or nperseg
    fx, fy = (np.fft.rfft(_detrended(_segments(v, nperseg, noverlap), detrend) * _window(window, nperseg), nfft) for v in (x, y))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.abs((fx.conj() * fy).mean(axis=0)) ** 2 / ((np.abs(fx) ** 2).mean(axis=0) * (np.abs(fy) ** 2).mean(axis=0)) if len(fx) else np.zeros(0)
    return np.fft.rfftfreq(nfft, 1 / fs)[: len(c)], c


def coherence(df: DataFrame, spec: SeriesSpec, other: str, fs: float = 1.0, nperseg: int = 256, noverlap: int | None = None, nfft: int | None = None, window: str = "hann", detrend: str = "constant") -> DataFrame:
    """(keys, frequency, coherence) of two columns, averaged over segments.

    Rows are cut into segments first, so a long series is spread over tasks; a segment is transformed in an Arrow batch,
    and the cross spectra are summed in the JVM.
    """
    noverlap, nfft = nperseg // 2 if noverlap is None else noverlap, nfft or nperseg
    step, taper = nperseg - noverlap, _window(window, nperseg)
    part = spec.indexed(df.withColumns({"_x": spec.x, "_y": F.col(other).cast("double")}), "_t").withColumn("_n", F.count("*").over(spec.whole))
    first = F.greatest(F.ceil((F.col("_t") - nperseg + 1) / step), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("_t") / step), F.floor((F.col("_n") - nperseg) / step)).cast("long")
    cut = part.where((F.col("_n") >= nperseg) & (first <= last)).withColumn("_s", F.explode(F.sequence(first, last)))
    held = F.array_sort(F.collect_list(F.struct("_t", "_x", "_y")))
    segments = cut.groupBy(*spec.keys, "_s").agg(F.transform(held, lambda r: r["_x"]).alias("_x"), F.transform(held, lambda r: r["_y"]).alias("_y")).drop("_s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, nperseg) for c in ("_x", "_y"))
            fx, fy = (np.fft.rfft(_detrended(v, detrend) * taper, nfft) for v in (x, y))
            cross = fx.conj() * fy
            sums = np.stack([cross.real, cross.imag, np.abs(fx) ** 2, np.abs(fy) ** 2], axis=2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(spec.keys)], pa.array(sums.tolist(), pa.list_(pa.list_(pa.float64())))], names=[*spec.keys, "_f"])

    ship(df.sparkSession)
    schema = StructType([*(segments.schema[k] for k in spec.keys), StructField("_f", ArrayType(ArrayType(DoubleType())))])
    each = segments.mapInArrow(run, schema).select(*spec.keys, F.posexplode("_f").alias("_k", "_v"))
    re, im, a, b = (F.sum(F.col("_v")[i]) for i in range(4))
    return each.groupBy(*spec.keys, (F.col("_k") * (fs / nfft)).alias("frequency")).agg(F.try_divide(re * re + im * im, F.nullif(a * b, F.lit(0.0))).alias("coherence"))


def power(df: DataFrame, spec: SeriesSpec, fs: float = 1.0) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> dict:
        x = pdf[spec.value].to_numpy(float)
        return {"frequency": np.fft.rfftfreq(len(x), 1 / fs), "power": np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)}

    return _by_series(df, spec, kernel, {"frequency": DoubleType(), "power": DoubleType()}, keep_rows=False)


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def hilbert(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> dict:
        z = analytic(pdf[spec.value].to_numpy(float))
        return {"amplitude": np.abs(z), "phase": np.angle(z)}

    return _by_series(df, spec, kernel, {"amplitude": DoubleType(), "phase": DoubleType()})


def phase_shift(df: DataFrame, spec: SeriesSpec, angle: float) -> DataFrame:
    """Rotates every frequency by the angle (radians)."""

    def kernel(pdf: pd.DataFrame) -> dict:
        return {"shifted": (analytic(pdf[spec.value].to_numpy(float)) * np.exp(1j * angle)).real}

    return _by_series(df, spec, kernel, {"shifted": DoubleType()})


def butter_bandpass(df: DataFrame, spec: SeriesSpec, low: float, high: float, fs: float, order: int = 4) -> DataFrame:
    """Zero-phase Butterworth band-pass, as its squared gain in the frequency domain."""

    def kernel(pdf: pd.DataFrame) -> dict:
        x = pdf[spec.value].to_numpy(float)
        f = np.fft.rfftfreq(len(x), 1 / fs)
        with np.errstate(divide="ignore", over="ignore"):
            gain = 1 / (1 + (f / high) ** (2 * order)) / (1 + np.where(f > 0, low / np.maximum(f, 1e-300), np.inf) ** (2 * order))
        return {"filtered": np.fft.irfft(np.fft.rfft(x) * gain, len(x))}

    return _by_series(df, spec, kernel, {"filtered": DoubleType()})


def filtfilt(df: DataFrame, spec: SeriesSpec, taps: list[float]) -> DataFrame:
    """A FIR filter run forwards and backwards."""

    def kernel(pdf: pd.DataFrame) -> dict:
        x = pdf[spec.value].to_numpy(float)
        n = len(x) + 2 * len(taps)
        return {"filtered": np.fft.irfft(np.fft.rfft(x, n) * np.abs(np.fft.rfft(taps, n)) ** 2, n)[: len(x)]}

    return _by_series(df, spec, kernel, {"filtered": DoubleType()})


def morlet(df: DataFrame, spec: SeriesSpec, frequencies: list[float], fs: float, cycles: float = 6.0) -> DataFrame:
    """(t, frequency, power) of a complex Morlet transform."""

    def kernel(pdf: pd.DataFrame) -> dict:
        x = pdf[spec.value].to_numpy(float)
        spectrum, f = np.fft.fft(x - x.mean()), np.fft.fftfreq(len(x), 1 / fs)
        out = [np.abs(np.fft.ifft(spectrum * np.exp(-0.5 * ((f - c) * cycles / c) ** 2) * (f > 0))) ** 2 for c in frequencies]
        return {"t": np.tile(np.arange(len(x)), len(frequencies)), "frequency": np.repeat(frequencies, len(x)), "power": np.concatenate(out)}

    return _by_series(df, spec, kernel, {"t": LongType(), "frequency": DoubleType(), "power": DoubleType()}, keep_rows=False)


def slepian(n: int, nw: float, k: int) -> np.ndarray:
    """Discrete prolate tapers: leading eigenvectors of the tridiagonal form."""
    i = np.arange(n)
    t = np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)) + np.diag(i[1:] * (n - i[1:]) / 2, 1) + np.diag(i[1:] * (n - i[1:]) / 2, -1)
    _, v = np.linalg.eigh(t)
    return v[:, ::-1][:, :k].T


def multitaper(df: DataFrame, spec: SeriesSpec, size: int, step: int, nw: float = 2.5) -> DataFrame:
    """(window, frequency, power) averaged over Slepian tapers."""

    def kernel(pdf: pd.DataFrame) -> dict:
        s = _segments(pdf[spec.value].to_numpy(float), size, size - step)
        tapers = slepian(size, nw, max(1, int(2 * nw) - 1))
        p = (np.abs(np.fft.rfft(_detrended(s, "constant")[:, None] * tapers[None], axis=2)) ** 2).mean(axis=1) if len(s) else np.zeros((0, size // 2 + 1))
        f = np.fft.rfftfreq(size)
        return {"window": np.repeat(np.arange(len(s)), len(f)), "frequency": np.tile(f, len(s)), "power": p.ravel()}

    return _by_series(df, spec, kernel, {"window": LongType(), "frequency": DoubleType(), "power": DoubleType()}, keep_rows=False)


def padded(full: np.ndarray, n: int, k: int, mode: str) -> np.ndarray:
    """The part of a full convolution of lengths n and k: full, valid, or same, which starts at the upper half of the overhang."""
    if mode == "full":
        return full
    if mode not in ("same", "valid"):
        raise ValueError("mode must be full, same or valid")
    size = n if mode == "same" else max(n, k) - min(n, k) + 1
    first = -(-(k - 1) // 2) if mode == "same" else min(n, k) - 1
    return full[first : first + size]


def fft_convolve(df: DataFrame, spec: SeriesSpec, kernel: list[float], mode: str = "same") -> DataFrame:
    """(keys, t, value): convolution in the frequency domain, for kernels too long for a frame."""

    def run(pdf: pd.DataFrame) -> dict:
        x = pdf[spec.value].to_numpy(float)
        n = len(x) + len(kernel) - 1
        out = padded(np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(kernel, n), n), len(x), len(kernel), mode)
        return {"t": np.arange(len(out)), "conv": out}

    return _by_series(df, spec, run, {"t": LongType(), "conv": DoubleType()}, keep_rows=False)


def reversed_in_time(x: np.ndarray) -> np.ndarray:
    """The signal read backwards, by conjugating and shifting its spectrum."""
    n = len(x)
    turn = np.exp(2j * np.pi * np.arange(n) / max(n, 1))
    return np.fft.ifft(np.fft.fft(x).conj() * turn.conj() ** (n - 1)).real if n else x


def angle_difference(df: DataFrame, spec: SeriesSpec, other: str, centre: bool = True) -> DataFrame:
    """(keys, angle): the circular mean of the difference of the two signals' phases, in (-pi, pi]; negative where the first leads."""

    def run(pdf: pd.DataFrame) -> dict:
        x, y = (pdf[c].to_numpy(float) for c in (spec.value, other))
        if centre:
            x, y = x - x.mean(), y - y.mean()
        gap = np.angle(analytic(x)) - np.angle(analytic(y))
        return {"angle": [np.arctan2(np.sin(gap).mean(), np.cos(gap).mean())]}

    return _by_series(df, spec, run, {"angle": DoubleType()}, keep_rows=False)
