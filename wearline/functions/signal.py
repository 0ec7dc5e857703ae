"""Column functions over signal arrays: time-domain statistics, Welch spectra, bands and divergences.

Statistics of one array run as JVM higher-order functions. The Fourier transform has no built-in, so the
spectrum is an Arrow-batched numpy function over many acquisitions at once. Undefined values are NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature names. Fixed values.
TIME_FEATURES = (
    "mean", "std", "variance", "rms", "minimum", "maximum", "max_abs", "peak_to_peak", "skewness", "kurtosis",
    "energy", "crest_factor", "shape_factor", "impulse_factor", "clearance_factor",
)
SPECTRAL_FEATURES = (
    "dominant_frequency_hz", "dominant_spectral_power", "spectral_centroid_hz", "spectral_spread_hz",
    "rms_frequency_hz", "spectral_entropy", "total_spectral_power",
)

#: Samples worked on at once inside a batch, so long signals do not multiply in memory.
CHUNK_SAMPLES = 1 << 21

Band = tuple[str, float, float]


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def valid_signal(x: Column) -> Column:
    """At least two samples, all finite."""
    return F.coalesce((F.size(x) >= 2) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def moments(x: Column) -> Column:
    """One scan for the sums, one for the centred powers: struct of the ingredients of every time feature."""
    sums = F.aggregate(
        x,
        F.struct(*[F.lit(0.0).alias(c) for c in ("s1", "s2", "sa", "sr", "top")]),
        lambda a, v: F.struct(
            (a["s1"] + v).alias("s1"),
            (a["s2"] + v * v).alias("s2"),
            (a["sa"] + F.abs(v)).alias("sa"),
            (a["sr"] + F.sqrt(F.abs(v))).alias("sr"),
            F.greatest(a["top"], F.abs(v)).alias("top"),
        ),
    )
    return sums


def centred(x: Column, mean: Column) -> Column:
    return F.aggregate(
        x,
        F.struct(*[F.lit(0.0).alias(c) for c in ("m2", "m3", "m4")]),
        lambda a, v: F.struct(
            (a["m2"] + F.pow(v - mean, 2)).alias("m2"),
            (a["m3"] + F.pow(v - mean, 3)).alias("m3"),
            (a["m4"] + F.pow(v - mean, 4)).alias("m4"),
        ),
    )


def time_feature_columns(x: str, n: Column, s: str, c: str) -> dict[str, Column]:
    """The fifteen statistics from the columns prepared by `moments` (`s`) and `centred` (`c`)."""
    a, b = F.col(s), F.col(c)
    rms, mean_abs, mean_root = F.sqrt(a["s2"] / n), a["sa"] / n, a["sr"] / n
    low, high = F.array_min(x), F.array_max(x)
    # a constant signal has no spread, whatever its mean's rounding leaves; its shape statistics are undefined
    variance = F.when(low == high, 0.0).otherwise(b["m2"] / n)
    return {
        "mean": a["s1"] / n,
        "std": F.sqrt(variance),
        "variance": variance,
        "rms": rms,
        "minimum": low,
        "maximum": high,
        "max_abs": a["top"],
        "peak_to_peak": high - low,
        "skewness": F.try_divide(b["m3"] / n, F.pow(variance, 1.5)),
        "kurtosis": F.try_divide(b["m4"] / n, variance * variance),
        "energy": a["s2"],
        "crest_factor": F.try_divide(a["top"], rms),
        "shape_factor": F.try_divide(rms, mean_abs),
        "impulse_factor": F.try_divide(a["top"], mean_abs),
        "clearance_factor": F.try_divide(a["top"], mean_root * mean_root),
    }


@lru_cache(maxsize=16)
def _window(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def welch_rows(x: np.ndarray, fs: float, nperseg: int, overlap: int) -> np.ndarray:
    """One-sided Welch density of equally long rows: periodic Hann, constant detrend, mean over segments."""
    size = min(nperseg, x.shape[1])
    step = size - min(overlap, size - 1)
    pieces = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::step]
    w = _window(size)
    power = np.abs(np.fft.rfft((pieces - pieces.mean(axis=2, keepdims=True)) * w, axis=2)) ** 2 / (fs * np.sum(w * w))
    power[..., 1 : -1 if size % 2 == 0 else None] *= 2
    return power.mean(axis=1)


def _by_length(signals: pd.Series):
    """Positions and stacked DOUBLE rows for every distinct usable signal length of the batch."""
    sizes = signals.map(lambda s: -1 if s is None else len(s)).to_numpy()
    for size in np.unique(sizes[sizes >= 2]):
        every = np.flatnonzero(sizes == size)
        step = max(1, CHUNK_SAMPLES // int(size))
        for spots in (every[k : k + step] for k in range(0, len(every), step)):
            rows = np.stack([signals.iloc[i] for i in spots]).astype(np.float64)
            good = np.isfinite(rows).all(axis=1)
            if good.any():
                yield spots[good], rows[good]


def welch_psd(signal: Column, fs: float, nperseg: int, overlap: int) -> Column:
    """ARRAY<DOUBLE> spectrum of each signal; NULL where the signal is too short or not finite."""

    @F.pandas_udf("array<double>")
    def psd(batch: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(batch)
        for spots, rows in _by_length(batch):
            for i, row in zip(spots, welch_rows(rows, fs, nperseg, overlap)):
                out[i] = row
        return pd.Series(out)

    return psd(signal)


def psd_frequencies(psd: Column, fs: float, nperseg: Column | int) -> Column:
    """Frequencies k * fs / segment of a spectrum."""
    return F.transform(F.sequence(F.lit(0), F.size(psd) - 1), lambda k: k * F.lit(float(fs)) / nperseg)


def trapezoid(f: Column, p: Column) -> Column:
    """Integral of p over f, 0 for fewer than two points."""
    parts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))),
        lambda i: F.when(F.size(p) >= 2, (F.get(p, i) + F.get(p, i - 1)) * (F.get(f, i) - F.get(f, i - 1)) / 2).otherwise(0.0),
    )
    return array_sum(parts)


def band_power(f: Column, p: Column, low: float, high: float) -> Column:
    pairs = F.filter(F.arrays_zip(f.alias("f"), p.alias("p")), lambda z: (z["f"] >= low) & (z["f"] <= high))
    return trapezoid(F.transform(pairs, lambda z: z["f"]), F.transform(pairs, lambda z: z["p"]))


def spectral_feature_columns(f: str, p: str, bands: Sequence[Band], fs: float) -> dict[str, Column]:
    """Spectral statistics of the columns `f` (frequencies) and `p` (density)."""
    for name, _, high in bands:
        if high > fs / 2:
            raise ValueError(f"band {name} ends above the Nyquist frequency")
    freq, dens = F.col(f), F.col(p)
    total = array_sum(dens)
    share = F.transform(dens, lambda v: F.try_divide(v, total))
    centroid = F.when(total > 0, array_sum(F.zip_with(freq, share, lambda a, b: a * b)))
    second = F.when(total > 0, array_sum(F.zip_with(freq, share, lambda a, b: a * a * b)))
    spread = F.when(total > 0, F.sqrt(array_sum(F.zip_with(freq, share, lambda a, b: F.pow(a - centroid, 2) * b))))
    entropy = F.when(total > 0, -array_sum(F.transform(F.filter(share, lambda v: v > 0), lambda v: v * F.ln(v))) / F.ln(F.size(dens)))
    peak = F.array_max(dens)
    return {
        "dominant_frequency_hz": F.get(freq, F.array_position(dens, peak).cast("int") - 1),
        "dominant_spectral_power": peak,
        "spectral_centroid_hz": centroid,
        "spectral_spread_hz": spread,
        "rms_frequency_hz": F.sqrt(second),
        "spectral_entropy": entropy,
        "total_spectral_power": trapezoid(freq, dens),
        **{f"band_power_{name}": band_power(freq, dens, low, high) for name, low, high in bands},
    }


def feature_names(bands: Sequence[Band]) -> list[str]:
    return [*TIME_FEATURES, *SPECTRAL_FEATURES, *[f"band_power_{b[0]}" for b in bands]]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)


def feature_block(x: np.ndarray, fs: float, nperseg: int, overlap: int, bands: Sequence[Band]) -> np.ndarray:
    """All features of equally long rows, in the order of `feature_names`; NaN marks undefined."""
    size = np.abs(x)
    centre = x - x.mean(axis=1, keepdims=True)
    square = centre * centre
    variance = square.mean(axis=1)
    energy = np.einsum("ij,ij->i", x, x)
    rms, mean_abs, top = np.sqrt(energy / x.shape[1]), size.mean(axis=1), size.max(axis=1)
    low, high = x.min(axis=1), x.max(axis=1)
    flat = high == low
    skew = np.where(flat, np.nan, _ratio((square * centre).mean(axis=1), variance**1.5))
    kurt = np.where(flat, np.nan, _ratio((square * square).mean(axis=1), variance**2))
    columns = [
        x.mean(axis=1), np.sqrt(variance), variance, rms, low, high, top, high - low, skew, kurt, energy,
        _ratio(top, rms), _ratio(rms, mean_abs), _ratio(top, mean_abs), _ratio(top, np.sqrt(size).mean(axis=1) ** 2),
    ]
    p = welch_rows(x, fs, nperseg, overlap)
    f = np.arange(p.shape[1]) * fs / min(nperseg, x.shape[1])
    total = p.sum(axis=1)
    share = np.divide(p, total[:, None], out=np.full(p.shape, np.nan), where=total[:, None] > 0)
    centroid = share @ f
    logs = np.log(share, out=np.zeros(share.shape), where=share > 0)
    columns += [
        f[p.argmax(axis=1)], p.max(axis=1), centroid,
        np.sqrt(np.einsum("ij,ij->i", (f[None, :] - centroid[:, None]) ** 2, share)),
        np.sqrt(share @ (f * f)), -(share * logs).sum(axis=1) / np.log(p.shape[1]), np.trapezoid(p, f, axis=1),
    ]
    for _, low_hz, high_hz in bands:
        inside = (f >= low_hz) & (f <= high_hz)
        columns.append(np.trapezoid(p[:, inside], f[inside], axis=1) if inside.sum() >= 2 else np.zeros(len(x)))
    return np.column_stack(columns)


def channel_features(signal: Column, fs: float, nperseg: int, overlap: int, bands: Sequence[Band] = ()) -> Column:
    """Every time and spectral feature of a channel in one numpy pass, as a STRUCT of DOUBLEs."""
    for name, _, high in bands:
        if high > fs / 2:
            raise ValueError(f"band {name} ends above the Nyquist frequency")
    names = feature_names(bands)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def features(batch: pd.Series) -> pd.DataFrame:
        out = np.full((len(batch), len(names)), np.nan)
        for spots, rows in _by_length(batch):
            out[spots] = feature_block(rows, fs, nperseg, overlap, bands)
        return pd.DataFrame(out, columns=names)

    return features(signal)


def binned_distribution(signal: Column, upper: Column, fs: float, nperseg: int, overlap: int, bins: int, epsilon: float = 1e-12) -> Column:
    """Probability vector of Welch power in equal bins on [0, upper]; the last bin is closed.

    `upper` may differ per row: a shaft frequency times an order gives bins in shaft orders.
    """

    @F.pandas_udf("array<float>")
    def distribution(batch: pd.Series, top: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(batch)
        tops = top.to_numpy(dtype=float)
        for spots, rows in _by_length(batch):
            power = welch_rows(rows, fs, nperseg, overlap)
            f = np.arange(power.shape[1]) * fs / min(nperseg, rows.shape[1])
            for i, p in zip(spots, power):
                edges = np.linspace(0.0, tops[i], bins + 1)
                home = np.searchsorted(edges, f, side="right") - 1
                home[f == edges[-1]] = bins - 1
                # only neighbours inside the same bin span an interval of it
                same = (home[1:] == home[:-1]) & (home[1:] < bins)
                area = (p[1:] + p[:-1]) * np.diff(f) / 2
                mass = np.bincount(home[1:][same], weights=area[same], minlength=bins) + epsilon
                out[i] = (mass / mass.sum()).astype(np.float32)
        return pd.Series(out)

    return distribution(signal, upper)


def valid_distribution(p: Column, tolerance: float = 1e-6) -> Column:
    """Non-negative, finite and summing to one."""
    wide = F.transform(p, lambda v: v.cast("double"))
    bad = F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")))
    return F.coalesce(~bad & (F.abs(array_sum(wide) - 1) <= tolerance), F.lit(False))


def kl_divergence(p: Column, q: Column, epsilon: float = 1e-12, symmetric: bool = False) -> Column:
    """Kullback-Leibler divergence of two probability arrays after flooring and renormalising."""

    def floored(x: Column) -> Column:
        return F.transform(x, lambda v: F.greatest(v.cast("double"), F.lit(epsilon)))

    a, b = floored(p), floored(q)
    ratio = array_sum(b) / array_sum(a)  # normalising constants leave the logarithm as one factor
    forward = array_sum(F.zip_with(a, b, lambda u, v: u * F.ln(u / v * ratio))) / array_sum(a)
    if not symmetric:
        return forward
    backward = array_sum(F.zip_with(a, b, lambda u, v: v * F.ln(v / u / ratio))) / array_sum(b)
    return (forward + backward) / 2


