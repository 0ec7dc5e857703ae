"""Per-acquisition feature tables and spectral references built from signal arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions import signal as sg
from wearline.operators.scale import percentiles


def time_features(df: DataFrame, signal: str) -> DataFrame:
    """Add the time-domain statistics of one signal column; an unusable signal gives NULLs."""
    wide = F.when(sg.valid_signal(F.col(signal)), F.transform(signal, lambda v: v.cast("double")))
    staged = df.withColumn("_x", wide).withColumn("_s", sg.moments(F.col("_x")))
    n = F.size("_x")
    staged = staged.withColumn("_c", sg.centred(F.col("_x"), F.col("_s.s1") / n))
    return staged.select(*df.columns, *[c.alias(k) for k, c in sg.time_feature_columns("_x", n, "_s", "_c").items()])


def invalid_signals(df: DataFrame, keys: Sequence[str], signal: str) -> DataFrame:
    """Rows whose signal is missing, shorter than two samples or not finite."""
    return df.where(~sg.valid_signal(F.col(signal))).select(*keys, F.lit("invalid_signal").alias("code"))


def spectral_features(df: DataFrame, signal: str, fs: float, nperseg: int, overlap: int, bands: Sequence[sg.Band] = ()) -> DataFrame:
    """Add the Welch spectrum statistics of one signal column."""
    staged = df.withColumn("_p", sg.welch_psd(F.col(signal), fs, nperseg, overlap)).withColumn(
        "_f", sg.psd_frequencies(F.col("_p"), fs, F.least(F.lit(nperseg), F.size(signal)))
    )
    return staged.select(*df.columns, *[c.alias(k) for k, c in sg.spectral_feature_columns("_f", "_p", bands, fs).items()])


def feature_rows(
    df: DataFrame, passthrough: Sequence[str], channels: Sequence[str], fs: float, nperseg: int, overlap: int, bands: Sequence[sg.Band] = ()
) -> DataFrame:
    """The wide feature table: one narrow projection, `<channel>_<feature>` columns, NULL for undefined."""
    staged = df.select(*passthrough, *[sg.channel_features(F.col(c), fs, nperseg, overlap, bands).alias(f"_{c}") for c in channels])
    return staged.select(
        *passthrough,
        *[F.nanvl(F.col(f"_{c}.{n}"), F.lit(None).cast("double")).alias(f"{c}_{n}") for c in channels for n in sg.feature_names(bands)],
    )


def reference_distribution(df: DataFrame, unit: Sequence[str], vector: str, baseline: int, name: str = "reference") -> DataFrame:
    """Element-wise median of a unit's first `baseline` vectors, renormalised."""
    early = df.where(F.col("sequence_index") < baseline).select(*unit, F.posexplode(vector).alias("bin", "mass"))
    middle = percentiles(early, [*unit, "bin"], {"mass": (F.col("mass").cast("double"), 0.5)})
    # one element per bin, so the collected array has the vector's fixed length
    gathered = middle.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("bin", "mass"))).alias("_v"))
    masses = F.transform("_v", lambda z: z["mass"])
    return gathered.select(*unit, F.transform(masses, lambda m: (m / sg.array_sum(masses)).cast("float")).alias(name))
