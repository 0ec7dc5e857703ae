"""Data-quality operators: inventory checks, manifest invariants, staged duplicate search, issue tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.operators.scale import any_of, running, trailing, with_totals
from wearline.session import cut

ERROR, WARNING = "error", "warning"

#: Boundary digest layout. Fixed values.
BOUNDARY_CHARS = 65_536
BOUNDARY_TAG = "|tail|"

Rule = tuple[str, str, Column]  # (code, severity, condition that marks a violation)


def row_issues(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], details: Mapping[str, Column] | None = None) -> DataFrame:
    """One issue row per violated rule per row, in one pass over `df`."""
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, bad in rules])
    )
    packed = F.create_map(*[x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]) if details else F.create_map().cast("map<string,string>")
    return (
        df.select(*keys, packed.alias("details"), F.explode(found).alias("_i"))
        .select(*keys, "_i.code", "_i.severity", "details")
    )


def expect(df: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """Violation counts per rule, optionally per group: one aggregation, one row per broken rule."""
    counted = df.groupBy(*by).agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(f"_{i}") for i, (_, _, bad) in enumerate(rules)])
    listed = F.array(
        *[F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col(f"_{i}").alias("violations")) for i, (code, sev, _) in enumerate(rules)]
    )
    return counted.select(*by, F.inline(listed)).where("violations > 0")


def coverage_issues(have: DataFrame, want: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys missing from `have`, unexpected in `have`, or present more than once."""
    held = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = want.select(*keys).distinct().withColumn("_wanted", F.lit(True))
    code = (
        F.when(F.col("_n").isNull(), "missing_key")
        .when(F.col("_wanted").isNull(), "unexpected_key")
        .when(F.col("_n") > 1, "duplicate_key")
    )
    return held.join(wanted, list(keys), "full_outer").select(*keys, code.alias("code"), F.coalesce("_n", F.lit(0)).alias("observed")).where("code IS NOT NULL")


def unexpected(inventory: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return inventory.join(expected.select(*keys).distinct(), list(keys), "left_anti")


def missing(inventory: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(inventory.select(*keys).distinct(), list(keys), "left_anti")


def duplicate_numbers(inventory: DataFrame, unit: Sequence[str], number: str) -> DataFrame:
    """Numbers that occur more than once in a unit, with their count."""
    return inventory.groupBy(*unit, number).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def drop_duplicate_numbers(inventory: DataFrame, unit: Sequence[str], number: str) -> DataFrame:
    """Rows whose number is unique in the unit; every copy of a repeated number is dropped."""
    return inventory.join(duplicate_numbers(inventory, unit, number), [*unit, number], "left_anti")


def number_gaps(inventory: DataFrame, unit: Sequence[str], number: str, cap: int | None = None, split: bool | None = None) -> DataFrame:
    """Numbers missing between observed ones: their count and a listing, of all or of the first `cap` of them."""
    seen = inventory.select(*unit, number).distinct()
    placed = running(seen, unit, [number], {"_nth": ("sum", F.lit(1).cast("bigint"))}, split).withColumn("sequence_index", F.col("_nth") - 1)
    stepped = trailing(placed, unit, 1, {"_before": lambda w: F.lag(number).over(w)}).where(F.col(number) - F.col("_before") > 1)
    # earlier missing numbers of the unit = numbers skipped before this gap
    gaps = stepped.select(
        *unit,
        (F.col("_before") + 1).cast("bigint").alias("_from"),
        (F.col(number) - 1).cast("bigint").alias("_to"),
    )
    counted = running(gaps, unit, ["_from"], {"_upto": ("sum", F.col("_to") - F.col("_from") + 1)}, split)
    listed = F.sequence("_from", "_to")
    if cap is not None:
        first = F.lit(cap) - (F.col("_upto") - (F.col("_to") - F.col("_from") + 1))
        listed = F.when(first > 0, F.sequence("_from", F.least(F.col("_to"), F.col("_from") + first - 1)))
    return (
        counted.withColumn("_list", listed)
        .groupBy(*unit)
        .agg(
            F.sum(F.col("_to") - F.col("_from") + 1).alias("missing_count"),
            F.sort_array(F.flatten(F.collect_list("_list"))).alias("missing_numbers"),
        )
    )


def wrong_start(inventory: DataFrame, unit: Sequence[str], number: str, start: int = 1) -> DataFrame:
    return inventory.groupBy(*unit).agg(F.min(number).alias("first_number")).where(F.col("first_number") != start)


def count_mismatch(inventory: DataFrame, expected: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Units whose observed count differs from `expected.expected_count`; an absent unit counts 0."""
    seen = inventory.groupBy(*unit).agg(F.count(F.lit(1)).alias("observed_count"))
    return (
        expected.join(seen, list(unit), "left")
        .fillna(0, ["observed_count"])
        .where("observed_count <> expected_count")
        .select(*unit, "observed_count", "expected_count")
    )


def drop_aliases(inventory: DataFrame, target: str) -> DataFrame:
    """Remove every row whose resolved target is reached more than once."""
    repeated = inventory.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return inventory.join(repeated, target, "left_anti")


def inspection_rules(names: Sequence[str], samples: int) -> list[Rule]:
    """Per-file rules; the inspection columns are NULL where the file was never inspected."""
    seen = F.col("inspected")
    clean = seen & F.col("parse_error").isNull()
    return [
        ("inspection_missing", ERROR, ~seen),
        ("parse_error", ERROR, seen & F.col("parse_error").isNotNull()),
        ("wrong_channel_names", ERROR, clean & (F.col("header") != F.array(*[F.lit(n) for n in names]))),
        ("wrong_channel_count", ERROR, clean & (F.col("channel_count") != len(names))),
        ("wrong_sample_count", ERROR, clean & (F.col("sample_count") != samples)),
        ("nan_samples", ERROR, clean & (F.col("nan_count") > 0)),
        ("infinite_samples", ERROR, clean & (F.col("infinite_count") > 0)),
    ]


def inspection_issues(acquisitions: DataFrame, inspections: DataFrame, rules: Sequence[Rule], key: str = "file_path") -> DataFrame:
    joined = acquisitions.join(inspections.withColumn("inspected", F.lit(True)), key, "left").fillna(False, ["inspected"])
    return row_issues(joined, [key], rules)


def drift_issues(before: DataFrame, now: DataFrame, key: str, watched: Sequence[str]) -> DataFrame:
    """Entries whose watched attributes changed, appeared or vanished between two inventories."""
    a = before.select(key, *[F.col(c).alias(f"_a_{c}") for c in watched], F.lit(True).alias("_a"))
    b = now.select(key, *[F.col(c).alias(f"_b_{c}") for c in watched], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    code = F.when(F.col("_b").isNull(), "vanished").when(F.col("_a").isNull(), "appeared").when(
        any_of([~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in watched]), "changed"
    )
    return both.select(key, code.alias("code")).where("code IS NOT NULL")


def manifest_issues(manifest: DataFrame, unit: Sequence[str], interval: float, tolerance: float = 1e-12, split: bool | None = None) -> DataFrame:
    """Invariant violations of a manifest, counted per unit and code."""
    chron = running(manifest, unit, ["sequence_index", "acquisition_number", "file_path"], {"_nth": ("sum", F.lit(1).cast("bigint"))}, split)
    sized = with_totals(
        chron.withColumn("_row", F.col("_nth") - 1),
        unit,
        {"_size": F.count(F.lit(1)), "_last": F.max("sequence_index")},
        split,
    )
    home = sized.withColumns({"_kept_index": F.col("sequence_index"), "sequence_index": F.col("_row")})
    lagged = trailing(home, unit, 1, {"_number_before": lambda w: F.lag("acquisition_number").over(w)}).withColumn("sequence_index", F.col("_kept_index"))
    index, rul = F.col("sequence_index"), F.col("rul_minutes")

    def off(value: Column, target: Column) -> Column:
        return F.abs(value - target) > tolerance

    rules = [
        ("sequence_not_contiguous", ERROR, index != F.col("_row")),
        ("number_not_increasing", ERROR, F.coalesce(F.col("acquisition_number") <= F.col("_number_before"), F.lit(False))),
        ("elapsed_mismatch", ERROR, off(F.col("elapsed_minutes"), index * F.lit(interval))),
        ("rul_mismatch", ERROR, off(rul, (F.col("total_acquisitions") - 1 - index) * F.lit(interval))),
        ("rul_negative_or_not_finite", ERROR, rul.isNull() | F.isnan(rul) | (rul < 0) | (rul == float("inf"))),
        ("final_rul_not_zero", ERROR, (F.col("_row") == F.col("_size") - 1) & off(rul, F.lit(0.0))),
        ("total_mismatch", ERROR, F.col("total_acquisitions") != F.col("_size")),
    ]
    paths = (
        manifest.groupBy(*unit, "file_path")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .groupBy(*unit)
        .agg(F.sum("_n").alias("violations"))
        .select(*unit, F.lit("path_not_unique").alias("code"), F.lit(ERROR).alias("severity"), "violations")
    )
    return expect(lagged, rules, unit).unionByName(paths)


#: Bits of the filters that a later scan applies; what reaches the driver is never larger.
FILTER_BITS = 20


def _marks(values: DataFrame) -> bytearray:
    """A filter with a bit for every value (a column of non-negative longs) modulo its size; tasks merge their bits first."""
    place = F.col(values.columns[0]) % (1 << FILTER_BITS) + 1
    marks = bytearray((1 << FILTER_BITS) // 8)
    for row in values.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        at = (row["part"] - 1) * len(row["bits"])
        marks[at : at + len(row["bits"])] = row["bits"]
    return marks


def _marked(marks: bytearray, value: Column) -> Column:
    """Whether a filter may hold a value; false alarms only."""
    place = value % (1 << FILTER_BITS)
    byte = F.conv(F.hex(F.substring(F.lit(marks), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.expr("1") == (F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)))


def duplicate_stages(content: DataFrame, key: str, body: str, size: str | None = None) -> dict[str, DataFrame]:
    """Exact duplicates in three scans, each of which only hashes what the one before it left.

    1. Sizes are counted; sizes that repeat become a filter. 2. Rows that pass it get a digest of their two ends; digests that repeat become a
    second filter. 3. Only rows that pass both are hashed in full. Filters are bitmaps of `FILTER_BITS`, so contents never enter an exchange;
    an exact semi-join of the small digest rows follows each. Returns the tables ``sized``, ``boundary`` and ``full``, and ``hashed``, the rows
    whose whole body was hashed. Digest and row stay in long form: a group of copies may be any size, so its members are never gathered.
    """

    def repeated(df: DataFrame, column: str) -> DataFrame:
        return df.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(column), column, "left_semi")

    measured = content.select(key, body, (F.col(size) if size else F.octet_length(body)).cast("bigint").alias("size_bytes"))
    shared = cut(measured.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND size_bytes IS NOT NULL").select("size_bytes"))
    edges = F.concat(
        F.col("size_bytes").cast("string"),
        F.substring(body, 1, BOUNDARY_CHARS),
        F.lit(BOUNDARY_TAG),
        F.expr(f"right({body}, {BOUNDARY_CHARS})"),
    )
    candidates = measured.where(_marked(_marks(shared), F.col("size_bytes"))).withColumn("boundary_digest", F.sha2(edges, 256))
    sized = cut(candidates.select(key, "size_bytes", "boundary_digest").join(shared, "size_bytes", "left_semi"))
    ends = cut(sized.groupBy("boundary_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("boundary_digest"))
    number = lambda c: F.conv(F.substring(c, 1, 12), 16, 10).cast("bigint")
    met = candidates.where(_marked(_marks(ends.select(number("boundary_digest").alias("number"))), number("boundary_digest")))
    hashed = cut(met.select(key, "size_bytes", "boundary_digest", F.sha2(F.col(body), 256).alias("digest")).join(ends, "boundary_digest", "left_semi"))
    return {"sized": sized, "boundary": repeated(sized, "boundary_digest"), "hashed": hashed, "full": repeated(hashed.select(key, "size_bytes", "digest"), "digest")}


def duplicate_content(content: DataFrame, key: str, body: str) -> DataFrame:
    """One row per copy: the group digest, its size in bytes, its number of copies and the row's key."""
    full = duplicate_stages(content, key, body)["full"].select("digest", "size_bytes", key)
    return full.join(full.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "digest")


def duplicate_counters(content: DataFrame, key: str, body: str) -> DataFrame:
    """How many sizes repeat, how many rows had their ends and their whole body hashed, and what was found, in one row."""
    stages = duplicate_stages(content, key, body)
    counted = [
        stages["sized"].agg(F.countDistinct("size_bytes").alias("size_groups"), F.count(F.lit(1)).alias("boundary_hashed")),
        stages["hashed"].agg(F.count(F.lit(1)).alias("fully_hashed")),
        stages["full"].agg(F.countDistinct("digest").alias("duplicate_groups"), F.count(F.lit(1)).alias("duplicate_rows")),
    ]
    merged = counted[0].unionByName(counted[1], allowMissingColumns=True).unionByName(counted[2], allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def ordered_issues(issues: DataFrame) -> DataFrame:
    """Severity-first order: errors before warnings before the rest, then path and code."""
    rank = F.when(F.col("severity") == ERROR, 0).when(F.col("severity") == WARNING, 1).otherwise(2)
    return issues.withColumn("severity_rank", rank).orderBy("severity_rank", "path", "code")


def issue_status(issues: DataFrame) -> DataFrame:
    counted = issues.agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings")
    )
    return counted.withColumn("status", F.when(F.col("errors") == 0, "passed").otherwise("failed"))


def schema_issues(df: DataFrame, required: Mapping[str, str]) -> list[tuple[str, str]]:
    """Missing or wrongly typed columns, from the schema alone."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = [("missing_column", c) for c in required if c not in types]
    return found + [("wrong_type", c) for c, t in required.items() if c in types and types[c] != t]


def not_finite(column: str) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def feature_table_rules(df: DataFrame, nyquist: Column | None = None) -> list[Rule]:
    """Range rules derived from feature names: signs, entropy and frequency ranges, finiteness."""
    #: Name endings whose values cannot be negative. Fixed values.
    nonnegative = ("energy", "power", "rms", "std", "variance", "spread_hz")
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name.startswith(("horizontal", "vertical"))]
    rules: list[Rule] = [(f"not_finite:{c}", ERROR, not_finite(c)) for c in numeric]
    rules += [(f"negative:{c}", ERROR, F.coalesce(F.col(c) < 0, F.lit(False))) for c in numeric if c.endswith(nonnegative) or "band_power" in c]
    rules += [(f"entropy_range:{c}", ERROR, F.coalesce((F.col(c) < 0) | (F.col(c) > 1 + 1e-12), F.lit(False))) for c in numeric if c.endswith("spectral_entropy")]
    if nyquist is not None:
        rules += [(f"frequency_range:{c}", ERROR, F.coalesce((F.col(c) < 0) | (F.col(c) > nyquist), F.lit(False))) for c in numeric if c.endswith("_hz")]
    if "rul_minutes" in df.columns:
        rules.append(("rul_negative", ERROR, F.col("rul_minutes") < 0))
    return rules
