"""Name/value snapshots to wide samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.catalog import REPLICATION, SKIPPED_NAMES, SKIPPED_PREFIXES, MetricCatalog

# Words that stand for numbers.
WORDS = {"off": 0, "on": 1, "demand": 2, "no": 0, "yes": 1, "not started": 0, "started": 1}
WORDS_BY_NAME = {
    "concurrent_insert": {"never": 0, "auto": 1, "always": 2},
    "delay_key_write": {"all": 2},
}

SNAPSHOT_KEYS = ("host", "snapshot_id", "ts")


def clean_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def is_skipped(name: Column) -> Column:
    skipped = name.isin(*SKIPPED_NAMES)
    for prefix in SKIPPED_PREFIXES:
        skipped = skipped | name.startswith(prefix)
    return skipped


def wanted(raw: DataFrame, cat: MetricCatalog) -> DataFrame:
    """Normalised names; status rows not on the skip list and variables the catalogue declares."""
    rows = raw.withColumn("name", clean_name(F.col("name")))
    keep_status = (F.col("kind") == "status") & ~is_skipped(F.col("name"))
    keep_variable = (F.col("kind") == "variables") & F.col("name").isin(*cat.params)
    return rows.where(keep_status | keep_variable)


def _words(words: Mapping[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def normalize_value(name: Column, value: Column, kind: str = "decimal(20,0)") -> Column:
    """Text to number: on/off words first, then digits; an empty or unknown text is NULL.

    A text with decimals is rounded half away from zero, as in ``10.000000``.

    ``concurrent_insert`` has its own words (never, auto, always) and they are honoured here.
    """
    word = F.lower(value)
    special = F.lit(None).cast("int")
    for owner, words in WORDS_BY_NAME.items():
        special = F.when(name == owner, F.try_element_at(_words(words), word)).otherwise(special)
    spoken = F.coalesce(special, F.try_element_at(_words(WORDS), word))
    whole = word.try_cast(kind) if kind == "long" else F.lit(None).cast(kind)  # the usual case, without decimals
    return F.coalesce(spoken.cast(kind), whole, F.round(word.try_cast("decimal(38,6)"), 0).try_cast(kind))


def pivot(rows: DataFrame, names: Sequence[str], cat: MetricCatalog, types: Mapping[str, str] | None = None) -> DataFrame:
    """One wide row per snapshot. The name list is given (see ``observed``), so the pivot is one partial aggregation.

    ``types`` overrides the declared types of names.
    """
    kind = {n: (types or {}).get(n) or cat.type_of(n) for n in names}
    name, value = F.col("name"), F.col("value")
    # Whole numbers of 64 bits are read as such; only the few wide metrics pay for decimals.
    wide = [n for n in names if kind[n] != "long"]
    number = {"long": normalize_value(name, value, "long").alias("_long")}
    if wide:
        number["long"] = F.when(~name.isin(*wide), normalize_value(name, value, "long")).alias("_long")
        number["decimal(20,0)"] = F.when(name.isin(*wide), normalize_value(name, value)).alias("_decimal")
    source = {"long": "_long", "decimal(20,0)": "_decimal"}
    valued = rows.where(name.isin(*names)).select(*SNAPSHOT_KEYS, "name", *number.values())
    picked = [F.max(F.when(F.col("name") == n, F.col(source[kind[n]]))).alias(n) for n in names]
    return valued.groupBy(*SNAPSHOT_KEYS).agg(*picked)


OBSERVED_LIMIT = 4096


def observed(rows: DataFrame, cat: MetricCatalog, limit: int = OBSERVED_LIMIT) -> dict[str, str]:
    """The names that occur in normalised rows, with the type of their column, in order of the name.

    The first of two passes: names are aggregated before they move, and the driver gets one row for each. More than
    ``limit`` of them are an error, not cut off. A listed gauge is signed. Any other metric is unsigned: it is a long
    until a value beyond 2^63 - 1 is seen, then it has twenty digits.
    """
    value = F.col("value")
    # Without an exponent a number beyond 2^63 - 1 has nineteen digits; other texts need not be read.
    may_be = (F.length(value) >= 19) | F.contains(F.lower(value), F.lit("e"))
    large = F.when(may_be, normalize_value(F.col("name"), value) > F.lit((1 << 63) - 1).cast("decimal(20,0)"))
    seen = rows.groupBy("name").agg(F.coalesce(F.bool_or(large), F.lit(False)).alias("wide")).orderBy("name").limit(limit + 1).collect()
    if len(seen) > limit:
        raise ValueError(f"more than {limit} names of variables")
    wide = "decimal(20,0)"
    return {r["name"]: wide if r["wide"] and not cat.is_gauge(r["name"]) else cat.type_of(r["name"]) for r in seen}


def fill_expected(samples: DataFrame, expected: Sequence[str], cat: MetricCatalog) -> DataFrame:
    """Add the expected metrics that were not measured, as NULL."""
    missing = [c for c in expected if c not in samples.columns]
    return samples.withColumns({c: F.lit(None).cast(cat.type_of(c)) for c in missing}) if missing else samples


def snapshot_to_samples(raw: DataFrame, cat: MetricCatalog, names: Sequence[str] | None = None,
                        expected: Sequence[str] | None = None) -> DataFrame:
    """Raw status and variable rows to samples numbered by their snapshot.

    Without ``names`` every status variable and declared parameter that the rows hold becomes a column, whether the
    catalogue knows it or not; the rows are then read twice.
    """
    rows = wanted(raw, cat)
    types = observed(rows, cat) if names is None else {}
    wide = pivot(rows, list(types) if names is None else names, cat, types)
    filled = fill_expected(wide, cat.expected_columns() if expected is None else expected, cat)
    return filled.withColumnRenamed("snapshot_id", "id")


def binlog_number(file_name: Column) -> Column:
    """Last dot-separated token of a log file name, as a number."""
    return F.element_at(F.split(file_name, "\\."), -1).try_cast("int")


def replication_fields(raw: DataFrame) -> DataFrame:
    """Master position and file number and the replica fields, one row per snapshot."""
    name, value = clean_name(F.col("name")), F.col("value")
    of_master, of_slave = F.col("kind") == "master", F.col("kind") == "slave"

    def picked(when: Column, what: Column, alias: str) -> Column:
        return F.max(F.when(when, what)).alias(alias)

    fields = [
        picked(of_master & (name == "position"), value.try_cast("long"), "master_status_position"),
        picked(of_master & (name == "file"), binlog_number(value).cast("long"), "master_status_file_number"),
    ]
    fields += [picked(of_slave & (name == f), value.try_cast("long"), f) for f in REPLICATION[2:]]
    return raw.where(of_master | of_slave).groupBy(*SNAPSHOT_KEYS).agg(*fields)


def with_replication(samples: DataFrame, replication: DataFrame) -> DataFrame:
    """Samples with the replication fields of the same snapshot, NULL where there are none."""
    facts = replication.withColumnRenamed("snapshot_id", "id").drop("ts")
    base = samples.drop(*[c for c in REPLICATION if c in samples.columns])
    return base.join(facts, ["host", "id"], "left")
