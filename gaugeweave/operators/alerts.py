"""Alert conditions, events, episodes and the pending life cycle."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeweave.catalog import ERROR_LEVELS
from gaugeweave.functions.numeric import div
from gaugeweave.functions.text import joined
from gaugeweave.functions.timefn import NTZ, elapsed, stamp
from gaugeweave.operators.delta import BLOCK, block_of
from gaugeweave.operators.ingest import join_host_facts
from gaugeweave.session import materialize, scratch_dir

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Condition:
    """One rule: SQL text over the report row, and one over facts of the monitored host."""

    alert_condition_id: int
    condition_eval: str
    monitored_host_condition_eval: str = ""
    description: str = ""
    error_level: str = "error"
    alert_delay_minutes: int = 0
    repetitive_alert: bool = False
    enabled: bool = True


CONDITION_SCHEMA = (
    "alert_condition_id int, condition_eval string, monitored_host_condition_eval string, description string, "
    "error_level string, alert_delay_minutes int, repetitive_alert boolean, enabled boolean"
)


def conditions_frame(spark, conditions: Iterable[Condition]) -> DataFrame:
    rows = [tuple(getattr(c, f) for f in Condition.__dataclass_fields__) for c in conditions]
    return spark.createDataFrame(rows, CONDITION_SCHEMA)


def read_conditions(frame: DataFrame) -> list[Condition]:
    """The rule table on the driver: its texts become expressions of the plan."""
    return [Condition(**r.asDict()) for r in frame.select(*Condition.__dataclass_fields__).collect()]


def severity(error_level: Column) -> Column:
    """Place of an error level, 1 for the mildest."""
    return F.array_position(F.array(*[F.lit(e) for e in ERROR_LEVELS]), error_level).cast("int")


@contextmanager
def forgiving(spark):
    """Expressions built and resolved inside give NULL for a zero divisor or a text that is no number.

    Rule texts are user input; under the ANSI rules one of them could end the run for all rules and hosts. The
    setting is taken when an expression is resolved, so only what is built here is affected.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _truth(rows: DataFrame, text: str) -> Column:
    """Boolean of a rule text: empty is true, NULL is false, a number is true unless zero."""
    if not text.strip():
        return F.lit(True)
    result = F.expr(text)
    if not isinstance(rows.select(result.alias("x")).schema["x"].dataType, T.BooleanType):
        result = result.cast("double") != 0
    truth = F.coalesce(result, F.lit(False))
    rows.select("host", truth)  # resolved here, beside another column: no aggregate, no generator
    return truth


def rule_columns(spark, text: str) -> list[str]:
    """Names of the columns that a rule text uses, read from its parsed expression, sorted."""
    found, nodes = set(), [spark._jsparkSession.sessionState().sqlParser().parseExpression(text)] if text.strip() else []
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            found.add(node.name().lower())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return sorted(found)


@dataclass(frozen=True)
class RuleInput:
    """What a rule text reads, or why it cannot be computed."""

    alert_condition_id: int
    columns: tuple[str, ...] = ()
    error: str | None = None


def rule_inputs(spark, conditions: Sequence[Condition], known: Sequence[str]) -> list[RuleInput]:
    """For each enabled rule the ``known`` columns it uses; a rule with others or without valid syntax has an error."""
    out = []
    for c in conditions:
        if not c.enabled:
            continue
        try:
            columns = rule_columns(spark, c.condition_eval)
        except Exception as error:  # noqa: BLE001 - whatever the parser raises is the rule's own fault
            first = next((x for x in str(error).splitlines() if "[" in x), str(error).splitlines()[0])
            out.append(RuleInput(c.alert_condition_id, error=first.strip()))
            continue
        strange = [x for x in columns if x not in known]
        error = f"unknown column {', '.join(strange)}" if strange else None
        out.append(RuleInput(c.alert_condition_id, tuple(columns), error))
    return out


# A number of at most nine digits right after a comparison or an arithmetic sign: neither the syntax nor the columns depend on it.
_VALUE = r"(?<=[<>=+*/%-])(\s*)[0-9]{1,9}(?![0-9A-Za-z_.])"
# Quotes, comments, intervals and exponents may make something else of such a number; these texts are parsed as they are.
_SPECIAL = r"""(?is)['"`]|--|/[*]|interval|[0-9.]e[+-]"""
SHAPES = 10_000


def rule_shape(text: Column) -> Column:
    """The text of a rule with the numbers it compares with as 1: rules of one shape read the same columns or fail alike."""
    return F.when(text.rlike(_SPECIAL), text).otherwise(F.regexp_replace(text, _VALUE, "$11"))


def rule_inputs_table(rules: DataFrame, known: Sequence[str]) -> DataFrame:
    """``rule_inputs`` of a whole rule table, as ``(alert_condition_id, columns, error)``.

    Only distinct shapes are parsed, one after the other as they arrive from Spark, which only the driver can do; their
    results are written in parts and joined to the rules. An error quotes the shape.
    """
    spark = rules.sparkSession
    shaped = rules.where("enabled").select("alert_condition_id", rule_shape(F.col("condition_eval")).alias("shape"))
    path = scratch_dir(spark, "rule-shapes")
    schema = "shape string, columns array<string>, error string"
    spark.createDataFrame([], schema).write.parquet(path)
    shapes = (r["shape"] for r in materialize(shaped.select("shape").distinct(), "shapes").toLocalIterator())
    while part := list(islice(shapes, SHAPES)):
        found = rule_inputs(spark, [Condition(i, shape) for i, shape in enumerate(part)], known)
        rows = [(part[r.alert_condition_id], list(r.columns), r.error) for r in found]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    parsed = spark.read.schema(schema).parquet(path)
    return shaped.join(parsed, shaped["shape"].eqNullSafe(parsed["shape"])).select("alert_condition_id", "columns", "error")


def watched_metrics(spark, conditions: Sequence[Condition], known: Sequence[str]) -> list[str]:
    """The report metrics that the computable rules use, in the order of ``known``."""
    used = {x for r in rule_inputs(spark, conditions, known) if r.error is None for x in r.columns}
    return [m for m in known if m in used]


def flag(condition_id: int) -> str:
    return f"fired_{condition_id}"


def _judged(rows: DataFrame, condition: Condition, text: str) -> Column:
    """Truth of one rule; a rule that cannot be resolved is reported and never fires, the others go on."""
    try:
        return _truth(rows, text)
    except PySparkException as error:
        log.warning("rule %d cannot be computed: %s", condition.alert_condition_id, str(error).strip().splitlines()[0])
        return F.lit(False)


def evaluate_wide(report: DataFrame, conditions: Sequence[Condition],
                  host_facts: DataFrame | None = None) -> DataFrame:
    """(host, id, ts, fired_<condition> …): all enabled rules in one projection of the report."""
    rules = [c for c in conditions if c.enabled]
    with forgiving(report.sparkSession):
        fired = {c.alert_condition_id: _judged(report, c, c.condition_eval) for c in rules}
        rows = report.select("host", "id", "ts", *[e.alias(flag(i)) for i, e in fired.items()])
    second = [c for c in rules if c.monitored_host_condition_eval.strip()]
    if not second:
        return rows
    if host_facts is None:
        raise ValueError("rules on the monitored host need host_facts")
    with forgiving(report.sparkSession):
        hosts = host_facts.select(
            "host",
            *[_judged(host_facts, c, c.monitored_host_condition_eval).alias(f"_h{c.alert_condition_id}") for c in second],
        )
    both = join_host_facts(rows, hosts, F.col("id"), how="left")
    checks = {
        flag(c.alert_condition_id): F.col(flag(c.alert_condition_id))
        & F.coalesce(F.col(f"_h{c.alert_condition_id}"), F.lit(False))
        for c in second
    }
    return both.withColumns(checks).drop(*[f"_h{c.alert_condition_id}" for c in second])


def condition_ids(wide: DataFrame) -> list[int]:
    return [int(c.removeprefix("fired_")) for c in wide.columns if c.startswith("fired_")]


def evaluate(report: DataFrame, conditions: Sequence[Condition], host_facts: DataFrame | None = None) -> DataFrame:
    """(host, id, ts, alert_condition_id, fired) for every row and enabled rule."""
    return fired_long(evaluate_wide(report, conditions, host_facts))


def fired_long(wide: DataFrame) -> DataFrame:
    """The wide form as rows (host, id, ts, alert_condition_id, fired)."""
    pairs = [F.struct(F.lit(i).alias("alert_condition_id"), F.col(flag(i)).alias("fired")) for i in condition_ids(wide)]
    return wide.select("host", "id", "ts", F.inline(F.array(*pairs)))


def alert_events(evaluated: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(host, alert_condition_id, sv_report_sample_id), each once; those already stored are left out."""
    keys = ["host", "alert_condition_id", "sv_report_sample_id"]
    events = evaluated.where("fired").withColumnRenamed("id", "sv_report_sample_id").select(*keys).distinct()
    return events if existing is None else events.join(existing.select(*keys), keys, "left_anti")


def block_runs(wide: DataFrame, block: int = BLOCK) -> DataFrame:
    """Unbroken runs of firing samples inside each (host, block of sample numbers), one window for all rules.

    Adds ``_block`` and whether a run opens or closes its block. A block whose first sample is quiet has a mark of its
    own (``_fired`` is false), so every block shows for every rule where runs of its neighbours end.
    """
    ids = condition_ids(wide)
    inside = "PARTITION BY host, _block ORDER BY id"
    rows = wide.withColumn("_block", block_of(F.col("id"), block)).selectExpr(
        "host", "_block", "id", "ts",
        f"lag(id) OVER ({inside}) IS NULL AS _first",
        f"lead(id) OVER ({inside}) IS NULL AS _last",
        *[flag(i) for i in ids],
        *[
            f"sum(CASE WHEN {flag(i)} THEN 0 ELSE 1 END) OVER ({inside} ROWS UNBOUNDED PRECEDING) AS _quiet_{i}"
            for i in ids
        ],
    )
    entries = ", ".join(
        f"struct({i} AS alert_condition_id, {flag(i)} AS _fired, _quiet_{i} AS _quiet)" for i in ids
    )
    fanned = rows.selectExpr("host", "_block", "id", "ts", "_first", "_last", f"inline(array({entries}))")
    return fanned.where("_fired OR _first").groupBy("host", "alert_condition_id", "_block", "_fired", "_quiet").agg(
        F.min("id").alias("start_id"),
        F.max("id").alias("end_id"),
        F.min_by("ts", "id").alias("ts_start"),
        F.max_by("ts", "id").alias("ts_end"),
        F.count_if("_fired").alias("fires"),
        F.bool_or(F.col("_fired") & F.col("_first")).alias("_opens"),
        F.bool_or(F.col("_fired") & F.col("_last")).alias("_closes"),
    ).drop("_quiet")


def at_edge() -> Column:
    """Whether a run (or mark) of ``block_runs`` touches an edge of its block."""
    return F.col("_opens") | F.col("_closes") | ~F.col("_fired")


def chained(runs: DataFrame) -> DataFrame:
    """Episodes of ``block_runs``, with ``closed``: whether a later sample of the host was quiet.

    Only runs at block edges are chained across blocks: three rows at most per block and rule, so no step sees the
    whole history of a host.
    """
    # Inner runs get a group of their own; edge runs and marks of a rule share one and are chained there.
    lane = "CASE WHEN _opens OR _closes OR NOT _fired THEN -1L ELSE start_id END AS _lane"
    chain = "PARTITION BY host, alert_condition_id, _lane ORDER BY start_id"
    linked = runs.selectExpr("*", lane).selectExpr(
        "*", f"CASE WHEN _opens AND coalesce(lag(_closes) OVER ({chain}), false) THEN 0 ELSE 1 END AS _new",
        f"NOT _closes OR lead(start_id) OVER ({chain}) IS NOT NULL AS _ended",
    ).selectExpr("*", f"sum(_new) OVER ({chain} ROWS UNBOUNDED PRECEDING) AS _run")
    return linked.where("_fired").groupBy("host", "alert_condition_id", "_lane", "_run").agg(
        F.min("start_id").alias("start_id"),
        F.max("end_id").alias("end_id"),
        F.min_by("ts_start", "start_id").alias("ts_start"),
        F.max_by("ts_end", "end_id").alias("ts_end"),
        F.sum("fires").alias("fires"),
        F.max_by("_ended", "end_id").alias("closed"),
    ).drop("_lane", "_run")


def episodes(wide: DataFrame, block: int = BLOCK) -> DataFrame:
    """(host, alert_condition_id, start_id, end_id, ts_start, ts_end, fires): unbroken runs of firing samples."""
    return chained(block_runs(wide, block)).drop("closed")


def pending(runs: DataFrame) -> DataFrame:
    """Episodes in the shape of the pending table, not yet notified or resolved."""
    return runs.select(
        "host",
        "alert_condition_id",
        F.col("start_id").alias("sv_report_sample_id_start"),
        F.col("end_id").alias("sv_report_sample_id_end"),
        F.lit(None).cast(NTZ).alias("ts_notified"),
        F.lit(False).alias("resolved"),
    )


def newest_pending(runs: DataFrame) -> DataFrame:
    """The state table after the last evaluation: one row per rule and host, its newest episode."""
    newest = F.max_by(F.struct("start_id", "end_id"), F.col("start_id")).alias("_run")
    rows = runs.groupBy("host", "alert_condition_id").agg(newest)
    return pending(rows.select("host", "alert_condition_id", "_run.*"))


def upsert_pending(current: DataFrame, events: DataFrame) -> DataFrame:
    """Pending rows after new events: a known rule moves its end, an unknown one starts here."""
    keys = ["host", "alert_condition_id"]
    fresh = events.groupBy(*keys).agg(
        F.min("sv_report_sample_id").alias("_first"), F.max("sv_report_sample_id").alias("_last")
    )
    merged = current.join(fresh, keys, "full")
    return merged.select(
        *keys,
        F.coalesce("sv_report_sample_id_start", "_first").alias("sv_report_sample_id_start"),
        F.coalesce("_last", "sv_report_sample_id_end").alias("sv_report_sample_id_end"),
        "ts_notified",
        F.coalesce("resolved", F.lit(False)).alias("resolved"),
    )


def resolve(rows: DataFrame, evaluated_to: DataFrame) -> DataFrame:
    """Mark pending rows resolved whose end lies before the newest evaluated sample of the host.

    ``evaluated_to`` holds (host, id_evaluated). Rules that were switched off resolve as well.
    """
    joined_rows = join_host_facts(rows, evaluated_to, F.col("sv_report_sample_id_start"), how="left")
    ended = F.col("sv_report_sample_id_end") < F.col("id_evaluated")
    return joined_rows.withColumn("resolved", F.col("resolved") | F.coalesce(ended, F.lit(False))).drop("id_evaluated")


def unresolved(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("resolved"))


def mark_notified(rows: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    """Stamp the pending rows whose episode (host, rule and start) is in ``sent``."""
    keys = ["host", "alert_condition_id", "sv_report_sample_id_start"]
    told = sent.select(*keys).distinct().withColumn("_sent", F.lit(True))
    stamped = F.when(F.col("_sent"), as_of.cast(NTZ)).otherwise(F.col("ts_notified"))
    return rows.join(told, keys, "left").withColumn("ts_notified", stamped).drop("_sent")


def _texts() -> list[Column]:
    names = ("condition_eval", "monitored_host_condition_eval", "description")
    return [F.trim(F.col(n)).alias(n) for n in names]


def alert_view(events: DataFrame, conditions: DataFrame, report: DataFrame) -> DataFrame:
    """Events with the texts of their rule and the time of their sample."""
    times = report.select("host", F.col("id").alias("sv_report_sample_id"), "ts")
    rows = events.join(conditions, "alert_condition_id").join(times, ["host", "sv_report_sample_id"])
    return rows.select("host", "alert_condition_id", "sv_report_sample_id", *_texts(), "error_level", "ts")


def pending_view(rows: DataFrame, conditions: DataFrame, report: DataFrame) -> DataFrame:
    """Pending rows with times, elapsed minutes and whether the delay of their rule has passed."""
    start = report.select("host", F.col("id").alias("sv_report_sample_id_start"), F.col("ts").alias("ts_start"))
    end = report.select("host", F.col("id").alias("sv_report_sample_id_end"), F.col("ts").alias("ts_end"))
    timed = rows.join(start, ["host", "sv_report_sample_id_start"]).join(end, ["host", "sv_report_sample_id_end"])
    return with_conditions(timed, conditions)


def with_conditions(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """The pending view of rows that carry ``ts_start`` and ``ts_end`` themselves."""
    minutes = div(elapsed("SECOND", F.col("ts_start"), F.col("ts_end")) + 3, F.lit(60))
    return rows.join(conditions, "alert_condition_id").select(
        "host",
        "alert_condition_id",
        "sv_report_sample_id_start",
        *_texts(),
        "error_level",
        "alert_delay_minutes",
        "ts_start",
        "ts_end",
        minutes.alias("elapsed_minutes"),
        (minutes >= F.col("alert_delay_minutes")).alias("in_error"),
        F.col("ts_notified").isNotNull().alias("is_notified"),
        "ts_notified",
        "resolved",
        "repetitive_alert",
    )


def pending_order() -> list[Column]:
    """Open first, in error first, worst level first, longest first."""
    return [F.col("resolved"), F.col("in_error").desc(), severity(F.col("error_level")).desc(),
            F.col("elapsed_minutes").desc(), F.col("alert_condition_id")]


def message() -> Column:
    """Text of one notification; the pending number is the first sample of the episode."""
    tail = F.concat(
        F.lit("\n    alert_condition id: "), F.col("alert_condition_id").cast("string"),
        F.lit(" [pending id: "), F.col("sv_report_sample_id_start").cast("string"), F.lit("]"),
    )
    solved = F.concat(F.lit("Resolved: "), F.col("description"), tail)
    failing = F.concat(
        F.upper("error_level"), F.lit(": "), F.col("description"),
        F.lit("\n    This "), F.col("error_level"), F.lit(" alert is pending for "),
        F.col("elapsed_minutes").cast("string"), F.lit(" minutes, since "), stamp(F.col("ts_start")), tail,
    )
    return F.when(F.col("resolved"), solved).otherwise(failing)


def notifications(view: DataFrame) -> DataFrame:
    """Alerts in error that are new, repeating or resolved, with their text."""
    due = F.col("in_error") & (~F.col("is_notified") | F.col("repetitive_alert") | F.col("resolved"))
    return view.where(due).withColumn("message_item", message())


def digest(items: DataFrame) -> DataFrame:
    """(host, digest): open items, then a divider and the resolved ones, blank lines between.

    A host has one item per rule, so the joined text is bounded by the rule table.
    """
    order = pending_rank()
    open_text = joined(F.when(~F.col("resolved"), F.col("message_item")), "\n\n", *order)
    done_text = joined(F.when(F.col("resolved"), F.col("message_item")), "\n\n", *order)
    both = items.groupBy("host").agg(open_text.alias("_open"), done_text.alias("_done"))
    divided = F.concat(F.lit("-------\n\n"), F.col("_done"))
    return both.select("host", F.concat_ws("\n\n", F.col("_open"), divided).alias("digest"))


def pending_rank() -> list[Column]:
    """The pending order as ascending keys, for ordering inside an aggregate."""
    return [-F.col("in_error").cast("int"), -severity(F.col("error_level")), -F.col("elapsed_minutes"),
            F.col("alert_condition_id"), F.col("sv_report_sample_id_start")]


def pending_listing(view: DataFrame, hosts: DataFrame) -> DataFrame:
    """Open alerts as listing cells; a host without any has a single OK row."""
    fresh = F.col("ts_notified").isNull()
    eta = F.col("ts_start") + F.make_dt_interval(mins=F.col("alert_delay_minutes"))
    cells = view.where(~F.col("resolved")).select(
        "host",
        F.when(fresh, "awaiting").otherwise(F.col("error_level")).alias("state"),
        F.concat(F.when(fresh, "awaiting: ").otherwise(""), F.col("error_level")).alias("level_text"),
        "description",
        "ts_start",
        "elapsed_minutes",
        F.coalesce(stamp(F.col("ts_notified")), F.concat(F.lit("ETA: "), stamp(eta.cast(NTZ)))).alias("notified_text"),
        F.when(F.col("repetitive_alert"), "Yes").otherwise("-").alias("repeating"),
    )
    listed = hosts.select("host").distinct().join(cells, "host", "left")
    none = F.col("state").isNull()
    return listed.withColumns(
        {
            "level_text": F.when(none, "OK").otherwise(F.col("level_text")),
            "description": F.when(none, "No pending alerts").otherwise(F.col("description")),
            "state": F.coalesce("state", F.lit("ok")),
        }
    )


def condition_query(conditions: DataFrame) -> DataFrame:
    """(host, query): the ordered ``rule AS condition_<id>`` list of the enabled rules of a host."""
    part = F.concat(F.col("condition_eval"), F.lit(" AS condition_"), F.col("alert_condition_id").cast("string"))
    listed = joined(part, " ,", F.col("alert_condition_id"))
    text = F.concat(F.lit("SELECT "), listed, F.lit(" FROM sv_report_sample ORDER BY id DESC LIMIT 1;"))
    return conditions.where(F.col("enabled")).groupBy("host").agg(text.alias("query"))


def process_summary(processes: DataFrame) -> DataFrame:
    """(host, ts, sleeping, summary) per collected process list: longest running first."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    labels = (("     Id: ", "id"), ("   User: ", "user"), ("   Host: ", "host_from"), ("     db: ", "db"),
              ("Command: ", "command"), ("   Time: ", "time_s"), ("  State: ", "state"), ("   Info: ", "info"))
    lines = [F.concat(F.lit(label), shown(c)) for label, c in labels]
    block = F.concat(F.lit("\n"), F.concat_ws("\n", *lines, F.lit("-------")))
    asleep = F.col("command") == "Sleep"
    grouped = processes.groupBy("host", "ts").agg(
        F.count_if(asleep).alias("sleeping"),
        joined(F.when(~asleep, block), "\n", -F.col("time_s"), F.col("id")).alias("_blocks"),
    )
    count = F.concat(F.lit("Sleeping: "), F.col("sleeping").cast("string"), F.lit(" processes"))
    return grouped.select("host", "ts", "sleeping", F.concat_ws("\n", "_blocks", count).alias("summary"))


def notified_ids(items: DataFrame) -> DataFrame:
    """Episodes (host, rule and start) whose notifications were sent."""
    return items.select("host", "alert_condition_id", "sv_report_sample_id_start").distinct()
