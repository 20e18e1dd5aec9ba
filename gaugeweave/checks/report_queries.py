"""Report metrics by family, at every grain, and the readable text."""


from gaugeweave.catalog import DAY, HOUR
from gaugeweave.checks.fixtures import CAT, ev_samples
from gaugeweave.checks.oracle import report_sql
from gaugeweave.checks.registry import Family
from gaugeweave.checks.rollup_queries import sample_report
from gaugeweave.operators.delta import delta, rates
from gaugeweave.operators.human import FIELD, TEMPLATE, human, metrics_needed
from gaugeweave.operators.report import METRICS, digits_of, inputs_of, report
from gaugeweave.operators.rollup import rollup

FAMILY = Family()

PASSED_VALUES = [m.name for m in METRICS.values() if m.inputs == (m.name,) and not m.name.endswith(("_diff", "_psec"))
                 and m.name != "open_table_definitions"]
PASSED_RATES = [m.name for m in METRICS.values() if m.inputs == (m.name,) and m.name.endswith(("_diff", "_psec"))
                and m.name != "opened_table_definitions_psec"]

GROUPS = {
    "f1_passed_values": PASSED_VALUES,
    "f2_passed_rates": [*PASSED_RATES, "custom_1", "custom_1_psec", "custom_1_time", "custom_2", "custom_2_psec",
                        "custom_2_time"],
    "f3_availability": ["uptime_percent"],
    "f4_share_of_total": [
        *[f"{s}_percent" for s in ("com_select", "com_insert", "com_insert_select", "com_update", "com_delete",
                                   "com_replace", "com_set_option", "com_commit", "slow_queries", "select_scan",
                                   "select_full_join", "select_range", "table_lock_waited", "created_disk_tmp_tables",
                                   "aborted_connections")],
    ],
    "f5_hit_ratio": ["innodb_read_hit_percent", "key_read_hit_percent", "key_write_hit_percent"],
    "f6_occupancy": ["innodb_buffer_pool_used_percent", "innodb_buffer_pool_pages_dirty_percent",
                     "key_buffer_used_percent", "table_cache_use_percent", "max_connections_used_percent",
                     "thread_cache_used_percent", "threads_connected_used_percent", "relay_log_space_used_percent"],
    "f7_rate_difference": ["innodb_data_files_writes_psec", "key_read_hits_psec", "key_write_hits_psec"],
    "f8_unit_scaling": ["innodb_estimated_log_mb_written_per_hour", "mega_bytes_sent_psec", "mega_bytes_received_psec",
                        "relay_log_space_limit_mb", "relay_log_max_size_mb", "relay_log_space_mb", "os_loadavg",
                        "os_mem_total_mb", "os_mem_free_mb", "os_mem_active_mb", "os_swap_total_mb",
                        "os_swap_free_mb"],
    "f9_null_tolerant_sum": ["table_cache_size", "table_definition_cache_size", "open_table_definitions",
                             "opened_table_definitions_psec"],
    "f10_conditional_choice": ["relay_log_max_size"],
    "f11_catch_up": ["seconds_behind_master", "seconds_behind_master_psec", "estimated_slave_catchup_seconds"],
    "f12_component_ratio": ["os_cpu_utilization_percent"],
    "f13_gauge_difference": ["os_mem_used_mb", "os_swap_used_mb"],
}


def grain_report(spark, sf, names, grain):
    needs = inputs_of(names, CAT)
    samples = ev_samples(spark, sf, [*needs.metrics, *needs.params])
    deltas = delta(samples, CAT, needs.metrics, needs.params)
    return report(rates(rollup(deltas, grain, needs.metrics, needs.params), needs.rates), names, CAT)


def _register(name, names):
    @FAMILY.add(name, f"WITH {report_sql(names)} SELECT * FROM report")
    def query(spark, sf):
        return sample_report(spark, sf, names)


for _name, _names in GROUPS.items():
    _register(_name, _names)

ROLLED = ["uptime_percent", "com_select_psec", "com_select_percent", "innodb_read_hit_percent", "threads_connected",
          "key_buffer_used_percent", "os_cpu_utilization_percent", "estimated_slave_catchup_seconds", "os_mem_used_mb"]


@FAMILY.add("f_report_hour", f"WITH {report_sql(ROLLED, 'hour')} SELECT * FROM report")
def hour_report(spark, sf):
    return grain_report(spark, sf, ROLLED, HOUR)


@FAMILY.add("f_report_day", f"WITH {report_sql(ROLLED, 'day')} SELECT * FROM report")
def day_report(spark, sf):
    return grain_report(spark, sf, ROLLED, DAY)


def _human_sql(grain):
    """The same text from a printf of the same template."""
    digits = digits_of(metrics_needed())
    clock = "printf('%02d:%02d:%02d', ({0} % 86400) // 3600, (({0} % 86400) // 60) % 60, {0} % 60)"
    eta = "estimated_slave_catchup_seconds"
    minutes = "CAST(floor(ts_diff_seconds / 60 + 0.5) AS BIGINT)"
    shape = "'%Y-%m-%d %H:%M:%S'"
    derived = {
        "from": f"strftime(CAST(ts AS TIMESTAMP), {shape})",
        "to": f"strftime(CAST(ts AS TIMESTAMP) + to_minutes({minutes}), {shape})",
        "minutes": f"CAST({minutes} AS VARCHAR)",
        "hours": "CAST(CAST(CAST((200 * ts_diff_seconds + 3600) // 7200 AS DOUBLE) / 100 AS DECIMAL(24,2)) AS VARCHAR)",
        "up_days": "CAST(uptime // 86400 AS VARCHAR)",
        "up_clock": clock.format("uptime"),
        "eta_days": f"coalesce(CAST({eta} // 86400 AS VARCHAR), 'N/A')",
        "eta_clock": f"coalesce({clock.format(eta)}, 'N/A')",
        "eta": f"coalesce(strftime(CAST(ts AS TIMESTAMP) + to_seconds({eta}), {shape}), 'N/A')",
    }
    parts, at = [], 0
    for m in FIELD.finditer(TEMPLATE):
        parts.append("'" + TEMPLATE[at : m.start()].replace("'", "''") + "'")
        is_derived, name, mode = m.groups()
        if is_derived:
            parts.append(derived[name])
        elif mode == ":mb":
            parts.append(f"CAST(CAST(floor({name} / 1048576 * 10 + 0.5) / 10 AS DECIMAL(24,1)) AS VARCHAR)")
        else:
            d = digits[name]
            shown = f"CAST({name} AS VARCHAR)" if d == 0 else f"CAST(CAST({name} AS DECIMAL(24,{d})) AS VARCHAR)"
            parts.append(f"coalesce({shown}, 'N/A')" if mode else shown)
        at = m.end()
    parts.append("'" + TEMPLATE[at:].replace("'", "''") + "'")
    return f"WITH {report_sql(metrics_needed(), grain)} SELECT host, id, ts, {' || '.join(parts)} AS report FROM report"


@FAMILY.add("f14_human_text", _human_sql("sample"))
def human_sample(spark, sf):
    return human(sample_report(spark, sf, metrics_needed()), CAT)


@FAMILY.add("f14_human_text_hour", _human_sql("hour"))
def human_hour(spark, sf):
    return human(grain_report(spark, sf, metrics_needed(), HOUR), CAT)


# Every metric at once: the widest plan the report can make.
EVERY = list(METRICS)


@FAMILY.add("f_report_all_metrics", f"WITH {report_sql(EVERY)} SELECT * FROM report")
def every_metric(spark, sf):
    return sample_report(spark, sf, EVERY)


@FAMILY.add(
    "f_report_day_all_metrics",
    f"WITH {report_sql(EVERY, 'day')} SELECT * FROM report",
)
def every_metric_day(spark, sf):
    return grain_report(spark, sf, EVERY, DAY)
