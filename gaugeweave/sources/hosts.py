"""Operating system facts from collected text lines and file system counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.functions.numeric import div

# Keys of the collected lines and the sample fields they fill.
CPU_FIELDS = ("os_cpu_user", "os_cpu_nice", "os_cpu_system", "os_cpu_idle")
MEMINFO = {
    "memtotal": "os_mem_total_kb",
    "memfree": "os_mem_free_kb",
    "active": "os_mem_active_kb",
    "swaptotal": "os_swap_total_kb",
    "swapfree": "os_swap_free_kb",
}
VMSTAT = {"pgpgin": "os_page_ins", "pgpgout": "os_page_outs", "pswpin": "os_swap_ins", "pswpout": "os_swap_outs"}


def os_samples(lines: DataFrame) -> DataFrame:
    """One row per (host, ts) from lines (host, ts, file, line_no, line). Missing facts are NULL."""
    tokens = F.split(F.trim("line"), "\\s+")
    source = F.col("file")

    def token(i: int) -> Column:
        return F.get(tokens, F.lit(i))

    def picked(when: Column, value: Column, alias: str) -> Column:
        return F.max(F.when(when, value)).alias(alias)

    first_stat = (source == "stat") & (F.col("line_no") == 0)
    load = (token(0).try_cast("double") * 1000).cast("long")
    key = F.lower(F.replace(token(0), F.lit(":"), F.lit("")))
    facts = [picked(first_stat, token(i + 1).try_cast("long"), f) for i, f in enumerate(CPU_FIELDS)]
    facts.append(
        F.when(
            F.count_if(source == "stat") > 0,
            F.count_if((source == "stat") & F.col("line").rlike("^cpu\\d+\\s")),
        ).alias("os_total_cpu_cores")
    )
    facts.append(picked((source == "loadavg") & (F.col("line_no") == 0), load, "os_loadavg_millis"))
    facts += [picked((source == "meminfo") & (key == k), token(1).try_cast("long"), f) for k, f in MEMINFO.items()]
    facts += [picked((source == "vmstat") & (token(0) == k), token(1).try_cast("long"), f) for k, f in VMSTAT.items()]
    return lines.groupBy("host", "ts").agg(*facts)


def mount_usage(blocks: Column, free: Column, available: Column) -> Column:
    """Used share of a mount in whole percent, rounded up; NULL when it has no space."""
    used = blocks - free
    total = F.nullif(used + available, F.lit(0))
    return div(used * 100 + total - 1, total)


def mount_samples(mounts: DataFrame) -> DataFrame:
    """One row per (host, ts) with the usage of the root, data and temporary mounts."""
    usage = mount_usage(F.col("blocks"), F.col("bfree"), F.col("bavail"))
    return mounts.groupBy("host", "ts").agg(
        *[
            F.max(F.when(F.col("mount") == m, usage)).alias(f"os_{m}_mountpoint_usage_percent")
            for m in ("root", "datadir", "tmpdir")
        ]
    )
