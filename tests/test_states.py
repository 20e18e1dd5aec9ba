"""Tables kept beside samples: masks of hours, mergeable parts, the index of newest rows."""

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeweave.catalog import CHARTS, SAMPLE
from gaugeweave.checks.fixtures import CAT
from gaugeweave.operators.report import inputs_of
from gaugeweave.operators.states import NewestIndex, hours_of, missing_hours, note_hours, profile_of, ranges_of, refresh_states, states
from gaugeweave.plans.charts import chart_payloads, names_of
from gaugeweave.sources import tables
from gaugeweave.sources.tables import append_rows, open_table, read_table
from conftest import rows_of

HOUR, DAY = 3600, 86_400


def test_missing_hours_read_masks_only(make, tmp_path):
    spark = make([], "m").sparkSession
    samples, have, rolled = (str(tmp_path / n) for n in ("samples", "have", "rolled"))
    append_rows(make([("a", i, i * HOUR, i) for i in range(30)] + [("b", 1, 0, 1)], "m"), samples, shards=2)
    note_hours(read_table(spark, samples), have, shards=2)
    note_hours(make([("a", i, i * HOUR + 5, i) for i in range(30) if i not in (0, 23, 24, 29)], "m"), rolled, shards=2)
    missing = missing_hours(read_table(spark, have), read_table(spark, rolled))
    assert all(have in f or rolled in f for f in missing.inputFiles())
    start = datetime(2024, 1, 1)
    assert rows_of(missing, "host", "ts") == [("a", start), ("a", datetime(2024, 1, 1, 23)), ("a", datetime(2024, 1, 2)),
                                              ("a", datetime(2024, 1, 2, 5)), ("b", start)]


def test_masks_grow_in_any_order_and_by_repeats(make, tmp_path):
    path = str(tmp_path / "masks")
    for part in ([("a", 9, 23 * HOUR, 1)], [("a", 1, 0, 1), ("b", 1, DAY, 1)], [("a", 9, 23 * HOUR, 1)], []):
        note_hours(make(part, "m"), path, shards=2)
    masks = read_table(make([], "m").sparkSession, path)
    assert rows_of(masks, "host", "ts", "mask") == [("a", date(2024, 1, 1), 1 << 23 | 1), ("b", date(2024, 1, 2), 1)]
    assert hours_of(masks).count() == 3 and missing_hours(masks, masks).count() == 0


def test_a_late_row_replaces_the_part_of_its_slot(make, tmp_path):
    path, metrics = str(tmp_path / "states"), {"m": 1}
    first = make([("a", 1, 0, 10), ("a", 2, 60, 20), ("a", 3, 600, None), ("a", 4, 7 * DAY, 40)], "m")
    every = first.unionByName(make([("a", 5, 120, 90)], "m"))
    refresh_states(first, first, metrics, path, shards=1)
    for _ in (1, 2):
        refresh_states(every, every.where("id = 5"), metrics, path, shards=1)
    stored = read_table(first.sparkSession, path)
    columns = ["host", "ts", "count_rows", "id", "m_units", "m_count"]
    assert rows_of(stored.na.fill(-1), *columns) == rows_of(states(every, metrics).na.fill(-1), *columns)
    assert rows_of(profile_of(stored, metrics), "wd", "hr", "m") == [(0, 0, 40.0)]
    assert rows_of(ranges_of(stored, metrics), "count_rows", "m_min", "m_max") == [(3, 40.0, 40.0)]


def test_newest_rows_under_repeats_late_rows_and_retention(make, tmp_path):
    spark, index = make([], "m").sparkSession, NewestIndex(str(tmp_path / "newest"), shards=2)
    with pytest.raises(FileNotFoundError):
        index.table(spark)
    index.retire(spark, date(2024, 1, 1))
    for part in ([("a", 5, 5 * DAY, 1), ("b", 1, 0, 1)], [("a", 4, 4 * DAY, 1), ("c", 1, DAY, 1)], [("a", 5, 5 * DAY, 1)]):
        index.note(make(part, "m"))
    assert rows_of(index.table(spark), "host", "id_latest") == [("a", 5), ("b", 1), ("c", 1)]
    index.retire(spark, date(2024, 1, 2))
    assert rows_of(index.table(spark), "host", "id_latest") == [("a", 5), ("c", 1)]
    index.note(make([("b", 7, 6 * DAY, 1)], "m"))
    assert rows_of(index.table(spark), "host", "id_latest") == [("a", 5), ("b", 7), ("c", 1)]


def test_a_half_written_table_is_finished_before_it_is_read(make, tmp_path, monkeypatch):
    path = str(tmp_path / "masks")
    note_hours(make([("a", 1, 0, 1)], "m"), path, shards=1)

    def dies(placed, at, folders):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(tables, "_overwrite_folders", dies)
        with pytest.raises(RuntimeError):
            note_hours(make([("a", 2, HOUR, 1)], "m"), path, shards=1)
    note_hours(make([("a", 3, 2 * HOUR, 1)], "m"), path, shards=1)
    assert rows_of(read_table(make([], "m").sparkSession, path), "mask") == [(7,)]


def test_charts_with_the_index_read_only_the_days_they_draw(make, tmp_path):
    charts = CHARTS[:2]
    needs = inputs_of(names_of(charts), CAT)
    columns = list(dict.fromkeys([*needs.metrics, *needs.params]))
    path, index = str(tmp_path / "samples"), NewestIndex(str(tmp_path / "newest"), shards=1)
    rows = make([("a", i, i * 600, *[i * (k + 3) % 5000 + i * 7 for k in range(len(columns))]) for i in range(6 * 144)], *columns)
    append_rows(rows, path, shards=1)
    index.note(rows)
    as_of = F.lit(rows.agg(F.max("ts")).first()[0])
    whole = rows_of(chart_payloads(rows, SAMPLE, as_of, CAT, charts), "host", "alias", "payload")
    old = sorted(Path(path).glob("day=*"))[0]
    for file in old.glob("shard=*/*"):
        file.unlink() if file.name.startswith(".") else file.write_text("not to be read")
    spark = rows.sparkSession
    got = chart_payloads(open_table(spark, path), SAMPLE, as_of, CAT, charts, newest=index.table(spark))
    assert len(whole) == 2 and rows_of(got, "host", "alias", "payload") == whole
    with pytest.raises(Exception, match="not a Parquet file"):
        open_table(spark, path).agg(F.max(columns[0])).collect()
