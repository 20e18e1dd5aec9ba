import pytest

from gaugeweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4)


@pytest.fixture(scope="session")
def make(spark):
    """Rows of samples (host, id, seconds, then the given columns) from tuples."""

    def build(rows, *columns):
        schema = ", ".join(["host string", "id long", "secs long", *[f"{c} long" for c in columns]])
        frame = spark.createDataFrame(rows, schema)
        ts = "CAST(timestamp_seconds(1704067200 + secs) AS TIMESTAMP_NTZ) AS ts"
        return frame.selectExpr("host", "id", ts, *columns)

    return build


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
