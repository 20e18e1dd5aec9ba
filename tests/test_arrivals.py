from gaugeweave.checks import stream_queries
from gaugeweave.streaming.run import each_batch


def drained(spark, stream, tmp_path):
    seen = []
    each_batch(stream, lambda rows, n: seen.append((rows.rdd.getNumPartitions(), sorted(r["id"] for r in rows.collect()))), str(tmp_path))
    return seen


def test_a_batch_is_several_files_and_keeps_its_rows(spark, make, tmp_path):
    rows = make([("a", i, i) for i in range(300)])
    seen = drained(spark, stream_queries.staged(spark, rows), tmp_path)
    assert [ids for _, ids in seen] == [list(range(100)), list(range(100, 200)), list(range(200, 300))]
    assert all(n > 1 for n, _ in seen)


def test_a_batch_with_fewer_rows_than_files_is_one_batch(spark, make, tmp_path):
    seen = drained(spark, stream_queries.staged(spark, make([("a", i, i) for i in range(6)])), tmp_path)
    assert [ids for _, ids in seen] == [[0, 1], [2, 3], [4, 5]]
