import random

from gaugeweave.checks.compare import connect, differences
from gaugeweave.llm import chat
from gaugeweave.llm.queries import OP10_SQL, op10_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string, at int, h1 long, last string"


def log(spark, conversations):
    rows = [(c, t, r, x, 0, 0, "l") for c, turns in conversations for t, r, x in turns]
    return spark.createDataFrame(rows, SCHEMA)


def turns(*texts, start=0):
    return [(start + i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def brute(conversations):
    known = {}
    for c, ts in conversations:
        if c is not None:
            key = tuple((r or "", x or "") for _, r, x in sorted(ts, key=lambda t: (t[0], t[1] or "", t[2] or "")))
            known.setdefault(key, []).append(c)
    gone = {k[:i] for k in known for i in range(len(k))}
    form = lambda k: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in k)
    return sorted((min(v), len(k), len(v), form(k)) for k, v in known.items() if k not in gone)


def test_snapshots_collapse(spark):
    conversations = [
        (7, turns("a")), (3, turns("a", "b")), (5, turns("a", "b", "c")), (4, turns("a", "b", "c")), (9, turns("a", "x")),
        (1, turns("b")), (2, turns("b", start=10)), (8, turns(None, "")), (6, [(0, None, "a"), (0, None, "a")]), (None, turns("q")),
        (10, turns("ab", "c")), (11, turns("a", "bc")), (12, turns(*["t"] * 400)), (13, turns(*["t"] * 399)), (14, turns("z" * 100_000)),
    ]
    got = sorted(map(tuple, chat.render(log(spark, conversations)).collect()))
    assert got == brute(conversations)


def test_random_logs(spark):
    rng = random.Random(2)
    conversations = [(i, turns(*rng.choices("ab", k=rng.randrange(1, 6)))) for i in range(120)]
    assert sorted(map(tuple, chat.render(log(spark, conversations)).collect())) == brute(conversations)


def test_empty_and_native(spark):
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = chat.maximal(chat.turns_of(log(spark, [(1, turns("a"))])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(op10_chat_formatting(spark, sf), connect(sf), OP10_SQL) == []
