from cases import frame
from compare import check_query
from pyspark.sql import functions as F

from ledgerlight.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_against_sql(spark):
    assert check_query(spark, "/root/testdata/sf0.01", chat.query, chat.SQL)


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r, x))
    convs = {c: tuple((r, x) for _, _, r, x in sorted(v, key=lambda t: t[:2])) for c, v in by.items()}
    out = []
    for turns in set(convs.values()):
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values()):
            ids = [c for c, v in convs.items() if v == turns]
            text = "".join(f"<|{r if r is not None else 'unknown'}|>\n{x or ''}\n<|end|>\n" for r, x in turns)
            out.append((min((i for i in ids if i is not None), default=None), len(turns), len(ids), text))
    return out


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    long = [(i % 2 and "user" or "assistant", f"say {i}") for i in range(40)]
    rows = []
    for c, n in enumerate([1, 2, 3, 5, 5, 17, 40, 40]):
        rows += [(c, t, *long[t]) for t in range(n)]
    rows += [(20, 10 * t, *long[t]) for t in range(12)]  # gaps: still a prefix
    rows += [(21, t, *(long[t] if t != 4 else ("user", "differs"))) for t in range(9)]
    rows += [(30, 0, None, "a"), (31, 0, "a", None), (32, 0, None, None), (33, None, "user", "first"), (33, 0, "user", "second"), (34, 0, "user", ""), (None, 0, "user", "no id"), (None, 1, "user", "again")]
    df = frame(spark, rows, SCHEMA).withColumn("c", F.lit("clash")).withColumn("rank", F.lit(0))
    got = [tuple(r) for r in chat.formatted(spark, df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (3, 1, "user", "x"), (3, 1, "user", "x")]
    got = chat.formatted(spark, frame(spark, rows, SCHEMA)).collect()
    assert {(r.conv_id, r.n_turns, r.copies) for r in got} == {(1, 2, 2), (3, 2, 1)}


def test_empty(spark):
    assert chat.formatted(spark, frame(spark, [], SCHEMA)).count() == 0


def test_native(spark):
    plan = chat.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
