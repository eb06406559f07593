import duckdb

from spanforge.llm.chat import OP9_SQL, collapse, op9_snapshots


def brute(rows):
    talks = {}
    for conv, turn, role, text in set(rows):
        talks.setdefault(conv, []).append((turn is None, turn, role, text))
    talks = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: (y[0], y[1] or 0))] for c, x in talks.items()}
    kept = {}
    for c in sorted(talks, key=lambda c: (c is None, c or 0)):
        s = talks[c]
        if not any(len(o) > len(s) and o[: len(s)] == s for o in talks.values()) and s not in [talks[k] for k in kept]:
            kept[c] = sum(o == s for o in talks.values())
    return {(c, i + 1, r, t, n) for c, n in kept.items() for i, (r, t) in enumerate(talks[c])}


def test_collapse_equals_brute_force(spark):
    a = [("user", "hi"), ("assistant", "ho"), ("user", "x"), ("assistant", None)]
    talks = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "other")], 6: a[:3], 7: [("user", "ho"), ("assistant", "hi")], 8: [("user", "hi"), ("assistant", "")], None: a[:2] + [("user", "new")], 9: [(None, "")], 10: [("user", "long")] * 300}
    rows = [(c, i * 3, r, t) for c, s in talks.items() for i, (r, t) in enumerate(s)] + [(5, None, "user", "no turn")] + [(3, 0, "user", "hi")] * 3
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = collapse(frame).collect()
    assert {(r.conv_id, r.position, r.role, r.rendered.split("\n", 1)[1].removesuffix("<|im_end|>\n"), r.n_copies) for r in got} == {(c, i, r, t or "", n) for c, i, r, t, n in brute(rows)}
    for c in {r.conv_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.position):
            assert r.start == at
            at += len(r.rendered)
    assert collapse(frame.limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    got = op9_snapshots(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(OP9_SQL).fetchall())
    assert got.columns == duckdb.sql(OP9_SQL).columns


def test_many_copies_and_very_long_turns(spark):
    long = "word " * 60_000
    rows = [(i, 1, "user", "hello") for i in range(1500)] + [(5000 + i, t, "user", x) for i in range(2) for t, x in enumerate([long, long + "end"][: i + 1])]
    got = collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.position, r.n_copies) for r in got} == {(0, 1, 1500), (5001, 1, 1), (5001, 2, 1)}
    assert next(r.start for r in got if r.position == 2) == len(next(r.rendered for r in got if r.conv_id == 5001 and r.position == 1))
