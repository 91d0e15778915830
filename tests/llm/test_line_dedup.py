import random

from adperf.llm import line_dedup as L

SCHEMA = "doc_id long, text string, runs int"


def corpus(seed=1, n=50):
    rng = random.Random(seed)
    notice = "All rights of this notice are reserved by its holders."
    passage = [f"shared line {i}" for i in range(7)]
    rows = []
    for i in range(n):
        own = [rng.choice(["a", "b", "c", f"own {i} {rng.randrange(9)}", "", " "])
               for _ in range(rng.randrange(0, 9))]
        if i % 3 == 0:
            a = rng.randrange(len(passage) - 1)
            own[1:1] = passage[a:rng.randrange(a + 1, len(passage) + 1)]
        if i % 5 == 0:
            own.append(notice)
        rows.append((i, "\n".join(own), 1))
    rows += [(n, rows[3][1], 1), (n + 1, None, 1), (n + 2, "", 1), (n + 3, "\n \n", 1),
             (n + 4, "x\ny\n" * 700, 1), (n + 5, "x\n\ny\r\nx", 1), (n + 6, "x", 1), (n + 6, "x", 1),
             (n + 7, notice + "\r", 1)]
    return rows


def brute(rows):
    """Lines covered by later copies: single long lines and pairs of lines."""
    out, first = {}, {}
    runs = []
    for d, text in sorted({(r[0], r[1] or "") for r in rows}):
        lines = [(p, x.rstrip(" ") if not x.endswith("\r") else x) for p, x in
                 enumerate(text.split("\n"))]
        lines = [(p, x.rstrip(" ")) for p, x in lines if x.strip(" ")]
        for k in (1, 2):
            for i in range(len(lines) - k + 1):
                key = tuple(x for _, x in lines[i:i + k])
                if k == 1 and len(key[0]) < L.LONG_LINE:
                    continue
                at = (d, lines[i][0])
                first[key] = min(first.get(key, at), at)
                runs.append((key, at, lines[i + k - 1][0]))
    for key, at, end in runs:
        if first[key] != at:
            out.setdefault(at[0], set()).update(range(at[1], end + 1))
    return out


def test_matches_brute_force(spark):
    rows = corpus()
    got = L.report(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        covered = {p for x in r.runs for p in range(x.lo, x.hi + 1)}
        assert covered == expected.get(r.doc_id, set()), r.doc_id
        assert r.n_deleted == len(covered) and r.n_runs == len(r.runs)
    by_id = {r.doc_id: r for r in got}
    assert by_id[54].depth >= 512  # rounds go on to the longest common prefix


def test_remove_lines(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = L.remove_lines(docs)
    assert out.columns == docs.columns
    got, expected = {r.doc_id: r for r in out.collect()}, brute(rows)
    for d, text, _ in rows:
        left = [x for p, x in enumerate((text or "").split("\n")) if p not in expected.get(d, ())]
        if d in expected and not "".join(left).strip():
            assert d not in got
        else:
            assert got[d].text == (text if d not in expected else "\n".join(left))


def test_empty_table_and_native_plan(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert L.report(docs).collect() == []
    plan = L.report(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
