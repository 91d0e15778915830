import hashlib
import zlib

import pytest

from adperf.llm import merkle as M
from adperf.session import checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, subroot string"
OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    return _hash(*("-" if v is None else f"{len(str(v).encode())}:{v}"
                   for v in (doc_id, source, lang, n_chars, text)))


def _climb(nodes, start, at):
    """Siblings, folded digest and top of the plain tree over ``nodes``."""
    siblings = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        mine = at % 8
        siblings += run[:mine] + run[mine + 1:]
        start = _hash(*run[:mine], start, *run[mine + 1:])
        nodes = [_hash(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        at //= 8
    return siblings, start, nodes[0]


def _plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(_leaf(r))))
    leaves = {g: [_leaf(r) for r in groups[g]] for g in names}
    subroots = [_climb(leaves[g], "", 0)[2] for g in names]
    out = []
    for k, g in enumerate(names):
        for at, row in enumerate(groups[g]):
            seen = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1]:
                seen = (row[0], "".join(c.lower() if c.isascii() else c for c in row[1]), *row[2:])
            low, folded, _ = _climb(leaves[g], _leaf(seen), at)
            high, folded, root = _climb(subroots, folded, k)
            out.append((row[0], leaves[g][at], subroots[k], root, _hash(*low, *high), folded,
                        folded == root))
    return sorted(out, key=str)


def _result(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in M.manifest(docs, M.tampered_third()).select(*OUT).collect()),
                  key=str)


EDGE = [(1, "A b", "en", "s", 3, "x"), (1, "A b", "en", "s", 3, "x"), (1, "other", "en", "s", 3, "x"),
        (None, "No id", "en", "s", None, None), (None, None, None, None, None, None),
        (None, None, None, None, None, None), (2**53 + 1, "ÉA", "", "s:1", -1, "x"),
        (7, "", "é", "", 0, "x"), (-5, "Long " * 60_000, "z", None, 9, "x"), (3, "Q", "Z", "s", 1, "x")]


def test_nulls_ties_long_texts_and_lone_leaves(spark):
    assert _result(spark, EDGE) == _plain(EDGE)


@pytest.mark.parametrize("n, groups", [(1, 1), (8, 1), (9, 1), (600, 1), (600, 70), (90, 90)])
def test_tree_shapes(spark, n, groups, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)  # nodes of two levels and more are stored per block
    rows = [(i, f"Text {i}", f"g{i * i % groups}", "s", i, "") for i in range(n)]
    assert _result(spark, rows) == _plain(rows)


def test_a_hot_group_of_equal_rows(spark):
    rows = [(5, "Same", "en", "s", 4, "")] * 150 + [(i, "Other", "en", "s", i, "") for i in range(99)]
    assert _result(spark, rows) == _plain(rows)


def test_empty_table_and_nothing_left_behind(spark):
    assert _result(spark, []) == []
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [f.getPath().getName() for f in fs.listStatus(folder)]
    assert not [x for x in left if "merkle" in x and "merkle-out" not in x]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_untampered_tables_verify(spark):
    docs = spark.createDataFrame([(i, "T", "g", "s", 1, "") for i in range(20)], SCHEMA)
    assert {r.verified for r in M.manifest(docs).collect()} == {True}
