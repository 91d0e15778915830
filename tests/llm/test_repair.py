import hashlib
import itertools
import random
import re
import zlib

import pytest

from adperf.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
       "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"


def _damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def _plain_repair(rows):
    """Best (cost, audit, turns) by a table over (rows done, roles so far as a state)."""
    best = {(0, ""): (0, "", ())}

    def offer(i, state, cost, audit, turns):
        if (i, state) not in best or (cost, audit) < best[i, state][:2]:
            best[i, state] = (cost, audit, turns)

    def after(state, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a",
                ("a", "u"): "u"}.get((state, role))

    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts may follow each other
            for state in ("", "s", "u", "a"):
                if (i, state) in best:
                    cost, audit, turns = best[i, state]
                    for role in ("user", "assistant"):
                        if after(state, role[0]):
                            offer(i, after(state, role[0]), cost + 2, audit + "I",
                                  (*turns, role + ":"))
        if i == len(rows):
            break
        role, text, fault = rows[i]
        for state in ("", "s", "u", "a"):
            if (i, state) not in best:
                continue
            cost, audit, turns = best[i, state]
            offer(i + 1, state, cost + 3, audit + "D", turns)
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if after(state, role[:1]):
                offer(i + 1, after(state, role[:1]), cost + more, audit + "K",
                      (*turns, f"{role}:{text}"))
            for new in ("user", "assistant"):
                if after(state, new[0]):
                    offer(i + 1, after(state, new[0]), cost + 2 + more, audit + "R",
                          (*turns, f"{new}:{text}"))
    return min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)


def _plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = _damage([r for r in rows if r[0] == conv])
        seen, marked = set(), []
        for _, _, role, text in own:
            shown = text.rstrip(WHITE)
            fault = ("blank" if not shown else "duplicate" if (role, text) in seen
                     else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for _, t, _, _ in own if t is not None}
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au")
                      for a, b in zip(marked, marked[1:]))
        cost, audit, kept = _plain_repair(marked)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *[sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")],
                    illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _result(spark, rows):
    found = R.report(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in found.select(*OUT).collect()), key=str)


def _random_rows(n, convs, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "u", "", None, "Assistant"]
    texts = ["Hi.", "Go on!", "What?", "cut off", "", " \t", None, "é. ", "Hi.", "a.b", "😀"]
    weights = [6, 6, 2, 1, 1, 1, 1, 1]
    return [(rng.choice([*range(convs), None]), rng.choice([*range(9), None, 40]),
             rng.choices(roles, weights)[0], rng.choice(texts), "x") for _ in range(n)]


def test_equals_a_plain_table_with_nulls_ties_and_repeats(spark):
    rows = _random_rows(700, 90, 1)
    rows += rows[:60] + [(500, 1, "user", "long " * 60_000 + ".", ""), (501, None, None, None, ""),
                         (2**53 + 1, 3, "user", "Hi.", ""), (2**53 + 1, 4, "assistant", "Ok.", "")]
    gone = next(i for i in range(600, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Only one.", ""))
    got = _result(spark, rows)
    assert got == _plain(rows)
    assert next(r for r in got if r[0] == gone)[1:8] == (0, 0, 0, 0, 0, 0, "")


def test_a_conversation_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_BITS", 3)
    rng = random.Random(5)
    rows = [(7 if i % 3 else i, i // 2, rng.choice(["user", "assistant", "system", "tool"]),
             rng.choice([f"Text {i}.", "again.", f"open {i}", ""]), "") for i in range(900)]
    assert _result(spark, rows) == _plain(rows)


def test_equal_rows_of_a_hot_conversation(spark):
    rows = [(None, None, "user", "Same.", "")] * 300 + _random_rows(200, 60, 3)
    assert _result(spark, rows) == _plain(rows)


def test_empty_table(spark):
    assert _result(spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_agenda_finds_the_least_of_all_edit_strings(n):
    """Every string of edits, with up to two inserts at each place, is tried."""
    price = {"D": 3, "I": 2, "R": 2, "K": 0}
    for rows in itertools.product(itertools.product("suax", "nbt"), repeat=n):
        best = None
        for choice in itertools.product(["D", "K", "Ru", "Ra"], repeat=n):
            if any(c != "D" and f == "b" for c, (_, f) in zip(choice, rows)):
                continue
            for extra in itertools.product(["", "u", "a", "ua", "au"], repeat=n + 1):
                made, audit, cost = extra[0], "I" * len(extra[0]), 2 * len(extra[0])
                for (initial, fault), edit, more in zip(rows, choice, extra[1:]):
                    made += {"D": "", "K": initial}.get(edit, edit[1:]) + more
                    audit += edit[0] + "I" * len(more)
                    cost += price[edit[0]] + (fault == "t" and edit != "D") + 2 * len(more)
                if re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        initials, faults = ("".join(r[i] for r in rows) for i in (0, 1))
        assert R.join_slices([R.solve_slice(initials, faults)])[0] == best
