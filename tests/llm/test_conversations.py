"""Conversation repair against brute force, its damage and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from careshed.llm.conversations import Repair, damage, repaired, report

ROWS = "conv_id long, turn long, role string, text string, copy string, fault int, seen long, cost double"  # with names that the operator uses inside


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 8, 0.5) for r in rows], ROWS)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, messages) by trying all edits, with at most two inserts at each place."""
    marks, best = faults(rows), None
    gaps = [list(itertools.product("ua", repeat=n)) for n in (0, 1, 2)]
    gaps = [g for some in gaps for g in some]
    partial = {("", 0, "", ())}
    for i in range(len(rows) + 1):
        opened = set()
        for audit, cost, initials, said in partial:
            for gap in gaps:
                opened.add((audit + "I" * len(gap), cost + 2 * len(gap), initials + "".join(gap), said + tuple(({"u": "user", "a": "assistant"}[g], "") for g in gap)))
        partial = opened
        if i == len(rows):
            break
        (role, text), mark, grown = rows[i], marks[i], set()
        for audit, cost, initials, said in partial:
            grown.add((audit + "D", cost + 3, initials, said))
            if mark in ("blank", "duplicate"):
                continue
            extra = mark == "truncated"
            grown.add((audit + "K", cost + extra, initials + (role[:1] or "?"), (*said, (role, text))))
            for new in ("user", "assistant"):
                grown.add((audit + "R", cost + 2 + extra, initials + new[0], (*said, (new, text))))
        partial = {p for p in grown if re.fullmatch(r"s?(ua)*u?", p[2])}
        least = {}  # by what can still become of it
        for p in partial:
            key = (p[2] == "", p[2][-1:])
            if key not in least or (p[1], p[0]) < (least[key][1], least[key][0]):
                least[key] = p
        if len(rows) > 5:  # whole enumeration for short conversations only
            partial = set(least.values())
    for audit, cost, initials, said in partial:
        if re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, said)
    return best


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in by.items():
        own.sort()
        turns = [t for known, t, _, _ in own if known]
        plain = [(r, t) for _, _, r, t in own]
        marks = faults(plain)
        cost, audit, said = cheapest(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return sorted(out, key=str)


def conversation(rng, conv, n):
    rows, turn = [], 0
    for _ in range(n):
        turn += rng.choice((1, 1, 1, 2, 0))
        role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None, "S"))
        text = rng.choice(("Yes.", "No!", "cut off", "", " \n", "Why?  ", None, f"t{rng.randrange(4)}.", "é…"))
        rows.append((conv, rng.choice((turn, turn, turn, None)), role, text))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_report_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [r for conv in range(60) for r in conversation(rng, conv if conv else None, rng.randrange(1, 5 if seed == 0 else 14))]
    rng.shuffle(rows)
    assert sorted((tuple(r) for r in report(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_damage_and_conversations_without_rows(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(("user", "assistant", None)), f"Text {rng.random()}. End?") for c in (*range(40), None) for t in (*range(3), None)]
    want, convs = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role = " " if role is None else role
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            row = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            want += [row, row] if h == 3 else [row]
    want = brute(want) + [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in convs - {r[0] for r in want}]
    assert sorted((tuple(r) for r in report(damage(frame(spark, rows))).collect()), key=str) == sorted(want, key=str)
    gone = frame(spark, [(1, 1, "user", "x"), (2, 1, "user", "Hi.")]).selectExpr("*", "conv_id = 1 AS gone")
    assert sorted((r.conv_id, r.audit, r.cost) for r in report(gone).collect()) == [(1, "", 0), (2, "KI", 2)]


def test_messages_give_the_digest(spark):
    rng = random.Random(9)
    rows = [r for conv in range(20) for r in conversation(rng, conv, 9)]
    said, audits = {}, {}
    for r in repaired(frame(spark, rows)).collect():
        audits.setdefault(r.conv_id, []).append(r.edit)
        if r.edit != "D":
            said.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    for r in report(frame(spark, rows)).collect():
        own = sorted(said.get(r.conv_id, []))
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == r.repaired_sha256
        assert sorted(audits.get(r.conv_id, [])) == sorted(r.audit)


def test_empty_table_and_long_texts(spark):
    assert report(frame(spark, [])).count() == 0 and repaired(frame(spark, [])).count() == 0
    long = "word " * 200_000 + "."
    (got,) = report(frame(spark, [(1, 1, "user", long), (1, 2, "assistant", long)])).collect()
    assert got.audit == "KK" and got.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()


def test_long_conversations_hold_open_rows_only():
    out = []
    repair, most = Repair(lambda *edit: out.append(edit)), 0
    for i in range(20_000):
        repair.row("user" if i % 2 == 0 else "assistant", "Yes.", False, False)
        most = max(most, len(repair.open))
    assert repair.close() == 0 and len(out) == 20_000 and {e for e, _, _ in out} == {"K"}
    assert most < 10
