"""Operator 13 against a search over all edit strings, at every size of segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from labelwise.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_edits(codes):
    """All cheapest edits by widening strings: least cost, then least string, per state, without matrices."""
    def legal(state, letter):
        return {0: {1: 1, 2: 2}, 1: {2: 2}, 2: {3: 3}, 3: {2: 2}}[state].get(letter)

    best = {0: (0, "")}

    def put(table, state, cost, text):
        if state not in table or (cost, text) < table[state]:
            table[state] = (cost, text)

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for s, (c, t) in list(out.items()):
                put(out, 3 if s == 2 else 2, c + 3, t + "I")
        return out

    for code in codes:
        new = {}
        for s, (c, t) in inserted(best).items():
            put(new, s, c + 4, t + "D")
            if code & 8:
                continue
            extra = 3 if code & 4 else 0
            if legal(s, code & 3):
                put(new, legal(s, code & 3), c + extra, t + "K")
            put(new, 3 if s == 2 else 2, c + 3 + extra, t + "R")
        best = new
    return min(v for s, v in inserted(best).items() if s in (0, 3))


@pytest.mark.parametrize("n", range(6))
def test_edits_equal_a_plain_search(n):
    rnd = random.Random(n)
    all_codes = [*range(8), 8, 9, 10, 11]
    cases = list(itertools.product(all_codes, repeat=n)) if n < 3 else [tuple(rnd.choice(all_codes) for _ in range(rnd.randint(3, 40))) for _ in range(400)]
    for codes in cases:
        assert structure.edits(bytes(codes)) == brute_edits(codes), codes


def brute(rows):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            turns += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, n = set(), [], [0, 0, 0]
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + (4 if fault == 2 else 8 if fault in (0, 1) else 0))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = brute_edits(codes)
        made, at, last = [], iter(turns), None
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(at)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            made.append(f"{role}:{text}")
            last = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def conversations():
    rnd = random.Random(3)
    texts = ["Hello.", "Hello.", "What now?", "no end", "", None, " \t\n", "Yes!", "cut off, ", "Done. ", "a\n.", "..."]
    rows = []
    for c in [*range(60), None, 2**62, -7]:
        for _ in range(rnd.choice([1, 2, 3, 8, 8, 30])):
            rows.append((c, rnd.choice([None, *range(-2, 12)]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys", "User"]), rnd.choice(texts)))
    rows += [(1000, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(500)]
    rows += [(1001, None, "user", "Same.")] * 40
    rows += [(c, 0, "user", "x") for c in range(1100, 1200)]
    return rows


@pytest.mark.parametrize("segment, fan, parts", [(4096, 1024, None), (7, 3, 5), (1, 2, 11)])
def test_repair_equals_brute_force(table, monkeypatch, segment, fan, parts):
    monkeypatch.setattr(structure, "PIECE_BYTES", 300)
    rows = conversations()
    got = structure.repair_damaged(table(rows, SCHEMA), segment=segment, fan=fan, parts=parts).collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_empty_table_clashing_names_and_other_ids(spark, table):
    assert structure.repair_damaged(table([], SCHEMA)).count() == 0
    rows = [(f"c{c}", t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", 1, 2) for c in range(5) for t in range(4)]
    got = structure.repair_damaged(table(rows, "name string, nr int, row_no string, part_no string, conv_id int, audit int"), "name", "nr", "row_no", "part_no").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute([r[:4] for r in rows])
