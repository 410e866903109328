"""Operator 11 against a plain trie over whole paths."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from labelwise.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    made = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = None if c is None else c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        lent = own.get(base, [])[:h] if c is not None else []
        made[c] = tuple((r, x) for _, r, x in lent + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in made.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    low = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    return sorted((str(low[p]), len(p), str(low[p[:-1]]) if p else "None", len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in ends[p] if c is not None))).encode()).hexdigest()) for p, m in members.items())


def as_rows(df):
    return sorted((str(r.conv_id), r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations():
    rnd = random.Random(11)
    openings = [[("system", "be kind"), ("user", "hi there friend"), ("assistant", "hello  you")], [("user", "hi there friend")], [("user", None)]]
    rows = []
    for c in [*range(0, 130), 2**62, -41, -40, -21]:
        turns = list(rnd.choice(openings)) + [(rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "c", "", "d e f\t"])) for _ in range(rnd.choice([0, 0, 1, 4, 9]))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    common = [("user", f"step {k}") for k in range(30)]
    for c in range(200, 260):  # a long common beginning that is left at different turns
        cut = rnd.randint(1, 30)
        rows += [(c, t, *x) for t, x in enumerate(common[:cut] + [("assistant", str(rnd.randint(0, 3)))] * rnd.randint(0, 3))]
    rows += [(300, t, "user", f"w{t}") for t in range(700)]
    rows += [(None, None, "user", "lost"), (None, 3, None, "lost words"), (None, 3, None, "lost words")]
    rows += [(5, 1, "user", "hi there friend")] * 2 + [(6, None, "user", "first")]
    return rows


@pytest.mark.parametrize("parts", [None, 13])
def test_equals_a_plain_trie(table, parts):
    rows = conversations()
    assert as_rows(prefix_trie.prefix_trie(table(rows, SCHEMA), parts=parts)) == brute(rows)


def test_small_tables(table, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 40)
    assert prefix_trie.prefix_trie(table([], SCHEMA)).count() == 0
    one = [(40, 0, "user", "alone here")]
    assert as_rows(prefix_trie.prefix_trie(table(one, SCHEMA))) == brute(one)
    idle = [(c, 0, "user", "x") for c in range(41, 60)]  # without the lender, most have no turn left
    assert as_rows(prefix_trie.prefix_trie(table(idle, SCHEMA))) == brute(idle)
    same = [(c, t, "user", "x y") for c in range(100, 500) for t in range(5)]
    assert as_rows(prefix_trie.prefix_trie(table(same, SCHEMA), parts=7)) == brute(same)


def test_clashing_names(table):
    rows = [(c, t, "user", f"w {t}", 1, 2) for c in range(30) for t in range(c % 5)]
    got = prefix_trie.prefix_trie(table(rows, "block long, c int, depth string, words string, conv_id int, row_no int"), "block", "c", "depth", "words")
    assert as_rows(got) == brute([r[:4] for r in rows])
