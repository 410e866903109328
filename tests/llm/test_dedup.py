"""Byte and passage de-duplication and the n-gram join against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from labelwise.llm import fm_dedup, ngram_join, repeats, suffix_dedup
from labelwise.llm.graph import components

from .conftest import WORD, fold


def runs(covered):
    return sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))


def brute_bytes(rows, width):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + width] for _, b in data for i in range(len(b) - width + 1))
    for d, b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                covered[i:i + width] = b"\1" * width
        yield d, len(b), sum(covered), runs(covered), hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()


def brute_words(rows, width):
    never = 1 << 62
    data = [(d, never if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for _, key, w in data:
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            first[g] = min(first.get(g, never), key)
    for d, key, w in data:
        covered = [0] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < key:
                covered[i:i + width] = [1] * width
        kept = " ".join(x for x, c in zip(w, covered) if not c)
        yield d, len(w), sum(covered), runs(covered), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("width,seed,chunk", [(200, 32, 4_000_000), (60, 20, 20_000)])
def test_suffix_dedup(table, documents, width, seed, chunk):
    df = table(documents, "doc_id long, text string")
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeated_bytes(df, width=width, seed=seed, chunk=chunk).drop("rid").collect())
    assert got == Counter(brute_bytes(documents, width))


@pytest.mark.parametrize("words,width,seed", [(False, 200, 64), (True, 50, 10)])
def test_anchors_of_a_piece_are_found_in_slices(words, width, seed):
    rng = random.Random(3)
    texts = pa.array([None if k % 50 == 7 else " ".join(rng.choices(["a", "bcd", "efghij", "k1"], k=rng.randrange(900))) for k in range(700)])
    piece = pa.RecordBatch.from_arrays([texts], ["text"])
    assert repeats.PIECE < pc.sum(pc.binary_length(texts)).as_py()
    want = repeats.anchors(repeats.Units(texts, words), width, seed)
    tracemalloc.start()
    got = repeats.piece_anchors(piece, words, width, seed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got[0]) > 1000 and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert peak < 20 << 20  # all at once: 104 MB of bytes, 33 MB of words


@pytest.mark.parametrize("width,seed,chunk", [(50, 10, 4_000_000), (12, 4, 50_000)])
def test_fm_dedup(table, documents, width, seed, chunk):
    df = table(documents, "doc_id long, text string")
    got = Counter(tuple(r) for r in fm_dedup.remove_repeated_passages(df, width=width, seed=seed, chunk=chunk).drop("rid").collect())
    assert got == Counter(brute_words(documents, width))


def test_hot_anchors(table, documents):
    """The same results when every anchor with more than one span is dealt by its windows."""
    df = table(documents, "doc_id long, text string")
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeated_bytes(df, width=60, seed=20, hot_spans=1).drop("rid").collect())
    assert got == Counter(brute_bytes(documents, 60))
    got = Counter(tuple(r) for r in fm_dedup.remove_repeated_passages(df, width=12, seed=4, hot_spans=1).drop("rid").collect())
    assert got == Counter(brute_words(documents, 12))


def test_kept_text(table):
    rows = [(1, "a " * 60 + "end"), (2, "start " + "a " * 60)]
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in fm_dedup.remove_repeated_passages(
        table(rows, "doc_id long, text string"), keep_text=True).collect()}
    assert kept == {1: " ".join(rows[0][1].split()), 2: "start"}


def test_multikey_sort():
    rnd = random.Random(1)
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    length = np.array([len(s) for s in strings])
    order, common = suffix_dedup.multikey_sort(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(length) - length, length)
    ranked = [strings[i] for i in order]
    assert ranked == sorted(strings)
    for i in range(1, len(ranked)):
        k = 0
        while k < min(len(ranked[i]), len(ranked[i - 1])) and ranked[i][k] == ranked[i - 1][k]:
            k += 1
        assert common[i] == k


def test_fm_index_ranks():
    rnd = np.random.default_rng(3)
    text = np.append(rnd.integers(1, 9, 3000), 0)
    index = fm_dedup.FMIndex(text, 9, 12)
    for _ in range(50):
        at = int(rnd.integers(0, 2900))
        pattern = text[at:at + int(rnd.integers(1, 12))]
        low, high = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            low, high = index.step(np.array([c]), low, high)
        found = sorted(index.suffixes[low[0]:high[0]].tolist())
        assert found == [i for i in range(len(text) - len(pattern) + 1) if (text[i:i + len(pattern)] == pattern).all()]


def grams(text, n=3):
    w = WORD.findall(fold(text))
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def brute_roots(rows, n=3, percent=90):
    """The rows' sets, and for every row the first row that links reach."""
    sets = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in lists[g])
        for g in s:
            lists[g].append(i)
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(rows))]


def brute_components(rows):
    sets, roots = brute_roots(rows)
    least = {}
    for (d, _), root in zip(rows, roots):
        if d is not None:
            least[root] = min(least.get(root, d), d)
    return Counter((d, len(s), least.get(root) if s else d) for (d, _), s, root in zip(rows, sets, roots))


@pytest.mark.parametrize("block_tokens", [1_500_000, 2_000])
def test_ngram_join(table, documents, block_tokens):
    df = table(documents, "doc_id long, text string")
    got = ngram_join.similar_documents(df, block_tokens=block_tokens).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute_components(documents)


@pytest.mark.parametrize("met", [1 << 20, 3])
def test_copies_emit_their_signatures_once_a_task(table, monkeypatch, met):
    monkeypatch.setattr(ngram_join, "MET", met)
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30 ", "zz ")
    rows = [(i, text) for i in range(3000)] + [(5000 + i, near) for i in range(3)] + [(6000 + i, f"own text number {i} of some") for i in range(300)]
    df = table(rows, "doc_id long, text string", files=2)
    got = ngram_join.similar_documents(df).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


@pytest.mark.parametrize("held, bucket", [(1_500_000, 1_500_000), (60, 500)])
def test_sets_without_shared_lists_leave(table, monkeypatch, held, bucket):
    """The sets that stay are those whose shared n-grams reach the bound, however the lists are combined and dealt."""
    monkeypatch.setattr(ngram_join, "HELD", held)
    rnd = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"w{rnd.randrange(1 << 40)}" for _ in range(40)) for _ in range(30)]  # share 58 of 98 n-grams
    texts += [texts[0].replace("p3 ", "zz "), texts[1][:-4], "a b", "A B", "a b c d", passage]
    sets = [grams(t) for t in texts]
    uses = Counter(g for s in set(sets) for g in s)
    want = {s for s in sets if 100 * sum(uses[g] > 1 for g in s) >= 90 * len(s)}
    assert 4 < len(want) < 10
    df = table([(i, t) for i, t in enumerate(texts)], "doc_id long, text string", files=3)
    keys = {}
    for s, t in zip(sets, texts):
        found, at = ngram_join.ngram_sets(*ngram_join.text_buffer(pa.array([t])))
        keys[int(ngram_join.as_long(ngram_join.set_keys(found, at))[0])] = (s, found.tobytes())
    once = df.sparkSession.createDataFrame([(k, b) for k, (_, b) in keys.items()], "key long, grams binary").repartition(3)
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    elements = sum(map(len, set(sets)))
    assert {keys[r.key][0] for r in ngram_join._possible(once, ngram_join._held_sets, elements, 90).collect()} == want
    # from texts a copy in another task may stay as well, never less
    assert want <= {keys[r.key][0] for r in ngram_join._possible(df.select("text"), ngram_join._text_sets(3), elements, 90).collect()}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_one_of_each_group_stays(table, documents, n, percent):
    rows = [(d, t, i) for i, (d, t) in enumerate(documents)]
    kept = ngram_join.keep_one(table(rows, "doc_id long, text string, rid int"), n=n, percent=percent).collect()
    sets, roots = brute_roots(documents, n, percent)
    assert Counter(roots[r.rid] for r in kept) == Counter(set(roots))  # rows without words are roots of their own


def test_groups_are_links_not_ids(table):
    """Unrelated texts without an id, or with the same one, are groups of their own."""
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4]), (None, texts[5]), (9, texts[5])]
    kept = ngram_join.keep_one(table(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])])


def test_signatures_meet():
    """Any two sets within the bound share a signature."""
    rnd = random.Random(3)
    for _ in range(600):
        a = {rnd.randrange(1 << 62) for _ in range(rnd.randint(1, 150))}
        b = set(list(a)[rnd.randint(0, max(1, len(a) // 9)):]) | {rnd.randrange(1 << 62) for _ in range(rnd.randint(0, max(1, len(a) // 9)))}
        if b and 100 * len(a & b) >= 90 * len(a | b):
            both = [np.sort(np.array(list(x), np.uint64)) for x in (a, b)]
            row, sig = ngram_join.signatures(np.concatenate(both), np.array([0, len(a), len(a) + len(b)]))
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


@pytest.mark.parametrize("percent", [80, 90])
def test_common_elements_bring_no_sets_together(spark, percent):
    """Every element is in six sets or so, few sets are alike: hardly two share a signature, and only the near copies stay."""
    rnd = np.random.default_rng(5)
    sets = [np.sort(rnd.choice(200_000, 400, replace=False)) for _ in range(3000)]
    sets.append(np.unique(np.concatenate([sets[0][10:], rnd.choice(200_000, 10)])))
    grams_of = [ngram_join.mix64(x.astype(np.uint64)) for x in sets]
    for x in grams_of:
        x.sort()
    at = np.concatenate([[0], np.cumsum([len(x) for x in grams_of])])
    row, sig = ngram_join.signatures(np.concatenate(grams_of), at, percent)
    met = defaultdict(set)
    for r, x in zip(row.tolist(), sig.tolist()):
        met[x].add(r)
    assert {0, 3000} in met.values() and len({frozenset(m) for m in met.values() if len(m) > 1}) < 1000
    once = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(grams_of)], "key long, grams binary").repartition(3)
    elements = int(at[-1])
    assert ngram_join._possible(once, ngram_join._held_sets, elements, percent).count() == 3001  # by n-grams all may have a partner
    signed = ngram_join._signed_sets(ngram_join._held_sets, percent)
    assert {r.key for r in ngram_join._possible(once, signed, elements, percent).collect()} == {0, 3000}


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_partners_share_as_many_signatures_as_needed(percent):
    """Each of two sets within the bound, at a level of both, has the signatures that it needs among those of the other."""
    rnd = random.Random(9)
    pairs = 0
    for _ in range(1500):
        n = rnd.choice([1, 2, 5, 9, 20, 60, 200, 400])
        a = {rnd.randrange(1 << 62) for _ in range(rnd.randint(max(1, n // 2), n))}
        most = int(len(a) * (100 - percent) / 100)
        b = set(list(a)[rnd.randint(0, most):]) | {rnd.randrange(1 << 62) for _ in range(rnd.randint(0, most))}
        if not b or 100 * len(a & b) < percent * len(a | b):
            continue
        pairs += 1
        both = [np.sort(np.array(list(x), np.uint64)) for x in (a, b)]
        row, sig = ngram_join.signatures(np.concatenate(both), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())

        def read(_, both=both):
            yield np.arange(2), np.concatenate(both), np.array([0, len(a), len(a) + len(b)])

        found = {0: [], 1: []}
        for keys, signature, at, needed in ngram_join._signed_sets(read, percent)([]):
            for i, k in enumerate(keys.tolist()):
                found[k].append((set(signature[at[i]:at[i + 1]].tolist()), int(needed[i])))
        for k in (0, 1):
            assert any(len(own & other) >= needed for own, needed in found[k] for other, _ in found[1 - k])
    assert pairs > 300


def test_rows_are_marked_where_they_lie(spark, table):
    """Every wanted row is marked and hardly another; only rows that may go are moved."""
    rids = ngram_join.written(spark.range(0, 40_000, 4).withColumnRenamed("id", "rid"), "test-rids")
    marks = ngram_join._marks(rids, "test-marks")
    marked = ngram_join._marked(spark.range(200_000).withColumnRenamed("id", "rid"), marks)
    assert "hashpartitioning" not in marked._jdf.queryExecution().toString()
    rows = {r.rid: r._marked for r in marked.collect()}
    assert len(rows) == 200_000 and all(rows[i] for i in range(0, 40_000, 4)) and sum(rows.values()) < 30_000
    none = ngram_join._marks(rids.where("rid < 0"), "test-marks")
    assert not any(r._marked for r in ngram_join._marked(rids, none).collect())
    own = " ".join(f"w{i}" for i in range(50))
    kept = ngram_join.keep_one(table([(i, own if i % 9 == 0 else f"text {i} of its own and no other {i}") for i in range(900)], "doc_id long, text string"))
    rows = [r.doc_id for r in kept.collect()]
    assert sorted(rows) == [0, *(i for i in range(900) if i % 9)]


def test_search_equals_counting():
    rnd = random.Random(5)
    pool = list(range(400))
    base = [set(rnd.sample(pool, 80)) for _ in range(4)]
    sets = [np.sort(np.array(list((s - set(rnd.sample(sorted(s), rnd.randint(0, 9)))) | set(rnd.sample(pool, rnd.randint(0, 6)))), np.uint64))
            for s in base for _ in range(25)]
    lists = ngram_join.Lists(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(set(q) & set(s)) >= 90 * len(set(q) | set(s))]
        assert sorted(lists.search(q).tolist()) == want


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    looped = {x for e in edges for x in e if e[0] != e[1]}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {x: find(x) for x in looped}


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeated_bytes, fm_dedup.remove_repeated_passages, ngram_join.similar_documents])
def test_empty_table_and_clashing_columns(spark, table, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c", 5, "z", 1.0), (2, None, None, None, None)]
    df = table(rows, "doc_id long, text string, rid int, key string, n_units double")
    assert {r["doc_id"] for r in run(df).collect()} == {1, 2}
