import random

import numpy as np

from postlane.llm import passages as P

SF = "/root/testdata/sf0.01"


def covered_words(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_every_exact_repeat_of_fifty_words_is_found(spark):
    docs = sorted((r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    seen, repeats = {}, {}
    for d, w in docs:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if seen.setdefault(key, d) != d:
                repeats.setdefault(d, set()).update(range(i, i + 50))
    got = covered_words(P.passages(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert len(repeats) > 50
    assert [d for d in repeats if not repeats[d] <= got.get(d, set())] == []


def test_every_passage_is_similar(spark):
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for r in P.passages(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        a, b = grams(words[r.doc_id][r.start_word : r.end_word]), grams(words[r.source_doc_id][r.source_start : r.source_end])
        assert r.source_doc_id < r.doc_id and r.end_word - r.start_word >= 50
        assert len(a & b) >= 0.8 * len(a | b) - 1e-9


def brute_windows(h, t):
    out = set()
    for c in range(len(h)):
        left = c
        while left > 0 and h[left - 1] > h[c]:
            left -= 1
        right = c
        while right + 1 < len(h) and h[right + 1] >= h[c]:
            right += 1
        if right - left + 1 >= t:
            out.add((c, left, right))
    return out


def test_compact_windows_equal_brute_force():
    import numpy as np

    rng = random.Random(3)
    for t in (1, 2, 5, 8):
        seqs = [[rng.randrange(1, 30) for _ in range(n)] for n in (40, t, 23, 60)]
        first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
        got = set(zip(*(x.tolist() for x in P.compact_windows(np.array(sum(seqs, []), np.uint64), first, t))))
        want = {(c + b, left + b, right + b) for s, b in zip(seqs, first[:-1].tolist()) for c, left, right in brute_windows(s, t)}
        # Of equal minima a later one may head its own shorter window too; none that a passage needs is missing.
        assert want <= got


def test_edited_passages_hot_passages_and_odd_rows(spark):
    rng = random.Random(4)
    new = lambda n: [f"n{rng.randrange(10**7)}" for _ in range(n)]
    p = new(80)
    edited = [*p[:60], "edit", *p[61:]]
    rows = [(i, " ".join([*new(30), *p, *new(25)])) for i in range(40)] + [(50, " ".join([*new(10), *edited, *new(9)])), (51, " ".join([*new(20), *p[:45], *new(20)]))]
    rows += [(60, None), (61, ""), (None, " ".join(p)), (62, " ".join(new(20_000)))]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, hub int")
    got = covered_words(P.passages(df).collect())
    assert set(got) == {*range(1, 40), 50}
    assert all(set(range(30, 110)) <= got[i] and len(got[i]) <= 92 for i in range(1, 40)) and set(range(10, 90)) <= got[50]
    assert P.passages(df.limit(0)).count() == 0
    left = {r.doc_id: r.text for r in P.without_passages(df, P.passages(df)).collect()}
    assert left[0].split()[30:110] == p and len(left[5].split()) == 55 and left[60] is None and left[61] == ""


def test_verified_takes_any_sequences():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(3000):
        kinds = int(rng.integers(1, 40))
        x, hub = (rng.integers(0, kinds, int(rng.integers(1, 120))).astype("<u4") for _ in range(2))
        if rng.random() < 0.5:
            hub = np.concatenate([hub, x[int(rng.integers(0, len(x))) :], hub[:9]])
        for a, b, c, d, sim in P.verified(x, hub, 10, 80):
            own, theirs = set(x[a : b + 1].tolist()), set(hub[c : d + 1].tolist())
            assert b - a + 1 >= 10 and sim == len(own & theirs) / len(own | theirs) >= 0.8


def test_passages_with_edits_of_several_words():
    import numpy as np

    from postlane.llm import text

    rng = random.Random(8)
    new = lambda n: [f"n{rng.randrange(10**7)}" for _ in range(n)]
    memo = text.Words()
    seq = lambda w: (text.shingles(memo.hashes(" ".join(w)), P.SHINGLE) >> np.uint64(32)).astype("<u4")
    p = new(80)
    q = new(120)
    cases = [(p, [*p[:39], *new(2), *p[41:]]), (p, [*p[:40], *new(2), *p[40:]]), (q, [*q[:58], *new(5), *q[63:]]), (q, [*q[:40], *new(2), *q[42:80], *new(2), *q[82:]])]
    for original, edited in cases:
        x, hub = seq([*new(30), *edited, *new(20)]), seq([*new(10), *original, *new(25)])
        found = P.verified(x, hub, 46, 80)
        assert [(a, b + P.SHINGLE) for a, b, *_ in found] == [(30, 30 + len(edited))], found
    # Two short runs that too much parts stay apart.
    assert P.verified(seq([*p[:35], *new(30), *p[45:]]), seq(p), 46, 80) == []


def test_verification_counts_by_sorts(monkeypatch):
    """numpy's hashing `unique` took four fifths of the time; results are as by sets."""
    rng, calls = np.random.default_rng(5), []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **b: calls.append(1) or unique(*a, **b))
    for edits in (0, 5, 20, 60):
        hub = rng.integers(0, 300, 300).astype("<u4")
        x = hub.copy()
        x[rng.choice(300, edits, False)] = rng.integers(1000, 2000, edits)
        calls.clear()
        for a, b, c, d, similarity in P.verified(x, hub, 46, 80):
            own, theirs = set(x[a : b + 1].tolist()), set(hub[c : d + 1].tolist())
            assert similarity == len(own & theirs) / len(own | theirs) >= 0.8
        assert len(calls) <= 1


def test_a_passage_of_two_lines_that_many_documents_hold_apart(spark):
    """Neither the first document nor the one before shares more than single lines with the last two; found only if these two meet."""
    rng = random.Random(11)
    new = lambda n: [f"n{rng.randrange(10**7)}" for _ in range(n)]
    for edit in ([], ["edit"]):
        lines = [new(35), new(35)]
        apart = lambda: [*new(20), *lines[0], *new(20), *lines[1], *new(20)]
        whole = [*new(15), *lines[0], *lines[1], *new(15)]
        rows = [(i, " ".join(apart())) for i in range(12) if i != 5] + [(5, " ".join(whole)), (20, " ".join([*new(9), *lines[0], *edit, *lines[1], *new(9)]))]
        got = covered_words(P.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
        assert set(got) == {20} and set(range(9, 79 + len(edit))) <= got[20]


def test_a_hub_that_repeats_a_line_is_met_at_every_place(spark):
    rng = random.Random(12)
    new = lambda n: [f"n{rng.randrange(10**7)}" for _ in range(n)]
    line, ends = new(36), (new(8), new(8))
    hub = [*new(30), *line, *new(30), *ends[0], *line, *ends[1], *new(30), *line, *new(30)]
    df = spark.createDataFrame([(0, " ".join(hub)), (1, " ".join([*new(20), *ends[0], *line, *ends[1], *new(20)]))], "doc_id bigint, text string")
    assert covered_words(P.passages(df).collect()) == {1: set(range(20, 72))}


def test_partners_leave_out_only_what_another_one_has():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n, wide = 60, 11
        value, doc = np.sort(rng.integers(0, 4, n)), rng.integers(0, 25, n)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        around = rng.integers(1, 7, (n, wide)).astype(np.uint32)
        there = np.abs(np.arange(wide) - 5) <= rng.integers(2, 6, n)[:, None]
        around[~there] = 0
        around[:, 5] = 99
        has = lambda x, y: ({(p, int(around[x, p])) for p in range(wide) if there[x, p] and there[y, p] and around[x, p] == around[y, p]})
        whole = list(zip(*(a.tolist() for a in P.partners(value, doc, around, there))))
        assert set(whole) == set(zip(*(a.tolist() for a in P.partners(value, doc, around, there, 50)))) and len(whole) == len(set(whole))
        met = {}
        for x, y in whole:
            assert value[x] == value[y] and doc[y] < doc[x]
            met.setdefault(x, []).append(y)
        for x in range(n):
            for y in range(n):
                if value[x] == value[y] and doc[y] < doc[x] and y not in met[x]:
                    assert any(z < y and has(x, y) <= has(x, z) for z in met[x])


def test_rows_do_not_depend_on_how_documents_are_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [sorted(map(tuple, P.passages(docs.repartition(n, "text")).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_verification_finds_every_stretch_between_edits():
    """A long near copy whose edits are too many for the whole: a part that is similar enough was cut at the widest gap and lost."""
    hub = np.arange(1, 400, dtype="<u4")
    x = hub.copy()
    for hole in (114, 121, 195, 231, 256, 275, 312, 330, 345, 360, 380):
        x[hole : hole + 5] = 10_000 + np.arange(hole, hole + 5)
    found = P.verified(x, hub, 46, 80)
    shared, covered = np.flatnonzero(x == hub), set()
    for a, b, c, d, similarity in found:
        assert similarity == len(set(x[a : b + 1].tolist()) & set(hub[c : d + 1].tolist())) / len(set(x[a : b + 1].tolist()) | set(hub[c : d + 1].tolist()))
        covered |= set(range(a, b + 1))
    for lo in shared.tolist():
        for hi in shared[shared >= lo + 45].tolist():
            both = int(((shared >= lo) & (shared <= hi)).sum())
            if 100 * both >= 80 * (2 * (hi - lo + 1) - both):
                assert set(range(lo, hi + 1)) <= covered


def test_windows_search_no_farther_than_their_own_text():
    """Staircases, ties and many short texts, against the plain search; before, each centre was a step of a Python loop."""
    import sys

    rng = np.random.default_rng(9)
    for kind in range(4):
        sizes = rng.integers(3, 400, 60)
        first = np.concatenate([[0], np.cumsum(sizes)])
        h = rng.integers(1, [4, 40, 2**63, 300][kind], first[-1]).astype(np.uint64)
        if kind == 3:
            h = np.concatenate([np.sort(h[a:b])[:: 1 if a % 2 else -1] for a, b in zip(first[:-1], first[1:])])
        steps = []
        sys.settrace(lambda frame, *_: (lambda *_: steps.append(1)) if frame.f_code.co_filename == P.__file__ else None)
        try:
            got = set(zip(*(x.tolist() for x in P.compact_windows(h, first, 3))))
        finally:
            sys.settrace(None)
        want = {(c + b, left + b, right + b) for b, e in zip(first[:-1].tolist(), first[1:].tolist()) for c, left, right in brute_windows(h[b:e].tolist(), 3)}
        assert want <= got and len(got) > 1000
        assert len(steps) < 2 * len(got)


def test_pairs_travel_packed_by_document(spark):
    """One row for a bucket of pairs, not one for each pair; nothing is lost on the way, and a document's pairs stay together."""
    rng = random.Random(13)
    p = [f"n{rng.randrange(10**7)}" for _ in range(90)]
    docs = spark.createDataFrame([(i, " ".join([f"x{i}", *p, f"y{i}"])) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    met = P._met(P._windows(docs, 46, 5), 5).filter("pairs is not null").collect()
    (n,) = {len(r.pairs) % sum(np.dtype(k).itemsize for k in P._PAIR) for r in met}
    columns = [np.concatenate(c) for c in zip(*(P._unpacked(bytes(r.pairs), P._PAIR) for r in met))]
    buckets = {}
    for r in met:
        for x in P._unpacked(bytes(r.pairs), P._PAIR)[0].tolist():
            buckets.setdefault(x, set()).add(r.bucket)
    assert n == 0 and len(columns[0]) > 5 * len(met) and set(columns[0].tolist()) == set(range(1, 60)) and (columns[1] < columns[0]).all()
    assert all(len(b) == 1 for b in buckets.values())


def test_sequences_of_many_texts_at_once():
    from postlane.llm import text

    memo = text.Words()
    texts = [None, "", " \t", "a", "A b", " a b c d e\n", "a\tb\x0bc\x0cd\re\nf g", "É b  c d e f", "x\x1cy b c d e f g", "b " * 30]
    for k in (1, 3, 5):
        for lo, hi in ((0, 1), (0, 3), (3, 10), (0, 10)):
            flat, first = text.sequences(texts[lo:hi], k)
            for i in range(lo, hi):
                assert np.array_equal(flat[first[i - lo] : first[i - lo + 1]], text.shingles(memo.hashes(texts[i]), k))
