"""Fill-in-middle, vector codes and the Jaccard join: against plain versions, and odd rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from upswell.llm import common, fim, pq, setjoin

MIXED = st.text(st.sampled_from("ab\n<PSM>é漢😀"), max_size=60)


def plain_fim(doc_id, text, unit="line"):
    """(n, form, prefix_chars, middle_chars, output) over Python's own code points."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.MARKERS):
        return len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(MIXED, st.data())
def test_the_exception_index_converts_cuts(text, data):
    index, cut = fim.ExceptionIndex(np.frombuffer(text.encode(), np.uint8)), data.draw(st.integers(0, len(text)))
    at = len(text[:cut].encode())
    assert index.bytes(np.array([cut])).tolist() == [at] and index.chars(np.array([at])).tolist() == [cut]
    assert len(index.byte_at) == sum(ord(c) > 127 for c in text)


@settings(max_examples=100, deadline=None)
@given(st.lists(MIXED, max_size=6), st.sampled_from(["line", "char"]))
def test_cuts_of_several_texts(texts, unit):
    found = fim.cut_texts(list(range(len(texts))), [t.encode() for t in texts], unit, 7)
    for i, t in enumerate(texts):
        n, form, prefix, middle, _ = plain_fim(i, t, unit)
        assert found[0][i] == n and (form == "plain" or (found[3][i], found[4][i] - found[3][i]) == (prefix, middle))


FIM_ROWS = [(1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "é\n漢字\n\n😀 end"), (5, "é\n漢字\n\n😀 end"), (None, "no\nid\n"), (6, "a <M> b\nc"),
            (7, "x" * 300_000 + "\n" + "é\n" * 100_000), *[(i, f"a\nb{i}\né\n<\nS>\n<S\n") for i in range(20, 40)]]


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_in_middle(make_docs, monkeypatch, unit):
    monkeypatch.setattr(fim, "SLICE_BYTES", 40)
    docs = make_docs(FIM_ROWS)
    found = fim.restore(fim.fill_in_middle(docs, unit=unit)).collect()
    expected = sorted(((d, *plain_fim(d, t or "", unit)) for d, t in FIM_ROWS), key=str)
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in found), key=str) == expected
    assert sorted(r["restored"] for r in found) == sorted(t or "" for _, t in FIM_ROWS)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(make_docs([])).count() == 0
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="word")


def test_fill_in_middle_query(query, sf_docs):
    found = query("op11_fill_in_middle", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    for d, t in sf_docs:
        *plain, output = plain_fim(d, t or "")
        assert found[d] == (*plain, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def plain_codes(rows, n_parts=4, entries=256, rounds=4):
    """rows: (vec_id, label, vector), kept ones. [(vec_id, code, error, label_error)] and the codebooks' digest."""
    rows = sorted(((i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2])
    cuts = [width * i // n_parts for i in range(n_parts + 1)]
    parts = [[r[2][a:b] for r in rows] for a, b in itertools.pairwise(cuts)]
    books = [[list(x) for x in p[:entries]] for p in parts]

    def assign(p, book):
        return [min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(book)) for v in p]

    for _ in range(rounds):
        for p, book in zip(parts, books):
            of = {}
            for v, (_, k) in zip(p, assign(p, book)):
                of.setdefault(k, []).append(v)
            for k, vs in of.items():
                book[k] = [sum(c) // len(vs) for c in zip(*vs)]
    best = [assign(p, book) for p, book in zip(parts, books)]
    error = [sum(b[i][0] for b in best) for i in range(len(rows))]
    total = {}
    for (_, label, _), e in zip(rows, error):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{b[i][1]:02x}" for b in best), error[i], total[r[1]]) for i, r in enumerate(rows)), key=str), digest


VECTORS = "vec_id long, label int, embedding array<float>, _rid string, v int, code string, `a.b` string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], VECTORS)


def codes(df):
    found = df.collect()
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in found), key=str), {r["codebooks_sha256"] for r in found}


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(pq, "RUN", 8)
    rng = random.Random(3)
    good = [(rng.randrange(400) if i % 50 else None, rng.choice([None, 1, 2]), [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(10)])
            for i in range(500)]
    good = [(i, label, np.array(v, np.float32).tolist()) for i, label, v in good] + [(399, 2, [0.0] * 10)] * 40
    bad = [(900, 1, None), (901, 1, []), (902, 1, [None] * 10), (903, 1, [math.nan] * 10), (0, 1, [math.inf] * 10), (904, 1, [1.0] * 9)]
    expected, digest = plain_codes(good)
    assert codes(pq.compress(vectors(spark, good + bad))) == (expected, {digest})
    expected, digest = plain_codes(good[:9], entries=4, rounds=2)
    assert codes(pq.compress(vectors(spark, good[:9]), entries=4, rounds=2)) == (expected, {digest})
    assert pq.compress(vectors(spark, [])).count() == 0 and pq.compress(vectors(spark, bad[:5])).count() == 0


def test_components_beyond_the_bound_count_as_the_bound(spark):
    kept = pq.kept_vectors(vectors(spark, [(1, 1, [1e30, -1e30, 0.5, 65536.0])])).collect()
    assert kept[0]["v"] == [pq.BOUND, -pq.BOUND, 512, pq.BOUND]
    found, _ = codes(pq.compress(vectors(spark, [(1, 1, [1e30, 0.5]), (2, 1, [0.5, 0.5])])))
    assert [x[2] for x in found] == [0, 0] and found[0][1] != found[1][1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=60), st.lists(
    st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(1, 9))
def test_the_trie_finds_the_nearest_entry(parts, entries, run):
    parts, _ = pq._sorted_distinct(np.array(parts))
    old, pq.RUN = pq.RUN, run
    try:
        code, error = pq.nearest(parts, np.array(entries))
    finally:
        pq.RUN = old
    d = ((parts[:, None, :] - np.array(entries)[None]) ** 2).sum(2)
    assert code.tolist() == d.argmin(1).tolist() and error.tolist() == d.min(1).tolist()


def test_vector_codes_query(spark):
    import __spark_entry__

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    expected, digest = plain_codes([(i, label, v) for i, label, v in rows], rounds=4)
    assert codes(__spark_entry__.queries()["op12_vector_codes"](spark, "/root/testdata/sf0.001")) == (expected, {digest})


def plain_join(docs, percent=85):
    """[(doc_id, n_shingles, component)], rows compared pair by pair."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def joined(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in df.collect()), key=str)


def near_copies(words):
    """A large group of near copies with chains at the threshold, a passage in many texts, copies, and odd rows."""
    rng, out = random.Random(8), []
    base = [f"w{i}" for i in range(words)]
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        out.append((i, " ".join(w)))
    passage = " ".join(f"common{i}" for i in range(30))
    out += [(100 + i, f"{passage} " + " ".join(f"own{i}_{j}" for j in range(rng.choice([3, 4, 5, 40])))) for i in range(60)]
    chain = [f"c{i}" for i in range(60)]
    out += [(300 - i, " ".join(chain[i:i + 40])) for i in range(12)]
    return out + [(400, None), (401, ""), (402, " \n"), (None, "A b C"), (403, "a B c"), (403, "a b c"), (404, "a b"), (None, None), (405, "a b c d"),
                  (406, "A B C D"), (407, "a b c d a b c d a b c d"), (408, " ".join(base * 100)), (409, " ".join(base * 100) + " tail")]


@pytest.mark.parametrize("group, split, words", [(512, 65_536, 120), (6, 65_536, 120), (10, 50, 24)])
def test_jaccard_components(make_docs, monkeypatch, group, split, words):
    monkeypatch.setattr(setjoin, "GROUP", group)
    monkeypatch.setattr(setjoin, "SPLIT", split)
    monkeypatch.setattr(setjoin, "SPLIT_BLOCK", 20)
    monkeypatch.setattr(setjoin, "STAR", 16)
    monkeypatch.setattr(common, "HEAVY_ROWS", 8)
    rows = near_copies(words)
    assert joined(setjoin.jaccard_components(make_docs(rows))) == plain_join(rows)


def test_jaccard_components_of_no_or_wordless_rows(make_docs):
    assert setjoin.jaccard_components(make_docs([])).count() == 0
    assert joined(setjoin.jaccard_components(make_docs([(2, ""), (1, None)]))) == [(1, 0, 1), (2, 0, 2)]


def test_jaccard_join_query(query, sf_docs):
    found = query("op13_jaccard_join", "n_shingles", "component_id")
    expected = {d: (n, c) for d, n, c in plain_join(sf_docs)}
    assert found == expected and any(c != d for d, (_, c) in expected.items())


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=30), st.sets(st.integers(0, 40), min_size=1, max_size=30), st.integers(0, 2**32))
def test_similar_sets_share_a_prefix_shingle_under_every_order(a, b, seed):
    b = a ^ set(list(b)[:len(a) // 8])
    rng = np.random.default_rng(seed)
    names, classes = rng.integers(0, 2**64, 50, np.uint64), rng.integers(0, 5, 1 << setjoin.SKETCH_BITS).astype(np.uint8)
    cut = [setjoin.prefixes(np.sort(names[sorted(x)]), classes, 85) for x in (a, b) if x]
    if len(cut) == 2 and 100 * len(a & b) >= 85 * len(a | b):
        assert all(set(p.tolist()) & set(q.tolist()) for p, q in zip(*cut))


def test_only_classes_of_pairs_are_sent_to_a_meeting(spark):
    data = spark.range(20_000).selectExpr("(id << 33) - 7 as cid", "id as more")
    pairs = spark.range(150).selectExpr("((id * 131) << 33) - 7 as a", "((id * 7 + 1) << 33) - 7 as b")
    wanted = {r[c] for r in pairs.collect() for c in "ab"}
    found = [(r["cid"], r["more"]) for r in setjoin._needed(data, pairs).collect()]
    assert len(set(found)) == len(found) and all(c == (m << 33) - 7 for c, m in found)
    assert wanted <= {c for c, _ in found} and len(found) < 2 * len(wanted)
    assert setjoin._needed(data, pairs.limit(0)).count() == 0


def sets_of_numbers(seed, n, changed):
    """Two sets of n random 64-bit numbers that differ in ``changed`` of them."""
    tokens = np.random.default_rng(seed).integers(0, 2**64, n + changed, np.uint64)
    return np.sort(tokens[:n]), np.sort(tokens[changed:])


@pytest.mark.parametrize("n, changed", [(1, 0), (9, 0), (30, 2), (100, 8), (500, 40), (6000, 480)])
def test_similar_sets_pass_the_bounds_from_parity_bits(n, changed):
    for seed in range(60):
        x, y = sets_of_numbers(seed, n, changed)  # n - changed shingles of n + changed are common, 85 % or more
        odds = [[np.array([w]) for w in setjoin.odd_sketch(t)] for t in (x, y)]
        assert setjoin._may_link(np.array([n]), np.array([n]), np.array([n]), *odds, 85).all()
        a, b = ({"n": n, "sketch": setjoin.long_sketch(t).tobytes()} for t in (x, y))
        assert setjoin._close(85)()(a)(b)


def test_a_pair_whose_sketches_differ_in_a_sign_bit_is_listed():
    import pyarrow as pa

    common = sets_of_numbers(3, 200, 0)[0]
    y = np.sort(np.append(common, np.uint64(56 << 20)))  # bit 56 is the sign bit of the sketch's first word
    odds = [setjoin.odd_sketch(t) for t in (common, y)]
    assert odds[0][0] ^ odds[1][0] < 0
    columns = [[5, 5], [1, 2], [1, 2], [200, 201], [1, 1], *zip(*odds)]
    rows = pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in columns], names=[f"c{i}" for i in range(9)])
    assert [tuple(r.values()) for b in setjoin._list_pairs(85)(iter([rows])) for r in b.to_pylist()] == [(1, 2)]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.integers(0, 400), st.integers(0, 2**32))
def test_long_sketches_never_differ_in_more_than_the_sets(n, m, common, seed):
    common = min(common, n, m)
    tokens = np.random.default_rng(seed).integers(0, 2**64, n + m - common, np.uint64)
    x, y = setjoin.long_sketch(tokens[:n]), setjoin.long_sketch(tokens[n - common:])
    assert setjoin.sketches_differ(x, y) == setjoin.sketches_differ(y, x) <= n + m - 2 * common
    assert 2 * n <= max(64, 64 * len(x)) and 64 * len(x) <= max(64, 4 * n)


def test_texts_are_sent_to_a_meeting_for_close_pairs_only(make_docs, monkeypatch):
    met, plain = [], setjoin._meet
    docs = [(i, " ".join(f"part{k % 60}_{j}" for k in (i, i + 1) for j in range(100))) for i in range(60)]  # neighbours share a half
    docs += [(100 + i, " ".join([f"copy{i % 9}_{j}" for j in range(300)] + [f"end{i}"])) for i in range(18)]

    def counted(pairs, data, columns, check):
        met.append((columns, pairs.count()))
        return plain(pairs, data, columns, check)

    monkeypatch.setattr(setjoin, "_meet", counted)
    assert joined(setjoin.jaccard_components(make_docs(docs))) == plain_join(docs)
    assert sum(n for c, n in met if "text" not in c) > 40
    assert 9 <= sum(n for c, n in met if "text" in c) < 20
