import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import components, near_dups, quality, suffixes

WORDS = [f"w{i}" for i in range(300)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
def test_repeat_words(words):
    raw = [w.encode() for w in words]
    windows = Counter(tuple(raw[i : i + 5]) for i in range(len(raw) - 4))
    covered = {i + k for i in range(len(raw) - 4) if windows[tuple(raw[i : i + 5])] > 1 for k in range(5)}
    assert quality.repeat_words(raw) == len(covered)


def test_repeat_words_of_many_distinct():
    raw = [b"%d" % i for i in range(40_000)]
    assert quality.repeat_words(raw) == 0
    assert quality.repeat_words(raw + raw[:5]) == 10


def test_base_rules(spark, documents):
    docs = documents(
        (1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g h i"), (5, "Ab#c <d> e f g h i j k é"), (6, "x y\nx y\n\n\nx y\nz q"),
        (7, "one two three four five " * 4), (8, "a b " * 3),
    )
    got = {r.doc_id: r for r in quality.op7_query(docs).collect()}
    five, six = got[5], got[6]
    assert (five.n_words, five.word_chars, five.n_symbols, five.base_failed) == (10, 15, 3, False)
    assert (six.n_words, six.n_dup_lines) == (8, 2) and six.base_failed
    assert got[7].n_repeat_words == 20 and got[7].base_failed and got[8].n_words == 3
    assert all(got[i].n_words == 0 and not got[i].kept for i in (1, 2, 3))
    assert got[5].kept  # too few documents for an estimate
    assert quality.op7_query(docs.limit(0)).count() == 0
    whole = quality.apply_rules(docs.selectExpr("*", "1 AS kept", "2 AS n_words"))
    assert "extra" in whole.columns and whole.count() == 8


def test_outliers_go_and_clean_documents_stay(documents):
    rng = random.Random(3)
    clean = [(i, ". ".join(prose(i * 50 + k, 12) for k in range(rng.randrange(2, 40))), f"s{i % 2}") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i, 80).split()), "s0") for i in range(60)]
    junk += [(2000 + i, prose(i, 90).upper().replace(" ", "!! "), "s1") for i in range(40)]
    got = {r.doc_id: r.kept for r in quality.op7_query(documents(*clean, *junk)).collect()}
    assert not any(got[i] for i, *_ in junk) and all(got[i] for i, *_ in clean)


def test_final_estimate_equals_numpy(spark, documents):
    docs = documents(*[(i, ". ".join(prose(i * 9 + k, 9 + i % 5) for k in range(2 + i % 17))) for i in range(200)])
    stats = quality.with_statistics(docs).drop("text", "extra").cache()
    x = np.array([r.x for r in stats.collect()]) / quality.UNIT
    middle = np.median(np.sort(x, axis=0), axis=0)
    model = quality.fit(stats).shapes.first()
    inverse = np.array(model.shape.inverse).reshape(quality.P, -1)
    assert np.abs(np.array(model.shape.centre) - middle).max() < 0.1
    assert (np.linalg.eigvalsh(inverse) > 0).all() and np.allclose(inverse, inverse.T)
    near = quality.chi2_quantile(0.025, quality.P)
    assert quality.chi2_above(near, 6) == pytest.approx(0.025) and near == pytest.approx(14.449, abs=1e-3)


def linked(docs):
    sets = {i: frozenset(near_dups.shingles(near_dups.words_of((t or "").encode()))) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(documents, monkeypatch):
    rng = random.Random(5)
    docs = []
    for base in range(12):
        words = prose(base, rng.randrange(30, 200)).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            docs.append((len(docs), " ".join(copy)))
    passage = prose(99, 60)
    docs += [(len(docs) + i, f"{prose(1000 + i, 25)} {passage} {prose(2000 + i, 25)}") for i in range(60)]
    docs += [(900, None), (901, ""), (902, " "), (903, "one two"), (904, "ONE  two"), (905, "one"), (906, docs[0][1].upper())]
    want = linked(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(documents(*docs)).collect()}
    assert got == want
    monkeypatch.setattr(near_dups, "PART", 4)  # buckets in tiles
    tiled = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(documents(*docs)).collect()}
    assert tiled == want


def test_near_duplicate_edges(documents):
    text = prose(1, 50)
    docs = documents((5, text), (5, text), (3, text), (None, text), (7, "a" * 200_000))
    rows = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dups.op10_query(docs).collect())
    assert rows == [("3", 46, 3, True), ("5", 46, 3, False), ("5", 46, 3, False), ("7", 1, 7, True), ("None", 46, None, True)]
    assert near_dups.op10_query(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 10**6), min_size=1, max_size=60), st.sets(st.integers(0, 10**6), max_size=60))
def test_bitmaps_never_differ_in_more_bits_than_sets(a, b):
    one, two = (near_dups._mixed(np.array(sorted(s), np.uint64)) for s in (a, b))
    x, y = (np.frombuffer(near_dups.parity(v, near_dups.SET_BITS), np.uint64) for v in (one, two))
    assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def test_odd_sketches_estimate_the_similarity():
    rng = np.random.default_rng(2)
    values = near_dups._mixed(rng.integers(0, 2**60, 2000, dtype=np.uint64))
    a, b = values[:1900], values[100:]  # 1800 of 2000 in common
    parts = []
    for s in (a, b):
        least = near_dups.min_hashes(s)
        parts.append(np.frombuffer(near_dups.parity(near_dups._mixed(least + near_dups._SAMPLE * near_dups._PRIME), near_dups.SAMPLE_BITS), np.uint64))
    odd = int(np.bitwise_count(parts[0] ^ parts[1]).sum())
    bits = near_dups.SAMPLE_BITS
    estimate = 1 - (-bits / 2 * np.log(1 - 2 * odd / bits)) / (2 * near_dups.SAMPLES)
    assert estimate == pytest.approx(0.9, abs=0.1)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame([*path, *star, (7, 7), (1, 0)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components.components(links.limit(0)).count() == 0


def removed(docs):
    """Mask of the bytes to remove per row, by brute force."""
    rows = [(i, (t or "").encode()) for i, t in docs]
    seen = {}
    for i, text in rows:
        if i is not None:
            for k in range(len(text) - 49):
                seen[text[k : k + 50]] = min(seen.get(text[k : k + 50], i), i)
    masks = []
    for i, text in rows:
        mask = np.zeros(len(text), bool)
        for k in range(len(text) - 49):
            if i is not None and seen[text[k : k + 50]] < i:
                mask[k : k + 50] = True
        masks.append(mask)
    return rows, masks


def digests(docs):
    out = []
    for (i, text), mask in zip(*removed(docs), strict=True):
        kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
        spans = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        out.append((i, len(text), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(documents, monkeypatch):
    rng = random.Random(8)
    passages = [prose(i, 30) for i in range(6)] + ["é" * 80, "ab" * 70, " " * 90]
    docs = []
    for i in range(70):
        parts = [prose(100 + i, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 25)
            parts += [p[cut : len(p) - rng.randrange(0, 25)], prose(rng.randrange(10_000), rng.randrange(0, 9))]
        docs.append((rng.randrange(1000), "".join(parts)))
    docs += [(2000, docs[0][1]), (2001, docs[0][1]), (2002, None), (2003, ""), (2004, "x" * 49), (2005, "x" * 50), (2006, "x" * 51)]
    docs += [(None, docs[1][1]), (2007, "y" * 3000), (2008, "y" * 2999), (docs[3][0], docs[3][1])]
    for piece, batch in ((suffixes.PIECE, suffixes.BATCH), (333, 2000)):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        monkeypatch.setattr(suffixes, "BATCH", batch)
        frame = documents(*docs)
        made = suffixes.with_removed(frame, "n long, removed long, spans long, kept string", suffixes._digest, 2000, 900)
        got = sorted((tuple(r) for r in made.collect()), key=str)
        assert got == digests(docs)


def test_cut_texts_stay_valid(documents):
    shared = "ü" * 60 + prose(1, 20)
    docs = [(1, "Anfang " + shared), (2, "é" + shared + "Ende ü"), (3, shared), (4, None), (5, "kurz")]
    got = {r.doc_id: r for r in suffixes.without_repeats(documents(*docs)).collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].text == "éEnde ü" and got[2].n_chars == 7
    assert got[1].text == docs[0][1] and got[4].text is None and got[2].extra == {"k": "v"}
    assert suffixes.op5_query(documents(*docs).limit(0)).count() == 0


def test_filtered_stages_call_python_once_a_text(documents):
    """A second call in a task holds a second Python worker, which stays for the stages after."""
    docs = documents(*[(i, prose(i, 40)) for i in range(3)], (None, prose(9, 40)))
    for stage in (quality.apply_rules(docs).where("kept"), suffixes.without_repeats(docs)):
        assert stage._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
