"""Phrases: against a plain Python version, tries against dictionaries, odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import phrases as m

SCHEMA = "doc_id long, lang string, text string, a long, phrase string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, 1, "x", 2) for i, (lang, text) in enumerate(rows)], SCHEMA)


def counts(rows):
    found = {}
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                found.setdefault(lang or "und", Counter()).update(zip(*(words[i:] for i in range(k)), strict=False))
    return found


def plain(rows, least, top):
    out = []
    for lang, f in counts(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        often = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        longer = Counter()
        for p, v in often.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], v)
        scored = []
        for p, a in often.items():
            if p in longer and 100 * longer[p] >= 100 * a:
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def check(spark, rows, least, top=2000, per_trie=m.TRIE):
    got = sorted(map(tuple, m.collocations(frame(spark, rows), least, top, per_trie).collect()))
    want = plain(rows, least, top)
    assert got == want
    return got


def prose(seed, n, vocabulary, breaks=0.1):
    draw = np.random.default_rng(seed)
    words = draw.zipf(1.3, n) % vocabulary
    ends = draw.choice(["", ".", ",", "\n", "!", "\t", "\r"], n, p=[1 - breaks, *[breaks / 6] * 6])
    return " ".join(f"{'W' if w % 3 else 'ä'}{w}{e}" for w, e in zip(words, ends, strict=True))


@pytest.fixture(scope="module")
def rows():
    return [(["en", "de", None][i % 3], prose(i, 400 + 300 * (i % 4), 40)) for i in range(12)]


def test_equals_plain_version(spark, rows):
    assert len(check(spark, rows, 6)) > 100


def test_several_tries_of_a_level(spark, rows):
    assert check(spark, rows, 20, per_trie=25)


def test_texts_longer_than_a_stretch(spark, rows, monkeypatch):
    # in this process: the cutting of stretches
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    whole = [(w.code.tolist(), w.continues.tolist()) for _, _, w in m.stretches(batch, 0)]
    monkeypatch.setattr(m, "CHUNK", 100)
    cut = [(w.code.tolist(), w.continues.tolist()) for _, _, w in m.stretches(batch, 0)]
    assert len(whole) == 1 and len(cut) > 50
    assert sum((c for c, _ in cut), []) == whole[0][0]
    assert sum((c for _, c in cut), []) == whole[0][1]
    unbroken = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["x " * 500, "y"])], ["lang", "text"])
    assert [len(w.code) for _, _, w in m.stretches(unbroken, 0)] == [500, 1]


def test_ties_repeats_nulls_and_clashing_columns(spark):
    rows = [("en", "a b c d e f. a b")] * 5 + [(None, "a b c")] * 5 + [("en", None), ("de", ""), (None, " \t.\n"), ("fr", "c d")]
    got = check(spark, rows, 5)
    assert [g[2] for g in got if g[0] == "en"] == ["b c d e f", "a b c d e", "a b"] or len(got) > 2
    check(spark, rows, 5, top=1)


def test_nothing_frequent_and_empty_table(spark):
    assert check(spark, [("en", "a b c")], 2) == []
    assert m.collocations(frame(spark, [])).count() == 0


def test_words_joined_by_a_document_boundary_stay_apart(spark):
    check(spark, [("en", "ab"), ("en", "cd"), ("en", ""), ("en", "ab cd")] * 3, 3)


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_trie_equals_dictionary(depth):
    draw = np.random.default_rng(depth)
    phrases = np.unique(draw.integers(0, 30, (400, depth)).astype(np.uint64) * np.uint64(2**58 + 7), axis=0)
    trie = m.build_trie(phrases)
    text = draw.integers(0, 33, 5000).astype(np.uint64) * np.uint64(2**58 + 7)
    continues = draw.random(5000) > 0.1
    none = np.zeros(5000, np.int64)
    got = m.accepted(trie, m.Words(none, none, text, continues, none))
    rows = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    for i in range(5000):
        whole = all(continues[i + 1 : i + depth])
        assert got[i] == (rows.get(tuple(text[i : i + depth].tolist()), -1) if whole else -1)


def test_codes_that_clash_start_again(spark, rows, monkeypatch):
    counted, seeds = m.word_counts, []

    def clashing(texts, seed):
        seeds.append(seed)
        out = counted(texts, seed)
        return out.withColumn("clash", out["clash"] | (out["word"] == "w1")) if seed == 0 else out

    monkeypatch.setattr(m, "word_counts", clashing)
    check(spark, rows, 30)
    assert seeds == [0, 1]


def pairs_of_words(n, vocabulary, seed=3):
    draw = np.random.default_rng(seed)
    first, second = (draw.zipf(1.2, 2 * n) % vocabulary for _ in range(2))
    return np.unique(np.stack([first, second], 1).astype(np.uint64), axis=0)[:n]


def test_time_of_a_trie_grows_as_its_phrases(monkeypatch):
    # positions looked at while nodes are placed, and slots: eight times the phrases, about eight times as many
    looked = []
    fitting, together = m._Places._fitting, m._Places.together
    monkeypatch.setattr(m._Places, "_fitting", lambda self, tried, shape: looked.append(len(tried)) or fitting(self, tried, shape))
    monkeypatch.setattr(m._Places, "together", lambda self, shapes: looked.append(shapes.size) or together(self, shapes))
    work, slots = [], []
    for n in (20_000, 160_000):
        looked.clear()
        trie = m.build_trie(pairs_of_words(n, n))
        work.append(sum(looked))
        slots.append(len(trie.check))
    assert work[1] < 16 * work[0]
    assert slots[1] < 6 * 160_000


@pytest.mark.parametrize("vocabulary", [1, 2, 700, 90_000])
def test_large_trie_accepts_its_phrases_and_no_other(vocabulary):
    phrases = pairs_of_words(60_000, vocabulary) * np.uint64(2**58 + 7)
    trie = m.build_trie(phrases)
    text = np.vstack([phrases, phrases[:, ::-1]]).ravel()
    continues = np.arange(len(text)) % 2 == 1
    none = np.zeros(len(text), np.int64)
    got = m.accepted(trie, m.Words(none, none, text, continues, none))[::2]
    rows = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    assert got.tolist() == [rows.get(tuple(p), -1) for p in text.reshape(-1, 2).tolist()]


def test_texts_are_read_once_for_each_trie_of_a_level(spark, rows, monkeypatch):
    # of single words, which share no word, once for each pair
    walked, read = m.walked, Counter()

    def counting(texts, here, *rest, **named):
        read[here.depth] += 1
        return walked(texts, here, *rest, **named)

    monkeypatch.setattr(m, "walked", counting)
    check(spark, rows, 20, per_trie=5)
    often = Counter(len(p) for f in counts(rows).values() for p, n in f.items() if n >= 20)
    tries = {k: -(-n * k // (5 * m.LONGEST)) for k, n in often.items()}
    assert tries[1] > 1 and tries[2] > 1
    assert read == tries | {1: tries[1] ** 2}


def test_tries_of_a_level_may_be_empty(spark, monkeypatch):
    sizes, build = [], m.build_trie
    monkeypatch.setattr(m, "build_trie", lambda phrases: sizes.append(len(phrases)) or build(phrases))
    assert check(spark, [("en", "a b c d e f g h. x y")] * 3, 3, per_trie=1)
    assert 0 in sizes


def test_words_that_are_no_text():
    data = np.frombuffer(b"aB \xff\xc3x \xc3\xa4", np.uint8)
    assert m._spelt(data, np.array([0, 3, 7]), np.array([2, 6, 9])).to_pylist() == ["ab", "\ufffd\ufffdx", "\u00e4"]
    assert m._spelt(data, np.array([], np.int64), np.array([], np.int64)).to_pylist() == []


def test_words_of_one_code_are_counted_apart(spark, monkeypatch):
    # in this process: the function of the tasks
    import pyarrow as pa

    taken, stretches = [], m.stretches
    monkeypatch.setattr(m, "stretches", lambda *a: ((d, n, w._replace(code=w.code & np.uint64(1))) for d, n, w in stretches(*a)))
    frame = type("Frame", (), {"mapInArrow": lambda self, f, schema: taken.append(f) or spark.createDataFrame([], schema)})()
    m.word_counts(frame, 0)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3 + ["de"]), pa.array(["a b c d e f", "B a", "b f", "a"])], ["lang", "text"])
    found = Counter()
    for out in taken[0](iter([batch, batch])):
        for row in out.to_pylist():
            assert row["code"] in (0, 1)
            found[row["lang"], row["word"]] += row["n"]
    assert found == {("en", w): 2 * n for w, n in dict(a=2, b=3, c=1, d=1, e=1, f=2).items()} | {("de", "a"): 2}
