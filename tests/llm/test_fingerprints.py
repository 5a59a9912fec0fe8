"""Fingerprints: against a plain Python version, neighbours over buckets, odd rows."""

import hashlib
import re

import pytest

from fleetlens.llm import fingerprints as m

SCHEMA = "doc_id long, text string, next string, fingerprint string, _key int"


def plain_fingerprint(text):
    words = re.findall(rf"[^{m.SPACE}]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    found = {" ".join(words[i : i + m.WORDS]) for i in range(max(1, len(words) - m.WORDS + 1))} if words else set()
    least = {}
    for shingle in found:
        h = hashlib.md5(shingle.encode()).hexdigest()
        b = int(h[:2], 16)
        least[b] = min(h, least.get(b, "g"))
    if not least:
        return ""
    out = []
    for b in range(m.BINS):
        step, at = m.draws(b)
        if b not in least:
            while at not in least:
                at = (at + step) % m.BINS
        out.append(least[b if b in least else at][-1])
    return "".join(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = sum(x == y for x, y in zip(a, b, strict=True)) / m.BINS
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def plain(rows):
    rows = sorted(
        ((i, t or "") for i, t in rows), key=lambda r: (m.NO_ID if r[0] is None else r[0], hashlib.md5(r[1].encode()).hexdigest())
    )
    out = []
    for n, (doc_id, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = map(plain_fingerprint, (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    got = m.op12_query(docs).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:5])
    got, want = sorted(map(tuple, got), key=key), sorted(plain(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [v for g in got for v in g[5:]] == pytest.approx([v for w in want for v in w[5:]])
    return got


def words(start, n):
    return " ".join(f"W{i}" for i in range(start, start + n))


def test_equals_plain_version(spark):
    rows = [(i * 7, words(i * 20, 3 + i * i % 90)) for i in range(40)]
    rows += [(1000, words(0, 2000)), (1001, "ä ö ü ß é 𝒳 " * 5), (1002, "one"), (1003, "a b c d"), (-5, "A  b\tC\nd e F")]
    check(spark, rows)


def test_nulls_empty_texts_ties_and_clashing_columns(spark):
    rows = [(None, words(0, 30)), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, words(5, 9)), (4, words(5, 9)), (4, words(50, 9))]
    got = check(spark, rows)
    empty = [g for g in got if g[0] in (1, 2, 3)]
    assert {g[3] for g in empty} == {""}


def test_one_document_follows_itself(spark):
    got = check(spark, [(9, words(0, 40))])
    assert got[0][6] == 1.0


def test_neighbours_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 3)
    rows = [(i * i - 50, words(i, 10)) for i in range(60)] + [(None, "x y")] + [(14, words(i, 6)) for i in range(9)]
    check(spark, rows)


def test_empty_table(spark):
    assert m.op12_query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_likeness_estimates_similarity(spark):
    pairs = [(words(0, 1000), words(k, 1000)) for k in (0, 50, 110, 250, 500, 2000)]
    frame = spark.createDataFrame(pairs, "a string, b string").select(m.likeness(m.fingerprint("a"), m.fingerprint("b")).alias("x"))
    found = [r.x for r in frame.collect()]
    true = [max(0, 996 - k) / (996 + k) for k in (0, 50, 110, 250, 500, 2000)]
    assert found == pytest.approx(true, abs=0.12)
    assert found[0] == 1.0


def test_equal_texts_have_equal_fingerprints_and_long_texts_pass(spark):
    long = words(0, 300_000)
    rows = m.fingerprints(spark.createDataFrame([(1, long, "", "", 0), (2, long, "", "", 0)], SCHEMA)).collect()
    assert rows[0].fingerprint == rows[1].fingerprint == plain_fingerprint(long)
