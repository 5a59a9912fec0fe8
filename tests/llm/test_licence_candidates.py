import math
import random
import re
from collections import Counter

from fleetlens.llm import licences


def brute(lines, threshold=licences.THRESHOLD):
    """Best licence and score of each line over all templates, without selecting candidates."""
    found = [Counter(re.findall(licences._TERM, line.lower())) for line in lines]
    templates = [(n, Counter(re.findall(licences._TERM, t.lower()))) for n, ts in licences.TEMPLATES.items() for t in ts]
    vocabulary = {x for _, t in templates for x in t}
    df = Counter(x for u in found for x in u if x in vocabulary)

    def weighed(tf):
        return {x: k * (math.log((1 + len(lines)) / (1 + df[x])) + 1) for x, k in tf.items()}

    out = []
    for u in map(weighed, found):
        scores = []
        for name, t in ((n, weighed(t)) for n, t in templates):
            dot = sum(w * u[x] for x, w in t.items() if x in u)
            size = math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in t.values()))
            scores.append((-round(dot / size, 4) if size else 0.0, name))
        score, name = min(scores)
        out.append((name, -score) if -score >= threshold else (None, None))
    return out


def scanned(spark, lines):
    files = spark.createDataFrame([(i, f"d/{i}.txt", x) for i, x in enumerate(lines)], "doc_id long, path string, text string")
    rows = {r.doc_id: (r.own_licence, r.score) for r in licences.scan(files).collect()}
    return [rows[i] for i in range(len(lines))]


def test_lines_without_cue_state_their_licence(spark):
    lines = ["Creative Commons Attribution-ShareAlike 4.0 International", "Available under CC BY-NC 4.0.", *["this work here is not licensed under a license of some kind"] * 500]
    assert not any(set(re.findall(licences._TERM, x.lower())) & set(licences.CUES) for x in lines[:2])
    got = scanned(spark, lines)
    assert [name for name, _ in got[:2]] == ["CC-BY-SA-4.0", "CC-BY-NC-4.0"] and got == brute(lines)


def test_directory_inherits_from_a_file_without_cue(spark):
    rows = [(1, "r/LICENSE", "Available under CC BY-NC 4.0."), (2, "r/a/x.txt", "nothing"), *((i, f"q/{i}", "any words") for i in range(3, 300))]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert {r.doc_id: (r.licence, r.licence_dir) for r in licences.scan(files).collect() if r.doc_id == 2} == {2: ("CC-BY-NC-4.0", "r")}


def test_candidates_lose_nothing(spark):
    rng = random.Random(0)
    texts = [t.split() for ts in licences.TEMPLATES.values() for t in ts]
    lines = []
    for _ in range(600):
        words = list(rng.choice(texts))
        kept = [w for w in words if rng.random() < rng.choice((0.3, 0.7, 0.9))] + ["other"] * rng.choice((0, 0, 1, 2)) + ["mit"] * rng.choice((0, 0, 0, 2))
        lines.append(" ".join(kept))
    lines += ["mit", "mit den the of", "public domain", ""]
    assert scanned(spark, lines) == brute(lines)
