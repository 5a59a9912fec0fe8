import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from fleetlens.llm import ann, chat, html_text


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 24)).astype(np.float32)
    x[100:160] = x[100]  # ties
    frame = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = ann.nearest(frame, frame.where("vec_id % 20 = 0"), k=20, query_block=8, candidate_block=64).collect()
    want = []
    for q in range(0, 500, 20):
        scores = ann.exact_products(np.repeat(x[q : q + 1].astype(float), 500, 0), x.astype(float))
        order = sorted((i for i in range(500) if i != q), key=lambda i: (-scores[i], i))[:20]
        want += [(q, r + 1, i, scores[i]) for r, i in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 1500)), rng.normal(size=(60, 1500)) * 1e-3
    xc, xs, xn, xl = ann.quantised(x)
    yc, ys, yn, yl = ann.quantised(y)
    near = ann.int8_products(xc, yc)
    assert (near == xc.astype(int) @ yc.astype(int).T).all()
    slack = xn[:, None] * yl + xl[:, None] * yn + xl[:, None] * yl
    assert (np.abs(near * xs[:, None] * ys - x @ y.T) <= slack).all()


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0),
        (6, [None, 1.0], 0), (7, [], 0), (8, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (20, [1.0, 2.0, 1.0], 0), (40, [0.0, 0.0], 0),
    ]
    frame = vectors(spark, rows)
    got = sorted(tuple(r)[:3] for r in ann.op4_query(frame).collect())
    assert got == [(0, 1, 1), (20, 1, 8)]
    assert ann.op4_query(frame.limit(0)).count() == 0


TEXTS = st.text(alphabet="ab\\<|>_im\nstarend ", max_size=30) | st.text(max_size=20)


@given(TEXTS, TEXTS, TEXTS)
def test_template_is_reversible(role, text, more):
    one, start, end = chat.rendered(role, text)
    two, *_ = chat.rendered("assistant", more)
    assert chat.parsed(one + two) == [(role, text), ("assistant", more)]
    assert chat.unescaped(one[start:end]) == text


def conversations(spark, *rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_examples_train_one_reply_each(spark):
    frame = conversations(
        spark, (1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b<|im_end|>"), (1, 3, "assistant", "d"), (1, 4, "user", "tail"),
        (2, 0, None, None), (None, 0, "assistant", "x"), (None, None, "user", "first"), (3, 0, "assistant", "s"), (3, 0, "assistant", "s"),
    )
    rows = chat.examples(frame.withColumn("formatted", frame["text"])).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.example)):
        masked = [chat.unescaped(r.formatted[m.start : m.end]) for m in r.mask]
        by.setdefault(r.conv_id, []).append(([t for _, t in chat.parsed(r.formatted)], masked))
    assert by == {
        1: [(["a", "b<|im_end|>"], ["b<|im_end|>"]), (["a", "b<|im_end|>", "c", "d"], ["d"]), (["a", "b<|im_end|>", "c", "d", "tail"], [])],
        2: [([""], [])], None: [(["first", "x"], ["x"])], 3: [(["s"], ["s"]), (["s", "s"], ["s"])],
    }
    digests = {r.conv_id: r for r in chat.op6_query(frame).collect()}
    assert digests[1].n_turns == 5 and digests[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>d").hexdigest()
    assert digests[-1].n_turns == 2 and digests[-1].loss_chars == 34
    assert digests[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.examples(frame.limit(0)).count() == 0


def test_long_conversation_spans_batches(spark):
    frame = conversations(spark, *[(9, i, "assistant" if i % 2 else "user", f"t{i} " * 200) for i in range(400)])
    assert chat.examples(frame).count() == 200
    assert chat.op6_query(frame).where("conv_id = 9").first().n_turns == 400


WEIGHTS = html_text.weights_from({"word": (900, 100), "aside": (0, 50), "p": (60, 2), "li": (0, 40), "div": (2, 20)})
PAGES = [
    ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>one <b>t</b>wo\n three<p>four</article><footer>f</footer>", "T & U\none two three\nfour"),
    ("<body><div class='site-header'>Logo</div><main><p>a b c</p><aside>no</aside><form>f</form><p>d&nbsp;e</p></main>"
     "<div id=comments><div class=comment>c</div>c2</div></body>", "a b c\nd e"),
    ("<script>if (a<b) '<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>x < y</p>", "x < y"),
    ("<nav>menu<p>real text here", "real text here"),
    ("<div class=\"ad\">buy</div>", ""), ("", ""), (None, ""), ("plain text", "plain text"), ("<p>a<br>b</p>", "a b"),
    ("<p hidden>no</p><p>yes</p><svg><text>no</text></svg>", "yes"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert (html_text.main_text(page, WEIGHTS) if page else "") == want


@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_region(scores):
    start, end = html_text.best_region(scores)
    best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])
    assert sum(scores[start:end]) == best


def test_extract_edges(spark):
    rows = [(i, "u", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, "<p>x"), (0, "u", PAGES[0][0]), (99, "u", "<p>" + "w " * 300_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = html_text.op8_query(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 99).n_chars == 599_999
    assert html_text.op8_query(frame.limit(0)).count() == 0


def test_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.op8_query(pages).join(pages.select("page_id", "html"), "page_id").limit(40).collect():
        assert r.text.split("\n")[0] and "track(" not in r.text and "&copy;" not in r.text and "©" not in r.text
