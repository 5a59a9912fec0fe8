"""Main text of web pages as the maximum-scoring subsequence of their words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many labelled pages on average, those of lowest page_id hash, give the weights; all of them if there are fewer.
LABELLED_PAGES = 2000

#: Elements whose content is never shown as text.
RAW = frozenset(
    "script style noscript template svg math iframe object canvas audio video textarea select title".split()
)
#: Those whose content is code: without an end tag they run to the end of the page. The others are then only a tag.
CODE = frozenset("script style".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""",
    re.S,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li link main menu meta nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Elements that are not the article, wherever they stand.
ASIDE = frozenset("head nav header footer aside form menu button dialog label input option datalist".split())
#: Parts of a class, id or role (split at anything but letters and digits) that count against the words of any element. They
#: take nothing away: the words inside score minus a word's weight, and stay if the best region spans them.
ASIDE_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion banner sidebar "
    "aside complementary menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo header masthead topbar cookie cookies "
    "consent gdpr notice notices notification popup modal overlay dialog newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations widget comment comments commentlist reply replies respond disqus discussion form "
    "search toolbar pagination pager skip copyright disclaimer alert tracking".split()
)
#: These hold the page or the article, whatever their class says.
HOLDERS = frozenset("html body main article".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends, and those beyond which it looks for none.
_ENDS_P = BLOCKS - set("body caption head html link meta option tbody td tfoot th thead tr".split())
_ROWS, _CELLS = frozenset("tbody thead tfoot".split()), frozenset("td th caption".split())
ENDED_BY = {name: [(frozenset(["p"]), frozenset("td th caption table button".split()))] for name in _ENDS_P}
ENDED_BY["li"] = [(frozenset(["li"]), frozenset("ul ol menu dir td th table".split())), *ENDED_BY["li"]]
for _name in ("dd", "dt"):
    ENDED_BY[_name] = [(frozenset(["dd", "dt"]), frozenset("dl td th table".split())), *ENDED_BY[_name]]
for _name in ("td", "th"):
    ENDED_BY[_name] = [(_CELLS, frozenset(["tr", "table"]))]
ENDED_BY["tr"] = [(_CELLS | {"tr"}, _ROWS | {"table"})]
for _name in _ROWS:
    ENDED_BY[_name] = [(_CELLS | _ROWS | {"tr"}, frozenset(["table"]))]
ENDED_BY["option"] = [(frozenset(["option"]), frozenset(["datalist"]))]
ENDED_BY["body"] = [(frozenset(["head"]), frozenset())]
#: Elements that may end without a tag of their own.
OPTIONAL_END = frozenset("html head body p li dd dt td th tr tbody thead tfoot caption option".split())
IN_HEAD = frozenset("base basefont bgsound link meta head html".split()) | RAW
#: An end tag of none of TABLE ends nothing outside of the nearest of these; one of a list item, nothing outside of its list.
SCOPES = frozenset("td th caption table html".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption body html".split())
LISTS = {"li": frozenset("ul ol menu dir".split()), "dd": frozenset(["dl"]), "dt": frozenset(["dl"])}
#: So many open elements at most are looked through, as browsers nest no deeper.
DEEPEST = 512
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'][^"']*["']?""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
PARTS = re.compile(r"[^a-z0-9]+")

WORD, ASIDE_TOKEN, SUSPECT_WORD = "word", "aside", "suspect word"
#: An element of at least this share of the words of the page, or of the article around it, is no aside, from so many words on.
LARGE_SHARE, LARGE_WORDS = 1 / 3, 5
#: Beside articles of at least this share of the page, a large element outside of them stays an aside (comments).
ARTICLES_SHARE = 0.1
#: Weight that any tag has at least against the content.
LEAST = -0.05


def attributes(attrs: str) -> dict[str, str]:
    """Names and values of the attributes of a tag, in lower case; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for match in ATTRIBUTE.finditer(attrs.lower()):
        if match[1]:
            found.setdefault(match[1], match[2] or match[3] or match[4] or "")
    return found


def hides(attrs: str) -> bool:
    """Whether the tag has the attribute ``hidden``, or a style that does not show it; such words in other values say nothing."""
    if not re.search("hidden|style", attrs, re.I):
        return False
    named = attributes(attrs)
    return "hidden" in named or bool(NOT_SHOWN.search(named.get("style", "")))


def is_suspect(name: str, attrs: str) -> bool:
    """Whether class, id or role name an aside."""
    if not attrs or name in HOLDERS:
        return False
    named = attributes(attrs)
    return any(not ASIDE_PARTS.isdisjoint(PARTS.split(named[key])) for key in ("class", "id", "role") if key in named)


@dataclass(slots=True)
class Element:
    """An aside, article or main: its tokens from the start tag to before the end tag, and the first block tag in it."""

    name: str
    start: int
    kind: str  # "aside", "hidden", "suspect" or "content"
    end: int = -1
    block: int = -1


def elements(page: str) -> tuple[list[tuple[str, str]], list[Element]]:
    """All of the page as ("text", raw text) and ("tag", name with / if it ends), in order, and its asides and articles by their start.

    Elements end where HTML ends them: at their own tag, at that of an element around them, and, as p or li, at the next of
    their kind or block. An aside that has no end tag and needs one ends before its first block.
    """
    tokens: list[tuple[str, str]] = []
    asides: list[Element] = []
    stack: list[tuple[str, Element | None]] = []
    opened: Counter = Counter()  # names on the stack
    endless: set[str] = set()  # raw names without an end tag in the rest of the page
    waiting: list[Element] = []  # asides on the stack that have no block yet

    def close(depth: int, own: bool) -> None:
        """Take the stack down to ``depth``; ``own`` if the last one taken has its own end tag, which is the next token."""
        while len(stack) > depth:
            name, aside = stack.pop()
            opened[name] -= 1
            if aside:
                ended = (own and len(stack) == depth) or name in OPTIONAL_END or name in HOLDERS or aside.block < 0
                aside.end = len(tokens) if ended else aside.block

    def find(names: frozenset, beyond: frozenset) -> int:
        """The outermost open element of ``names`` on this side of ``beyond``, or -1."""
        found = -1
        if any(opened[name] for name in names):
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                if stack[i][0] in names:
                    found = i
                elif stack[i][0] in beyond:
                    break
        return found

    at = 0
    while found := TOKEN.search(page, at):
        if found.start() > at:
            if opened["head"] and page[at : found.start()].strip():
                close(find(frozenset(["head"]), frozenset()), False)
            tokens.append(("text", page[at : found.start()]))
        at = found.end()
        if found["name"] is None:
            continue
        name, ending, attrs = found["name"].lower(), bool(found["end"]), found["attrs"]
        if name in RAW and attrs[:1].strip() in ("", "/"):
            if not (ending or name in endless or (name in ("svg", "math") and attrs.endswith("/"))):
                if last := RAW_END[name].search(page, at):
                    at = last.end()
                elif name in CODE:
                    at = len(page)
                else:
                    endless.add(name)
            continue
        if ending:
            if opened[name]:
                if name in BLOCKS:
                    beyond = frozenset() if name in TABLE else SCOPES | LISTS.get(name, frozenset())
                    if name in TABLE and name not in ("table", "body", "html"):
                        beyond = frozenset(["table"])
                else:
                    beyond = BLOCKS
                for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                    if stack[i][0] == name:
                        close(i, True)
                        break
                    if stack[i][0] in beyond:
                        break
        else:
            if opened["head"] and name not in IN_HEAD:
                close(find(frozenset(["head"]), frozenset()), False)
            for names, beyond in ENDED_BY.get(name, ()):
                if (i := find(names, beyond)) >= 0:
                    close(i, False)
        if name in BLOCKS and waiting:
            for aside in waiting:
                if aside.end < 0:
                    aside.block = len(tokens)
            waiting.clear()
        if not ending:
            aside = None
            if name in ("article", "main"):
                kind = "content"
            elif attrs and name not in HOLDERS and hides(attrs):
                kind = "hidden"
            else:
                kind = "aside" if name in ASIDE else "suspect" if is_suspect(name, attrs) else ""
            if kind:
                aside = Element(name, len(tokens), kind)
                asides.append(aside)
            if name in VOID or attrs.endswith("/"):
                if aside:
                    aside.end = len(tokens) + 1
            else:
                stack.append((name, aside))
                opened[name] += 1
                if aside:
                    waiting.append(aside)
        tokens.append(("tag", f"/{name}" if ending else name))
    if at < len(page):
        tokens.append(("text", page[at:]))
    close(0, False)
    return tokens, asides


def judged(tokens: list[tuple[str, str]], found: list[Element]) -> list[Element]:
    """The hidden and aside elements of ``found`` that are such by what they hold.

    No suspect (nor a form, which may wrap a page) is one if it holds main or an article of at least half the words of the
    longest, or itself a large share of the words.
    """
    if all(element.kind == "content" for element in found):
        return []

    def counted(without: list[Element]) -> list[int]:
        before, left_out = [0], iter(sorted(without, key=lambda e: e.start))
        out = next(left_out, None)
        for i, (kind, value) in enumerate(tokens):
            while out and out.end <= i:
                out = next(left_out, None)
            gone = out and out.start <= i
            before.append(before[-1] + (len(value.split()) if kind == "text" and not gone else 0))
        return before

    kept = [e for e in found if e.kind == "hidden" or (e.kind == "aside" and e.name != "form")]
    before = counted(kept)

    def words(element: Element) -> int:
        return before[element.end] - before[element.start]

    contents = [e for e in found if e.kind == "content"]
    longest = max(map(words, contents), default=0)
    weighty = [e.start for e in contents if 2 * words(e) >= longest]
    in_articles, reach = 0, -1
    for e in contents:
        if e.start >= reach:
            in_articles, reach = in_articles + words(e), e.end
    around: list[Element] = []
    for e in found:
        while around and around[-1].end <= e.start:
            around.pop()
        if e.kind == "content":
            around.append(e)
        elif e.kind == "suspect" or (e.kind == "aside" and e.name == "form"):
            i = bisect_left(weighty, e.start)
            if i < len(weighty) and weighty[i] < e.end:
                continue
            of = words(around[-1]) if around else before[-1]
            if words(e) >= max(LARGE_WORDS, LARGE_SHARE * of) and (around or in_articles < ARTICLES_SHARE * before[-1]):
                continue
            kept.append(e)
    return sorted(kept, key=lambda e: e.start)


def items(page: str) -> Iterator[tuple[str, str, bool]]:
    """The page as ("text", raw text), ("tag", name with / if it ends) and ("aside", name), in order, with whether it is suspect.

    An aside stands for its whole element. Tokens of an element that only its class, id or role call an aside are suspect.
    """
    tokens, found = elements(page)
    at = suspect = 0
    for element in [*judged(tokens, found), None]:
        start = element.start if element else len(tokens)
        if start < at:
            continue
        for i in range(at, start):
            yield *tokens[i], i < suspect
        at = start
        if element and element.kind == "suspect":
            suspect = max(suspect, element.end)
        elif element:
            yield "aside", element.name, start < suspect
            at = element.end
            if at < len(tokens) and tokens[at] == ("tag", f"/{element.name}"):
                at += 1


def token_counts(page: str) -> tuple[Counter, Counter]:
    """Tokens inside and outside of the labelled content: the article or main elements of the page."""
    inside, outside, now = Counter(), Counter(), 0
    for kind, value, suspect in items(page):
        name = value.removeprefix("/")
        if kind == "tag" and name in ("article", "main") and (now or not suspect):
            now = max(0, now + (-1 if value[0] == "/" else 1))
            continue
        to = inside if now else outside
        if kind == "text":
            to[SUSPECT_WORD if suspect else WORD] += len(value.split())
        else:
            to[ASIDE_TOKEN if kind == "aside" else name] += 1
    return inside, outside


def weights_from(counts: Mapping[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of each token inside against outside, with one added to each count; words at least 0.1, tags at most -0.05.

    A suspect word counts as much against the region as another for it.
    "" is the weight of a tag that no labelled page has.
    """
    kinds = len(counts) + 2
    total_in = sum(i for i, _ in counts.values()) + kinds
    total_out = sum(o for _, o in counts.values()) + kinds

    def odds(inside: int, outside: int) -> float:
        return math.log((inside + 1) / total_in) - math.log((outside + 1) / total_out)

    found = {name: min(LEAST, odds(i, o)) for name, (i, o) in counts.items()}
    found[WORD] = max(0.1, odds(*counts.get(WORD, (0, 0))))
    found[ASIDE_TOKEN] = min(-1.0, odds(*counts.get(ASIDE_TOKEN, (0, 0))))
    found[SUSPECT_WORD] = -found[WORD]
    found.setdefault("", -0.3)
    return found


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of greatest sum in one scan; the first of equals; (0, 0) if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def scored(parts: list[tuple[str, str, bool]], weights: Mapping[str, float]) -> list[float]:
    word, aside, other = weights[WORD], weights[ASIDE_TOKEN], weights[""]
    scores, held, last = [], 0, False
    for kind, value, suspect in parts:
        name = value.removeprefix("/")
        if held and suspect:  # does not end the article it lies in
            scores.append(0.0 if last else LEAST)
        elif kind == "text":
            scores.append((weights[SUSPECT_WORD] if suspect else word) * len(value.split()))
        elif kind == "aside":  # one within the article is left out, but does not end it
            scores.append(LEAST if held else aside)
        else:
            scores.append(weights.get(name, other))
        if kind == "tag" and name in ("article", "main") and (held or not suspect):
            held = max(0, held + (-1 if value != name else 1))
        last = suspect
    return scores


def main_text(page: str, weights: Mapping[str, float]) -> str:
    """Blocks of the best region, one a line, white space inside made one space.

    If no region is positive, suspect words count as any others, as long as there are a few of them.
    """
    parts = list(items(page))
    start, end = best_region(scored(parts, weights))
    if not end and sum(len(value.split()) for kind, value, suspect in parts if suspect and kind == "text") >= LARGE_WORDS:
        parts = [(kind, value, False) for kind, value, _ in parts]
        start, end = best_region(scored(parts, weights))
    blocks, now = [], []
    for kind, value, _ in [*parts[start:end], ("tag", "p", False)]:
        if kind == "text":
            now.append(value)
        elif value == "br":
            now.append(" ")
        elif value.removeprefix("/") in BLOCKS and now:
            if line := " ".join(entities.unescape("".join(now)).split()):
                blocks.append(line)
            now = []
    return "\n".join(blocks)


def fit(pages: DataFrame, limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from pages that label their content by an article or main element, about ``limit`` of them.

    The hash of page_id is cut where that many are expected below it, so the sample is taken where the pages lie.
    """
    labelled = pages.where(F.coalesce(F.col("html").rlike("(?i)<(article|main)[\\s>]"), F.lit(False)))
    share = min(1.0, limit / max(1, labelled.count()))
    labelled = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("html")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for page in batch["html"]:
                for total, own in zip((inside, outside), token_counts(page or ""), strict=True):
                    total.update(own)
            names = sorted({*inside, *outside})
            yield pd.DataFrame({"name": names, "i": [inside[n] for n in names], "o": [outside[n] for n in names]})

    counts = labelled.mapInPandas(counted, "name string, i long, o long").groupBy("name").agg(F.sum("i"), F.sum("o"))
    return weights_from({name: (i, o) for name, i, o in counts.collect()})  # one row per tag name of the bounded sample


def extract(pages: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every page: the article, from the whole html.

    Null or empty html, and pages without a word outside of asides and fewer than LARGE_WORDS suspect ones, give an empty text. Repeated rows are repeated. Extra
    columns are not read. An empty table gives none.
    """
    weights = dict(weights)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(page, weights) if page else "" for page in batch["html"]]
            yield batch[["page_id", "url", "text"]]

    read = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    made = read.mapInPandas(texts, "page_id string, url string, text string")
    return made.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_query(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
