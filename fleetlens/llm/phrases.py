"""Collocations: phrases counted level by level, by double-array tries of candidates that are walked over all text positions at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored, text_of

LONGEST = 5
LEAST = 100
TOP = 2000
#: Phrases of ``LONGEST`` words of one trie at most, about, and as many more as they are shorter; with more, there are several.
TRIE = 1 << 20
#: Bytes of text walked at once (a longer piece is walked whole), and counts a task holds before it passes them on.
CHUNK, HELD = 1 << 21, 1 << 21

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=4)
def _powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64 and of its inverse."""
    with np.errstate(over="ignore"):
        both = [np.full(n, m, np.uint64) for m in (multiplier, pow(multiplier, -1, 1 << 64))]
        for p in both:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """The words of a stretch of text: where they lie, a hash of language and word, and whether each continues the piece before."""

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    continues: np.ndarray
    lang: np.ndarray


def _words(data: np.ndarray, starts: np.ndarray, langs: np.ndarray, lang_codes: np.ndarray, seed: int) -> Words:
    """Words of ``data``, in which documents begin at ``starts`` (ascending, the first at 0) with the languages ``langs``."""
    kind = _KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = starts[starts < len(data)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    if not len(start):
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.empty(0, bool), none)
    size = max(CHUNK, 1 << int(len(data) - 1).bit_length())
    powers, inverses = _powers((0x9E3779B97F4A7C15 + 2 * seed) | 1, size)
    weighed = (_LOWER[data] + np.uint64(1)) * powers[: len(data)]
    weighed[~inside] = 0
    code = np.add.reduceat(weighed, start) * inverses[start]
    doc = np.searchsorted(starts, start, "right") - 1
    lang = langs[doc]
    code = _mixed(code * np.uint64(0x9E3779B97F4A7C15) + (end - start).astype(np.uint64)) + lang_codes[lang]
    breaks = np.searchsorted(np.nonzero(kind == _BREAK)[0], start)
    continues = np.zeros(len(start), bool)
    continues[1:] = (breaks[1:] == breaks[:-1]) & (doc[1:] == doc[:-1])
    return Words(start, end, _mixed(code), continues, lang)


def stretches(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, list[str], Words]]:
    """Words of a batch of (lang, text) in stretches of whole pieces."""
    lang, text = batch.column(0).dictionary_encode(), batch.column(1)
    if not len(text):
        return
    names = lang.dictionary.to_pylist()
    codes = np.array([xxhash.xxh3_64_intdigest(n, seed) for n in names], np.uint64)
    langs = lang.indices.to_numpy(zero_copy_only=False)
    wide = pa.types.is_large_string(text.type)
    ends = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    at = 0
    while at < len(data):
        to = len(data)
        if to - at > CHUNK:
            cut = starts[np.searchsorted(starts, at + CHUNK, "right") - 1]
            if cut <= at:  # a document longer than a stretch: at the last end of a piece, or the next one
                ends_here = np.nonzero(_KIND[data[at : at + CHUNK]] == _BREAK)[0]
                cut = at + ends_here[-1] + 1 if len(ends_here) else 0
            if not cut:
                following = starts[np.searchsorted(starts, at, "right") :][:1]
                limit = following[0] if len(following) else len(data)
                further = np.nonzero(_KIND[data[at + CHUNK : limit]] == _BREAK)[0]
                cut = at + CHUNK + further[0] + 1 if len(further) else limit
            to = int(cut)
        low = np.searchsorted(starts, at, "right") - 1
        here = starts[low : np.searchsorted(starts, to)] - at
        here[0] = 0
        with np.errstate(over="ignore"):
            yield data[at:to], names, _words(data[at:to], here, langs[low : low + len(here)], codes, seed)
        at = to


class Trie(NamedTuple):
    """A double array: the child of state s by letter c is t = base[s] + c if check[t] = s. State 0 is the root.

    A word has two letters, the upper and the lower half of its number, so no node spans more than ``1 << bits`` slots.
    ``table`` has the number of the word of each code, at the code modulo its size or after it. At the accepting
    states, which have no children, ``base`` holds the row number of the phrase.
    """

    words: np.ndarray
    table: np.ndarray
    bits: int
    base: np.ndarray
    check: np.ndarray
    rows: int
    depth: int


class _Places:
    """Which slots of a double array are taken. Nodes go in from the widest to the narrowest, so those hard to place find it empty.

    A node is given as the distances of its children from the first one; its place is that of the first.
    """

    #: Children of a node that is placed by itself at least; positions it tries at once, and how often.
    WIDE, WINDOW, OFTEN = 17, 1024, 8

    def __init__(self, span: int) -> None:
        self.used = np.ones(span, bool)  # none before ``span``: no base is below 1
        self.top, self.count, self.span = span, 0, span
        self.draw = np.random.default_rng(13)

    def _reach(self, size: int) -> None:
        if size > len(self.used):
            self.used = np.r_[self.used, np.zeros(max(size, 2 * len(self.used)) - len(self.used), bool)]

    def _take(self, slots: np.ndarray) -> None:
        self.used[slots] = True
        self.top = max(self.top, int(slots.max()) + 1)
        self.count += slots.size

    def _fitting(self, tried: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Of ``tried`` those at which the whole shape is free; of many, some."""
        at, size = 0, 8
        while len(tried) and at < len(shape):
            tried = tried[: max(1, (1 << 16) // size)]
            tried = tried[~self.used[tried[:, None] + shape[at : at + size]].any(axis=1)]
            at, size = at + size, 2 * size
        return tried

    def alone(self, shape: np.ndarray) -> int:
        """Place of one wide node: a free one of some windows drawn over the array, or its end."""
        self._reach(self.top + self.WINDOW + self.span)
        place = self.top
        for start in self.draw.integers(0, self.top, self.OFTEN).tolist():
            fits = self._fitting(start + np.arange(self.WINDOW), shape)
            if len(fits):
                place = int(fits[0])
                break
        self._take(place + shape)
        return place

    def together(self, shapes: np.ndarray) -> np.ndarray:
        """Places of nodes of one small width: all draw a free place, those that fit and have it for themselves keep it, the others draw again."""
        n, width = shapes.shape
        places, left = np.empty(n, np.int64), np.arange(n)
        limit = max(self.top, self.span + int((self.count + n * width) / min(0.85, 4 / width)) + 1)
        claim, rounds = np.empty(0, np.int64), 0
        while len(left):
            self._reach(limit + self.span)
            if len(claim) < len(self.used):
                claim = np.empty(len(self.used), np.int64)
            free = np.nonzero(~self.used[:limit])[0]
            tried = free[self.draw.integers(0, len(free), len(left))]
            slots = tried[:, None] + shapes[left]
            fit = np.nonzero(~self.used[slots].any(axis=1))[0]
            claim[slots[fit]] = fit[:, None]
            won = fit[(claim[slots[fit]] == fit[:, None]).all(axis=1)]
            if len(won):
                self._take(slots[won])
                places[left[won]] = tried[won]
                left = np.delete(left, won)
            rounds += 1
            if rounds % 32 == 0:
                limit += limit // 4
        return places

    def single(self, n: int) -> np.ndarray:
        """Places of ``n`` nodes of one child: any that are free."""
        self._reach(self.top + n)
        places = np.nonzero(~self.used[: self.top + n])[0][:n]
        if n:
            self._take(places)
        return places


def build_trie(phrases: np.ndarray) -> Trie:
    """The trie of phrases of one length (rows of word codes); a phrase's accepting state carries its row number.

    Words are numbered by how many phrases have them, so the children of a node lie close together. Only nodes of
    many children are placed one by one, at a bounded number of positions each: time grows as the phrases do.
    """
    n, depth = phrases.shape
    words, local = np.unique(phrases, return_inverse=True)
    order = np.argsort(-np.bincount(local.ravel(), minlength=len(words)), kind="stable")
    words, numbers = words[order], np.empty(len(words), np.int64)
    numbers[order] = np.arange(len(words))
    bits = -(-max(1, len(words) - 1).bit_length() // 2)
    local = numbers[local.reshape(n, depth)]
    node = np.zeros(n, np.int64)  # number of each phrase's node on the level
    levels, begins, widths, before = [], [], [], 0
    for letter in (half for i in range(depth) for half in (local[:, i] >> bits, local[:, i] & ((1 << bits) - 1))):
        edges, node = np.unique(node << bits | letter, return_inverse=True)
        parents = edges >> bits
        begin = np.nonzero(np.diff(parents, prepend=-1))[0]
        levels.append((parents, edges & ((1 << bits) - 1)))
        begins.append(begin + before)
        widths.append(np.diff(begin, append=len(edges)))
        before += len(edges)
    begin, width, letters = np.concatenate(begins), np.concatenate(widths), np.concatenate([own for _, own in levels])

    places, first = _Places(1 << bits), np.empty(len(begin), np.int64)
    wide = np.nonzero(width >= _Places.WIDE)[0]
    for i in wide[np.argsort(-width[wide], kind="stable")].tolist():
        own = letters[begin[i] : begin[i] + width[i]]
        first[i] = places.alone(own - own[0])
    for narrow in range(_Places.WIDE - 1, 1, -1):
        some = np.nonzero(width == narrow)[0]
        if len(some):
            own = letters[begin[some][:, None] + np.arange(narrow)]
            first[some] = places.together(own - own[:, :1])
    some = np.nonzero(width == 1)[0]
    first[some] = places.single(len(some))
    states = np.repeat(first - letters[begin], width) + letters

    size = places.top + (1 << bits)
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    state_of, at = np.zeros(1, np.int64), 0  # state of each node
    for parents, own in levels:
        above, state_of, at = state_of[parents], states[at : at + len(own)], at + len(own)
        base[above] = state_of - own
        check[state_of] = above
    base[state_of[node]] = np.arange(n)
    return Trie(words, _table(words), bits, base, check, n, depth)


def _table(words: np.ndarray) -> np.ndarray:
    """An open hash table of the rows of ``words``, a quarter full or less."""
    table = np.full(1 << (4 * len(words)).bit_length(), -1, np.int32)
    left = np.arange(len(words))
    at = (words & np.uint64(len(table) - 1)).astype(np.int64)
    while len(left):
        free = table[at] < 0
        table[at[free]] = left[free]
        out = table[at] != left
        left, at = left[out], (at[out] + 1) & (len(table) - 1)
    return table


def _numbers(trie: Trie, codes: np.ndarray) -> np.ndarray:
    """The number of the word of each code, or -1."""
    at = (codes & np.uint64(len(trie.table) - 1)).astype(np.int64)
    number = trie.table[at]
    other = np.nonzero(trie.words[number] != codes)[0]
    other = other[number[other] >= 0]
    at = at[other]
    while len(other):  # another word's place: on to the next
        at = (at + 1) & (len(trie.table) - 1)
        number[other] = trie.table[at]
        on = (number[other] >= 0) & (trie.words[number[other]] != codes[other])
        other, at = other[on], at[on]
    return number


def accepted(trie: Trie, words: Words) -> np.ndarray:
    """For every word the row number of the phrase that begins there, or -1."""
    out = np.full(len(words.code), -1, np.int64)
    if not len(trie.words) or not len(out):
        return out
    number = _numbers(trie, words.code)
    known = number >= 0
    at = np.nonzero(known)[0]
    state = np.zeros(len(at), np.int32)
    for level in range(trie.depth):
        if level:
            at, state = at[at + level < len(out)], state[at + level < len(out)]
            on = words.continues[at + level] & known[at + level]
            at, state = at[on], state[on]
        for shift in (trie.bits, 0):
            child = trie.base[state] + (number[at + level] >> shift & ((1 << trie.bits) - 1))
            here = trie.check[child] == state
            at, state = at[here], child[here]
    out[at] = trie.base[state]
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


WORD_COUNTS = pa.schema([("code", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """``code``, ``lang``, ``word``, ``n`` (and ``clash``: another word has the code) over all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty((4, 0), np.uint64)  # code, a second hash that tells words of one code apart, count, place in ``spelt``; by code
        spelt: tuple[list[pa.Array], list[pa.Array]] = [], []  # languages, words

        def out(rows: np.ndarray) -> pa.RecordBatch:
            named = [pa.concat_arrays(part).take(pa.array(rows[3])) for part in spelt]
            columns = [pa.array(rows[0].view(np.int64)), *named, pa.array(rows[2].view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, schema=WORD_COUNTS)

        for batch in batches:
            for data, names, words in stretches(batch, seed):
                if not len(words.code):
                    continue
                both = np.stack([words.code, _words_again(data, words)])
                order = np.argsort(both[0])
                new = np.diff(both[:, order]) != 0
                if (new[1] & ~new[0]).any():  # words of one code
                    order = np.lexsort(both[::-1])
                    new = np.diff(both[:, order]) != 0
                at = np.nonzero(np.r_[True, new.any(axis=0)])[0]
                rows = order[at]
                here = np.vstack([both[:, rows], np.diff(np.r_[at, len(order)]).astype(np.uint64)])
                place = np.minimum(np.searchsorted(known[0], here[0]), max(0, known.shape[1] - 1))
                old = (known[:2, place] == here[:2]).all(axis=0) if known.shape[1] else np.zeros(len(rows), bool)
                known[2, place[old]] += here[2, old]
                fresh = np.nonzero(~old)[0]
                spelt[0].append(pa.array(names, pa.string()).take(pa.array(words.lang[rows[fresh]])))
                spelt[1].append(_spelt(data, words.start[rows[fresh]], words.end[rows[fresh]]))
                places = np.arange(known.shape[1], known.shape[1] + len(fresh), dtype=np.uint64)
                known = np.hstack([known, np.vstack([here[:, fresh], places])])
                known = known[:, np.argsort(known[0], kind="stable")]
                if known.shape[1] > HELD // 4:
                    yield out(known)
                    known, spelt = known[:, :0], ([], [])
        if known.shape[1]:
            yield out(known)

    parts = texts.mapInArrow(counted, "code long, lang string, word string, n long")
    spelt = F.struct("lang", "word")
    return parts.groupBy("code").agg(
        F.sum("n").alias("n"), F.min(spelt).alias("w"), (F.min(spelt) != F.max(spelt)).alias("clash")
    ).select("code", "w.lang", "w.word", "n", "clash")


def _spelt(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words of ``data`` that lie there, in lower case."""
    ends = np.cumsum(end - start)
    letters = _LOWER[data[np.repeat(end - ends, end - start) + np.arange(ends[-1] if len(ends) else 0)]].astype(np.uint8)
    buffers = [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(letters)]
    words = pa.Array.from_buffers(pa.binary(), len(ends), buffers)
    try:
        return words.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no text
        return pa.array([w.decode("utf-8", "replace") for w in words.to_pylist()], pa.string())


def _words_again(data: np.ndarray, words: Words) -> np.ndarray:
    powers, inverses = _powers(0xD1342543DE82EF95, max(CHUNK, 1 << int(max(1, len(data) - 1)).bit_length()))
    with np.errstate(over="ignore"):
        weighed = (_LOWER[data] + np.uint64(1)) * powers[: len(data)]
        weighed[_KIND[data] != 0] = 0
        return np.add.reduceat(weighed, words.start) * inverses[words.start]


def walked(texts: DataFrame, here: Trie, after: Trie, seed: int, count: bool, pair: bool) -> DataFrame:
    """Counts over all texts: ``key``, ``n`` of the phrases of ``here`` (``kind`` 0), and of places where one of ``here``
    begins at a word and one of ``after`` at the next word of the piece (``kind`` 1, key: row in here * 2**32 + row in after)."""
    context = texts.sparkSession.sparkContext
    held = context.broadcast((here, None if after is here else after))
    rows = here.rows
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = held.value
        total = np.zeros(rows, np.int64)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        waiting = 0

        def out(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], schema=schema)

        for batch in batches:
            for _, _, words in stretches(batch, seed):
                found = accepted(first, words)
                if count:
                    total += np.bincount(found[found >= 0], minlength=rows)
                if pair and len(found) > 1:
                    follows = found if second is None else accepted(second, words)
                    both = words.continues[1:] & (found[:-1] >= 0) & (follows[1:] >= 0)
                    key, n = np.unique((found[:-1][both] << 32) | follows[1:][both], return_counts=True)
                    keys, counts, waiting = [*keys, key], [*counts, n], waiting + len(key)
                    if waiting > HELD:
                        key, n = _summed(keys, counts)
                        keys, counts, waiting = [key], [n], len(key)
                        if waiting > HELD // 2:
                            yield out(1, key, n)
                            keys, counts, waiting = [], [], 0
        if keys:
            yield out(1, *_summed(keys, counts))
        some = np.nonzero(total)[0]
        yield out(0, some, total[some])

    return texts.mapInArrow(counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _numbered(phrases: DataFrame, length: int, per_trie: int) -> tuple[DataFrame, int]:
    """``phrases`` (``codes``) of one length, with their trie and row as the first phrase of a pair (``here``, ``a``) and as the
    second (``after``, ``b``). Phrases that may follow one another go together: by all but the first and by all but the last word."""
    phrases = stored(phrases)
    tries = -(-phrases.count() * length // (LONGEST * per_trie))
    if tries < 2:
        row = (F.row_number().over(Window.partitionBy("here").orderBy("codes")) - 1).cast("long")
        numbered = phrases.withColumn("here", F.lit(0)).withColumn("a", row)
        return stored(numbered.withColumn("after", F.col("here")).withColumn("b", F.col("a"))), tries
    numbered = phrases
    for trie, row, start in (("here", "a", 2), ("after", "b", 1)):
        shared = F.slice("codes", start, length - 1) if length > 1 else F.col("codes")
        numbered = numbered.withColumn(trie, F.pmod(F.xxhash64(shared), F.lit(tries)).cast("int"))
        numbered = numbered.withColumn(row, (F.row_number().over(Window.partitionBy(trie).orderBy("codes")) - 1).cast("long"))
    return stored(numbered), tries


def _trie(numbered: DataFrame, length: int, side: str, row: str, trie: int) -> Trie:
    """One trie, built on the driver; its size is bounded by ``per_trie``. It may be empty."""
    rows = numbered.where(F.col(side) == trie).orderBy(row).select("codes").toArrow().column("codes").combine_chunks()
    flat = rows.flatten().to_numpy().view(np.uint64)
    return build_trie(flat.reshape(len(rows), length))


class Counts(NamedTuple):
    """``words``: code, lang, word, n of frequent words; ``sizes``: lang, n; ``phrases``: codes, f of frequent phrases of 2 words and more."""

    words: DataFrame
    sizes: DataFrame
    phrases: DataFrame


def count_phrases(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, per_trie: int = TRIE) -> Counts:
    """Words and phrases of ``texts`` (lang, text) that occur ``least`` times or more, with exact counts.

    Words stand for 64-bit hashes of language and word; all words of the corpus are
    compared by code, and if two share one, all starts again with another seed.
    Level by level: the tries of the frequent phrases of k words are broadcast and
    walked over all positions; accepting states are counted, and of neighbours
    that both begin such a phrase the pairs are counted too. Pairs that occur
    often enough are the candidates of k + 1 words: whatever is dropped has a part
    that is too rare, or is too rare itself. A candidate counts by the trie of its level.
    A trie holds about ``per_trie`` phrases of the longest length. If a level has
    more, phrases are dealt by the words that two neighbours share, and the texts are
    read once for each trie, so what is broadcast is bounded at every size. Single
    words share none: of them the texts are read once for each pair of tries.
    """
    seed = 0
    while True:
        counted = stored(word_counts(texts, seed))
        if counted.where("clash").isEmpty():
            break
        seed += 1
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = stored(counted.where(F.col("n") >= least).select("code", "lang", "word", "n"))
    level, tries = _numbered(words.select(F.array("code").alias("codes")), 1, per_trie)
    found = []
    for length in range(1, longest + 1):
        totals, pairs = [], []
        for i in range(tries):
            here = _trie(level, length, "here", "a", i)
            for j in range(tries) if length == 1 else [i]:
                same = tries == 1 or length == longest or (length == 1 and i == j)
                after = here if same else _trie(level, length, "after", "b", j)
                summed = stored(walked(texts, here, after, seed, count=length > 1, pair=length < longest).where(F.col("n") >= least))
                totals.append(summed.where("kind = 0").select(F.lit(i).alias("here"), F.col("key").alias("a"), "n"))
                pairs.append(summed.where("kind = 1").select(
                    F.lit(i).alias("here"), F.shiftright("key", 32).alias("a"), F.lit(j).alias("after"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("b")
                ))
        if length > 1:
            for total in totals:
                found.append(level.join(total, ["here", "a"]).select("codes", F.col("n").alias("f")))
        if not tries or length == longest:
            break
        joined = pairs[0]
        for more in pairs[1:]:
            joined = joined.union(more)
        left = level.select("here", "a", F.col("codes").alias("l"))
        right = level.select("after", "b", F.element_at("codes", -1).alias("r"))
        longer = joined.join(left, ["here", "a"]).join(right, ["after", "b"]).select(F.array_append("l", F.col("r")).alias("codes"))
        level, tries = _numbered(longer, length + 1, per_trie)
    phrases = words.sparkSession.createDataFrame([], "codes array<long>, f long")
    for more in found:
        phrases = phrases.union(more)
    return Counts(words, stored(sizes), stored(phrases))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, per_trie: int = TRIE) -> DataFrame:
    """The best-scoring phrases of 2 to 5 words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of count a, cut after k words into parts of counts l and r, scores
    floor(1000 a n / (l r)) with n the words of its language; the cut of least score
    counts, of equal ones the first. Phrases that lie inside a longer candidate that is as frequent are left
    out. Order: score and a descending, then the phrase by bytes.

    Null and empty texts have no words; a null lang is ``und``. Every row counts, repeated ones too.
    Other columns are not read. An empty table gives none.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of("text").alias("text"))
    words, sizes, phrases = count_phrases(texts, least, per_trie=per_trie)
    parts = phrases.union(words.select(F.array("code"), "n"))

    cuts = phrases.select("codes", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("k"))
    cuts = cuts.withColumn("lp", F.slice("codes", 1, F.col("k"))).withColumn("rp", F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")))
    cuts = cuts.join(parts.select(F.col("codes").alias("lp"), F.col("f").alias("l")), "lp")
    cuts = cuts.join(parts.select(F.col("codes").alias("rp"), F.col("f").alias("r")), "rp")
    cuts = cuts.withColumn("code", F.col("codes")[0]).join(words.select("code", "lang"), "code").join(sizes, "lang")
    score = F.expr("CAST(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(18, 0)) AS DECIMAL(38, 0)) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = cuts.groupBy("codes").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n", "lang")).alias("m"))

    inner = phrases.where(F.size("codes") > 2).select("f", F.col("codes").alias("long"))
    inner = inner.select("f", "long", F.explode(F.sequence(F.lit(2), F.size("long") - 1)).alias("size"))
    inner = inner.select("f", F.explode(F.transform(F.sequence(F.lit(1), F.size("long") - F.col("size") + 1), lambda i: F.slice("long", i, F.col("size")))).alias("codes"))
    covered = inner.groupBy("codes").agg(F.max("f").alias("longer"))
    kept = best.join(covered, "codes", "left").where("longer IS NULL OR 100 * longer < 100 * m.a")

    spelt = kept.select("codes", F.posexplode("codes").alias("i", "code")).join(words.select("code", "word"), "code")
    spelt = spelt.groupBy("codes").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelt = spelt.select("codes", F.array_join("w.word", " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.join(spelt, "codes").select("m.lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")
    out = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_query(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split CROSS JOIN range(1, {LONGEST + 1}) t(k))
  GROUP BY ALL
), sizes AS (SELECT lang, sum(f)::HUGEINT AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= {LEAST}),
cuts AS (
  SELECT o.lang, o.phrase, o.k, o.f AS a, c, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp
  FROM often o CROSS JOIN range(1, {LONGEST}) t(c) WHERE c < o.k
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.c, x.f AS l, y.f AS r, n, 1000 * c.a * n // (x.f * y.f) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.lp AND x.k = c.c
  JOIN often y ON y.lang = c.lang AND y.phrase = c.rp AND y.k = c.k - c.c JOIN sizes s ON s.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_parts AS (
  SELECT lang, f, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, f, w, size, unnest(range(1, k - size + 2)) AS i FROM often CROSS JOIN range(2, {LONGEST}) t(size) WHERE size < k)
), covered AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN covered c ON b.lang = c.lang AND b.phrase = c.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}
"""
