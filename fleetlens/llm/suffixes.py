"""Repeated strings across documents, by prefix-free parsing of the corpus.

Every 50-byte string has a trigger: of its 24-grams the one of least rolling hash. The strings that start next to each other and
share a trigger form a phrase; the phrases of a text are its parse. Equal strings have equal triggers at equal places, so

1. a trigger that occurs in one document only rules out all its strings;
2. equal phrases are one entry of the dictionary, kept with the smallest document: their strings repeat in all the others;
3. what is left are suffixes of dictionary phrases whose trigger also stands in other phrases (the borders of copies). Only
   these are ranked one by one.

Order beyond 50 bytes plays no part, so a suffix is ranked by a fingerprint of its first 50 bytes. Each step is a shuffle of
fingerprints, packed per task and bucket; answers go back to the documents by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a repeated string, and of the grams whose hashes choose the triggers.
LENGTH, GRAM = 50, 24
#: Text bytes per bucket of fingerprints: a task of a shuffle step holds about a fifth of it.
BUCKET_BYTES = 32 << 20
#: Text bytes parsed at once, and gathered before fingerprints are sent.
PIECE, BATCH = 1 << 18, 16 << 20

_WIDTH = LENGTH - GRAM + 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64; made once per worker, for a piece and what may overhang it."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 4096)
        have = _TABLES[base] = (_powers(base, size), _powers(pow(base, -1, 2**64), size))
    return have


class Rolling:
    """Hashes of any substrings of ``data`` by prefix sums (Karp and Rabin, modulo 2**64)."""

    def __init__(self, data: np.ndarray, base: int):
        power, self.inverse = _tables(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


@dataclass
class Parse:
    """Phrases of a piece: index of the text, first and last start of their strings (in the piece), trigger hash."""

    data: np.ndarray
    rolling: Rolling
    offset: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    trigger: np.ndarray
    second: list = field(default_factory=list)

    def other(self) -> Rolling:
        if not self.second:
            self.second.append(Rolling(self.data, _BASES[1]))
        return self.second[0]

    def phrases(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent fingerprints of phrases: of their bytes, and where in them the strings start."""
        low, high, at = self.low[which], self.high[which], self.at[which]
        place = _mixed((at - low).astype(np.uint64) * np.uint64(64) + (high - low).astype(np.uint64))
        return tuple(_mixed(r.between(low, high + LENGTH) ^ place) for r in (self.rolling, self.other()))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, start and two fingerprints of every string of the phrases."""
        low, n = self.low[which], self.high[which] - self.low[which] + 1
        phrase = np.repeat(which, n)
        start = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return phrase, start, *(r.between(start, start + LENGTH) for r in (self.rolling, self.other()))


def parsed(texts: list[bytes]) -> Iterator[Parse]:
    """The parse of texts of at least 50 bytes, piece by piece; a long text is continued in the next piece."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1] if len(text) > PIECE else text
            if len(part) < LENGTH:
                continue
            if parts and size + len(part) > PIECE:
                yield _parse(parts)
                parts, size = [], 0
            parts.append((i, at, part))
            size += len(part)
    if parts:
        yield _parse(parts)


def _parse(parts: list[tuple[int, int, bytes]]) -> Parse:
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    starts = np.cumsum(sizes) - sizes
    rolling = Rolling(data, _BASES[0])
    grams = rolling.grams(GRAM)
    # of equal hashes the last position is the least: the order then depends on the content alone
    least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    width = 1
    while 2 * width <= _WIDTH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _WIDTH:
        least = np.minimum(least[: len(least) - (_WIDTH - width)], least[_WIDTH - width :])
    at = (_LOW - (least & _LOW)).astype(np.int64)
    cuts = np.concatenate([np.nonzero(np.diff(at))[0] + 1, starts, starts + sizes - LENGTH + 1])
    cuts = np.unique(cuts)
    low, high = cuts, np.append(cuts[1:], len(data)) - 1
    part = np.searchsorted(starts, low, side="right") - 1
    real = low <= (starts + sizes - LENGTH)[part]
    low, high, part = low[real], high[real], part[real]
    text = np.array([i for i, _, _ in parts])[part]
    offset = np.array([a for _, a, _ in parts])[part] - starts[part]
    return Parse(data, rolling, offset, text, low, high, at[low], _mixed(grams[at[low]]))


#: Text bytes per slot of documents: what a task holds when it reads answers.
SLOT_BYTES = 8 << 20

ASK = "bucket int, kind string, docs binary, counts binary, keys binary, extra binary"
TOLD = "slot int, kind string, docs binary, counts binary, keys binary, extra binary"
_TYPES = {"trigger": np.uint32, "phrase": np.uint64, "border": np.uint32, "string": np.uint64, "span": np.uint64}


_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _slot_column(doc_id: Column, slots: int) -> Column:
    folded = doc_id.bitwiseXOR(F.shiftright(doc_id, 15)).bitwiseXOR(F.shiftright(doc_id, 31))
    return F.pmod(folded, F.lit(slots)).cast("int")


def _slot_of(docs: np.ndarray, slots: int) -> np.ndarray:
    return (docs ^ (docs >> 15) ^ (docs >> 31)) % slots


def _low32(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _six(x: np.ndarray) -> np.ndarray:
    """The six high bytes of each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def _ask(kind: str, bucket: np.ndarray, doc: np.ndarray, keys: np.ndarray, extra: np.ndarray | None = None) -> list[tuple]:
    """One row per bucket with fingerprints and the documents that ask about them."""
    order = np.lexsort((doc, bucket))
    bucket, doc, keys = bucket[order], doc[order], keys[order]
    extra = extra[order] if extra is not None else None
    cuts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            docs, counts = np.unique(doc[a:b], return_counts=True)
            rows.append((
                int(bucket[a]), kind, docs.astype(np.int64).tobytes(), counts.astype(np.int32).tobytes(), keys[a:b].tobytes(),
                extra[a:b].tobytes() if extra is not None else b"",
            ))
    return rows


def _tell(kind: str, doc: np.ndarray, keys: np.ndarray, slots: int, extra: np.ndarray | None = None) -> list[tuple]:
    """One row per slot with its documents and the fingerprints they are told about."""
    order = np.lexsort((doc, _slot_of(doc, slots)))
    doc, keys = doc[order], keys[order]
    extra = extra[order] if extra is not None else None
    slot = _slot_of(doc, slots)
    cuts = np.concatenate([[0], np.nonzero(np.diff(slot))[0] + 1, [len(slot)]])
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            docs, counts = np.unique(doc[a:b], return_counts=True)
            more = extra[a:b].tobytes() if extra is not None else b""
            rows.append((int(slot[a]), kind, docs.tobytes(), counts.astype(np.int32).tobytes(), keys[a:b].tobytes(), more))
    return rows


def _known(kind: str, doc: np.ndarray, keys: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> list[tuple]:
    """What a task finds out on its own, sent along as told already."""
    if not len(doc):
        return []
    order = np.argsort(doc, kind="stable")
    docs, counts = np.unique(doc, return_counts=True)
    more = extra[order].tobytes() if extra is not None else b""
    return [(int(docs[0] % buckets), f"{kind}!", docs.tobytes(), counts.astype(np.int32).tobytes(), keys[order].tobytes(), more)]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys (first key first), and where a new group starts in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


def _least_per(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the smallest document with its key."""
    order, new = _groups(key, doc)
    first, _ = _groups_start(key[order])
    out = np.empty(len(doc), doc.dtype)
    out[order] = doc[order][first]
    return out


def _groups_start(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first and last row of each row's group of equal keys."""
    n = len(sorted_key)
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    starts = np.nonzero(new)[0]
    ends = np.append(starts[1:], n) - 1
    number = np.cumsum(new) - 1
    return starts[number], ends[number]


def _ask_triggers(docs: np.ndarray, texts: list[bytes], told: list[dict], buckets: int) -> list[tuple]:
    hashes, doc = [], []
    for piece in parsed(texts):
        hashes.append(piece.trigger)
        doc.append(docs[piece.text])
    if not hashes:
        return []
    h, d = np.concatenate(hashes), np.concatenate(doc)
    order, new = _groups(h, d)
    h, d = h[order][new], d[order][new]  # a document once per trigger
    first, last = _groups_start(h)
    many = first != last
    here = np.arange(len(h))
    send = (here == first) | (here == last)  # smallest and largest document speak for the others
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    rows = _ask("trigger", bucket[send], d[send], _low32(h[send]))
    return rows + _known("trigger", d[many & ~send], _low32(h[many & ~send]), buckets)


def _ask_phrases(docs: np.ndarray, texts: list[bytes], told: list[dict], buckets: int) -> list[tuple]:
    found: list[tuple] = []
    for piece in parsed(texts):
        low = _low32(piece.trigger)
        which = np.nonzero(_told_mask(piece, told, "trigger", low))[0]
        found.append((docs[piece.text[which]], piece.trigger[which], *piece.phrases(which)))
    if not found:
        return []
    d, h, c, c2 = (np.concatenate(x) for x in zip(*found, strict=True))
    least = _least_per(c, d)
    rows = _known("phrase", d[d > least], c[d > least], buckets)
    first = d == least
    d, h, c, c2 = d[first], h[first], c[first], c2[first]
    order, new = _groups(c, h)
    d, h, c, c2 = (x[order][new] for x in (d, h, c, c2))  # one of the equal phrases of the smallest document
    rows += _ask("phrase", (c2 % np.uint64(buckets)).astype(np.int64), d, c)
    order, _ = _groups(h, c)
    d, h, c = d[order], h[order], c[order]
    start, end = _groups_start(h)
    here = np.arange(len(h))
    send = (here == start) | (here == end)
    rows += _known("border", d[(start != end) & ~send], _low32(h[(start != end) & ~send]), buckets)
    d, h, c = d[send], h[send], c[send]
    return rows + _ask("border", ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), d, _low32(h), _six(c))


def _ask_strings(docs: np.ndarray, texts: list[bytes], told: list[dict], buckets: int) -> list[tuple]:
    """Also sends along the spans of the phrases that repeat whole."""
    found, spans, rows = [], [], []
    for piece in parsed(texts):
        whole, borders = _whole_and_borders(piece, told)
        if len(whole):
            offset = piece.offset[whole]
            spans.append((piece.text[whole], piece.low[whole] + offset, piece.high[whole] + offset + LENGTH))
        if len(borders):
            phrase, _, w, w2 = piece.strings(borders)
            found.append((docs[piece.text[phrase]], w, w2))
    if spans:
        text, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
        # spans that touch become one; texts come in order, and ends grow with starts
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (start[1:] > end[:-1])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(text)) - 1
        keys = start[first].astype(np.uint64) << np.uint64(32) | end[last].astype(np.uint64)
        owner = np.array([_fingerprint(texts[i]) for i in text[first]], np.uint64)  # as rows may share a doc_id
        rows += _known("span", docs[text[first]], keys, buckets, owner)
    if found:
        d, w, w2 = (np.concatenate(x) for x in zip(*found, strict=True))
        order, new = _groups(w, d)
        d, w, w2 = d[order][new], w[order][new], w2[order][new]
        first, _ = _groups_start(w)
        more = first != np.arange(len(w))
        rows += _known("string", d[more], w[more], buckets)
        rows += _ask("string", (w2[~more] % np.uint64(buckets)).astype(np.int64), d[~more], w[~more])
    return rows


def _told_mask(piece: Parse, told: list[dict], kind: str, keys: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Which keys (of phrases of the piece, or of those named) their document was told about."""
    text = piece.text if rows is None else piece.text[rows]
    mask = np.zeros(len(keys), bool)
    cuts = np.concatenate([[0], np.nonzero(np.diff(text))[0] + 1, [len(text)]]) if len(text) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        have = told[text[a]].get(kind)
        if have is not None:
            at = np.searchsorted(have, keys[a:b])
            mask[a:b] = have[np.minimum(at, len(have) - 1)] == keys[a:b]
    return mask


def _whole_and_borders(piece: Parse, told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that smaller documents have whole, and others whose trigger stands in other phrases too."""
    texts = np.unique(piece.text)
    asked = texts[[bool(told[i]) for i in texts]]
    which = np.nonzero(np.isin(piece.text, asked))[0]
    if not len(which):
        return which, which
    c, _ = piece.phrases(which)
    whole = _told_mask(piece, told, "phrase", c, which)
    rest = which[~whole]
    return which[whole], rest[_told_mask(piece, told, "border", _low32(piece.trigger[rest]), rest)]


def _told(rows: pd.DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """What each document of a slot was told: sorted fingerprints per kind."""
    out: dict[int, dict[str, np.ndarray]] = {}
    for kind, own in rows.groupby("kind"):
        docs, counts = (np.frombuffer(b"".join(own[c]), t) for c, t in (("docs", np.int64), ("counts", np.int32)))
        keys = np.frombuffer(b"".join(own["keys"]), _TYPES[kind])
        doc = np.repeat(docs, counts)
        order = np.lexsort((keys, doc))
        doc, keys = doc[order], keys[order]
        if kind == "span":
            keys = np.stack([keys, np.frombuffer(b"".join(own["extra"]), np.uint64)[order]], axis=1)
        cuts = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1, [len(doc)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                out.setdefault(int(doc[a]), {})[kind] = keys[a:b]
    return out


@dataclass
class Sizes:
    """Buckets of fingerprints and slots of documents: both follow the bytes of the corpus."""

    buckets: int
    slots: int


def _requests(docs: list, texts: list, told: list, ask, sizes: Sizes) -> pd.DataFrame:
    rows = ask(np.array(docs, np.int64), texts, told, sizes.buckets) if docs else []
    return pd.DataFrame(rows, columns=_names(ASK))


def _first_requests(sizes: Sizes):
    def requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if text is None or len(text) < LENGTH:
                    continue
                docs.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= BATCH:
                    yield _requests(docs, texts, [], _ask_triggers, sizes)
                    docs, texts, size = [], [], 0
        yield _requests(docs, texts, [], _ask_triggers, sizes)

    return requests


def _next_requests(ask, sizes: Sizes):
    """The documents of a slot that were told something ask again."""

    def requests(texts: pa.Table, answers: pa.Table) -> pa.Table:
        told = _told(answers.to_pandas())
        pairs = zip(texts["doc_id"].to_pylist(), texts["text"], strict=True)
        rows = [(d, t.as_py(), told[d]) for d, t in pairs if d in told and t.is_valid]
        rows = [r for r in rows if len(r[1]) >= LENGTH]
        made = _requests(*([r[i] for r in rows] for i in range(3)), ask, sizes)
        return pa.Table.from_pandas(made, schema=_arrow(ASK), preserve_index=False)

    return requests


def _answers(slots: int):
    """Over requests sorted by bucket and kind: one bucket's fingerprints of one kind at a time."""

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def done(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=_names(TOLD))

        for batch in batches:
            for bucket, kind, *row in batch.itertuples(index=False):
                if kind.endswith("!"):
                    docs, counts = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int32)
                    keys = np.frombuffer(row[2], _TYPES[kind[:-1]])
                    extra = np.frombuffer(row[3], np.uint64) if row[3] else None
                    yield done(_tell(kind[:-1], np.repeat(docs, counts), keys, slots, extra))
                    continue
                if now != (bucket, kind):
                    if held:
                        yield done(_answered(now[1], held, slots))
                    now, held = (bucket, kind), []
                held.append(row)
        if held:
            yield done(_answered(now[1], held, slots))

    return answers


def _answered(kind: str, held: list, slots: int) -> list[tuple]:
    doc = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.int32)) for d, n, _, _ in held])
    key = np.frombuffer(b"".join(k for _, _, k, _ in held), _TYPES[kind])
    second = doc
    if kind == "border":
        six = np.frombuffer(b"".join(e for _, _, _, e in held), np.uint8).reshape(-1, 6)
        second = np.ascontiguousarray(np.pad(six, ((0, 0), (2, 0)))).view("<u8").ravel()
    order, _ = _groups(key, second)
    key, second, doc = key[order], second[order], doc[order]
    first, last = _groups_start(key)
    if kind in ("trigger", "border"):  # with another document, or another phrase
        yes = second[first] != second[last]
    else:  # in a smaller document
        yes = doc[first] < doc
    return _tell(kind, doc[yes], key[yes], slots)


def _removed(text: bytes, told: dict[str, np.ndarray]) -> np.ndarray:
    """Mask of the bytes that repeat from smaller documents: spans of phrases, and single strings."""
    edges = np.zeros(len(text) + 1, np.int32)
    if "span" in told:
        spans = told["span"][told["span"][:, 1] == np.uint64(_fingerprint(text)), 0]
        np.add.at(edges, (spans >> np.uint64(32)).astype(np.int64), 1)
        np.add.at(edges, (spans & np.uint64(0xFFFFFFFF)).astype(np.int64), -1)
    if "string" in told:
        for at in range(0, len(text) - LENGTH + 1, PIECE):
            data = np.frombuffer(text[at : at + PIECE + LENGTH - 1], np.uint8)
            start = np.nonzero(np.isin(_mixed(Rolling(data, _BASES[0]).grams(LENGTH)), told["string"]))[0] + at
            np.add.at(edges, start, 1)
            np.add.at(edges, start + LENGTH, -1)
    return np.cumsum(edges)[:-1] > 0


def with_removed(
    docs: DataFrame, schema: str, finish, bucket_bytes: int = BUCKET_BYTES, slot_bytes: int = SLOT_BYTES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of ``docs``: doc_id and what ``finish(bytes or None, mask of the bytes to remove)`` makes of its text.

    A byte goes if a 50-byte string over it also starts in a document of smaller doc_id. Null and short texts lose
    nothing; rows without doc_id neither lose bytes nor make others lose any; rows sharing a doc_id are parts of one
    document. Only doc_id and text are read; columns named in ``carry`` travel with the text and are in the result as
    the struct ``carried``. An empty table gives none.

    Fingerprints have 64 bits beside the bucket, which is chosen by independent bits and grows with the corpus.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    sizes = Sizes(max(1, -(-total // bucket_bytes)), max(1, -(-total // slot_bytes)))
    known = docs.where("doc_id IS NOT NULL").select(doc_id, text, *carried)
    placed = known.withColumn("slot", _slot_column(F.col("doc_id"), sizes.slots))
    placed = placed.groupBy("slot")  # one shuffle of the texts, used by the three steps that read answers

    def answered(asked: DataFrame) -> DataFrame:
        dealt = asked.repartition(sizes.buckets, "bucket").sortWithinPartitions("bucket", "kind")
        return dealt.mapInPandas(_answers(sizes.slots), TOLD)

    told = answered(known.select("doc_id", "text").mapInPandas(_first_requests(sizes), ASK))
    for ask in (_ask_phrases, _ask_strings):
        told = answered(placed.cogroup(told.groupBy("slot")).applyInArrow(_next_requests(ask, sizes), ASK))
    made_schema = _arrow(schema)

    def finished(texts: pa.Table, answers: pa.Table) -> pa.Table:
        told = _told(answers.to_pandas())
        made = []
        for doc, t in zip(texts["doc_id"].to_pylist(), texts["text"], strict=True):
            t = t.as_py()
            made.append(finish(t, _removed(t or b"", told.get(doc, {}))))
        columns = [pa.array([row[i] for row in made], f.type) for i, f in enumerate(made_schema)]
        out = {"doc_id": texts["doc_id"], **dict(zip(made_schema.names, columns, strict=True))}
        return pa.table(out | ({"carried": texts["carried"]} if carry else {}))

    def untouched(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([finish(t, np.zeros(len(t or b""), bool)) for t in texts], columns=made_schema.names)

    kinds = StructType.fromDDL(f"doc_id long, {schema}")
    if carry:
        kinds = kinds.add(docs.select(*carried).schema[0])
    out = placed.cogroup(told.groupBy("slot")).applyInArrow(finished, kinds)
    as_is = F.pandas_udf(untouched, schema).asNondeterministic()  # else a filter on the result calls it once more
    nameless = docs.where("doc_id IS NULL").select(doc_id, as_is(text).alias("r"), *carried)
    return out.unionByName(nameless.select("doc_id", "r.*", *(["carried"] if carry else [])))


def _digest(text: bytes | None, removed: np.ndarray) -> tuple:
    text = text or b""
    kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
    spans = int(np.count_nonzero(np.diff(removed.astype(np.int8), prepend=np.int8(0)) == 1))
    return len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def whole_characters(removed: np.ndarray, text: bytes) -> np.ndarray:
    """The mask without characters that would lose only some of their bytes: the rest stays valid UTF-8."""
    if not removed.any() or removed.all():
        return removed
    data = np.frombuffer(text, np.uint8)
    number = np.cumsum((data & 0xC0) != 0x80)
    lost = np.bincount(number, weights=removed)
    return (lost == np.bincount(number))[number]


def _cut(text: bytes | None, removed: np.ndarray) -> tuple:
    """Whether anything is cut, and the text that is left."""
    if text is None:
        return False, None
    gone = whole_characters(removed, text)
    return bool(gone.any()), np.frombuffer(text, np.uint8)[~gone].tobytes()


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut from ``text`` and ``n_chars`` set to what is left.

    Characters are cut whole or not at all. Documents of which nothing is left go; those that were null or empty before
    stay. Other columns stay as they are and travel with the text, so no text is shuffled to join them.
    """
    others = tuple(c for c in docs.columns if c != "text")
    made = with_removed(docs, "cut boolean, rest binary", _cut, carry=others).where("NOT cut OR octet_length(rest) > 0")
    text = F.col("rest").cast("string")
    columns = {c: F.col("carried")[c] for c in others} | {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in others:
        left = F.length(text).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("cut"), left).otherwise(columns["n_chars"])
    return made.select(*(columns[c].alias(c) for c in docs.columns))


def op5_query(docs: DataFrame) -> DataFrame:
    return with_removed(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", _digest)
