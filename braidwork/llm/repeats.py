"""Exact substring deduplication through prefix-free parsing.

A rolling hash over TRIGGER bytes sets triggers where it is the least of any
WIDTH-byte string around it, so every WIDTH-byte string holds a trigger, the
same one wherever it stands; triggers cut the text into phrases. A string is
then known by its trigger, the end of the phrase before it (the dictionary
side) and the text that goes on behind it (the parse side). A trigger and all
bytes that strings around it can hold are its context.

1. Chunks of texts tell which contexts they have (by digest) under which
   triggers, and the smallest id of each. A context that an earlier document has
   is a repeat as a whole; that decides the inside of every long repeat.
2. Where a trigger has several contexts, each context's first holder sends its
   bytes. Dictionary sides and parse sides are sorted each by itself; neighbours'
   common lengths give the classes of each side at every length, and a pair of
   classes is a place in corpus order: strings are equal exactly if both are.
3. Chunks mark what they were told and hash what remains.

Texts travel in chunks, compressed; what chunks and buckets of triggers tell
each other are packed arrays, so no row is made for a single trigger. A trigger
with many contexts (the edge of a passage in a third of all texts) would gather
them in one bucket; its strings are dealt by their own 64-bit hashes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH, TRIGGER = 50, 16
#: Bytes on either side of a trigger that strings around it can hold.
SIDE = WIDTH - TRIGGER
#: Bytes of text in a chunk; a longer text is a chunk by itself.
CHUNK = 2 << 20
#: Bytes that are parsed at a time, whatever a chunk's size.
BLOCK = 1 << 20
#: Contexts of one trigger, in a chunk and in all, from which on it is hot.
HOT_HERE, HOT = 32, 4096
_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_DIGEST = np.uint64((1 << 48) - 1)
_powers: list[np.ndarray] = []


def _squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(max(n, BLOCK + 2 * WIDTH + 2), base, np.uint64)
            out[0] = 1
            tables.append(np.cumprod(out, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Polynomial hashes of any strings of some bytes, by prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:n], dtype=np.uint64, out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Of the ``width`` bytes from each place on."""
        n = max(0, len(self.sums) - width)
        return _mix((self.sums[width:] - self.sums[:n]) * self.down[:n])

    def some(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


@dataclass
class Chunk:
    """Texts one after the other, with the id of each (or none)."""

    ids: np.ndarray
    known: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @staticmethod
    def pack(ids: list[int | None], texts: list[bytes]) -> bytes:
        head = np.array([len(ids)], np.int64)
        return _squeeze(head, np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8), level=5)

    @staticmethod
    def unpack(blob: bytes) -> Chunk:
        raw = _open(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, known = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint8, n, 8 + 8 * n) > 0
        size = np.frombuffer(raw[8 + 9 * n : 8 + 17 * n], np.int64)
        return Chunk(ids, known, np.cumsum(size), np.frombuffer(raw, np.uint8, -1, 8 + 17 * n))

    def parse(self, bits: int) -> None:
        """``at``: the triggers' places; ``doc``: the text of each; ``low``,
        ``high``: bytes of the text on either side that strings can hold;
        ``key``: 32 + bits bits of the trigger's hash, the upper ones name its
        bucket; ``digest``: 48 bits of the context's."""
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        use = (self.ends - self.begins >= WIDTH) & self.known
        first, last = self.begins[use], self.ends[use] - WIDTH  # first and last string of each text
        at, code, digest = [], [], []
        for begin in range(0, len(self.data) - WIDTH + 1, BLOCK):
            low, high = max(0, begin - SIDE), min(len(self.data), begin + BLOCK + SIDE + WIDTH)
            part = self.data[low:high]
            roll = Rolling(part)
            h = roll.every(TRIGGER)
            small = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            least = _slide(small, SIDE + 1, np.minimum)
            whole = np.zeros(len(least) + 1, np.int32)  # strings that lie in one text
            np.add.at(whole, np.clip(first - low, 0, len(least)), 1)
            np.add.at(whole, np.clip(last + 1 - low, 0, len(least)), -1)
            least[np.cumsum(whole[:-1]) <= 0] = 0
            edge = np.zeros(SIDE, np.uint32)
            most = _slide(np.concatenate([edge, least, edge]), SIDE + 1, np.maximum)
            here = np.flatnonzero(most == small)
            here = here[(here >= begin - low) & (here < begin - low + BLOCK)]
            place = here + low
            doc = np.searchsorted(self.ends, place, "right")
            side = np.minimum(SIDE, place - self.begins[doc]), np.minimum(SIDE, self.ends[doc] - place - TRIGGER)
            at.append(place)
            code.append(h[here])
            digest.append(_mix(roll.some(here - side[0], here + TRIGGER + side[1]) + side[0].astype(np.uint64) * np.uint64(_BASE)))
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.ends, self.at, "right")
        self.low = np.minimum(SIDE, self.at - self.begins[self.doc])
        self.high = np.minimum(SIDE, self.ends[self.doc] - self.at - TRIGGER)
        self.key = (np.concatenate(code) if code else np.zeros(0, np.uint64)) >> np.uint64(32 - bits)
        self.digest = (np.concatenate(digest) if digest else np.zeros(0, np.uint64)) & _DIGEST

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (key, digest) in order, the smallest id of each, and which
        one each trigger has."""
        order = np.lexsort((self.digest, self.key))
        key, digest = self.key[order], self.digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        first = np.flatnonzero(new)
        own = np.empty(len(order), np.int64)
        own[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[self.doc[order]], first) if len(first) else np.zeros(0, np.int64)
        return key[first], digest[first], least, own

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """The bytes of the triggers' contexts, and the lengths of both sides."""
        span = np.arange(-SIDE, WIDTH)
        rows = np.zeros((len(which), SIDE + WIDTH + 2), np.uint8)
        for k in range(0, len(which), 1 << 14):
            w = which[k : k + (1 << 14)]
            inside = (span >= -self.low[w][:, None]) & (span < TRIGGER + self.high[w][:, None])
            rows[k : k + len(w), :-2] = np.where(inside, self.data[np.clip(self.at[w][:, None] + span, 0, len(self.data) - 1)], 0)
        rows[:, -2], rows[:, -1] = self.low[which], self.high[which]
        return rows

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All strings around the triggers ``which``: hash and smallest id of
        each distinct one; places; which distinct one each place has."""
        back, found = np.arange(SIDE + 1), [np.zeros(0, np.int64)]
        for k in range(0, len(which), 1 << 14):
            w = which[k : k + (1 << 14)]
            whole = (back <= self.low[w][:, None]) & (SIDE - back <= self.high[w][:, None])
            found.append(np.unique((self.at[w][:, None] - back)[whole]))
        places = np.unique(np.concatenate(found))
        hashes = np.zeros(len(places), np.uint64)
        for begin in range(0, len(self.data), BLOCK):
            a, b = np.searchsorted(places, [begin, begin + BLOCK])
            if a < b:
                hashes[a:b] = Rolling(self.data[begin : begin + BLOCK + WIDTH]).every(WIDTH)[places[a:b] - begin]
        distinct, own = np.unique(hashes, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, own, self.ids[np.searchsorted(self.ends, places, "right")])
        return np.stack([distinct.view(np.int64), least], 1), places, own


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _spread(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(first, n)))


def _lexical(rows: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The order of byte rows, eight bytes at a time; ``first`` goes before."""
    wide = -(-rows.shape[1] // 8)
    words = np.zeros((len(rows), wide * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8").astype(np.uint64)
    keys = [words[:, k] for k in range(wide - 1, -1, -1)]
    return np.lexsort(keys + ([first] if first is not None else []))


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row, in ``order``, shares with the one before it."""
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 1 << 16):
        a, b = rows[order[k - 1 : k - 1 + (1 << 16)]], rows[order[k : k + (1 << 16)]]
        differ = a[: len(b)] != b
        out[k : k + len(b)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def corpus_classes(contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each context and each number of bytes before its trigger, the
    smallest id among contexts that hold the same string.

    The dictionary side is trigger and phrase read backwards, the parse side
    what goes on; each is sorted once. At length k, a side's classes change
    where neighbours share fewer than k bytes.
    """
    body, low, high = contexts[:, :-2], contexts[:, -2], contexts[:, -1]
    phrase = np.concatenate([body[:, SIDE:WIDTH], body[:, :SIDE][:, ::-1]], axis=1)
    goes_on = body[:, WIDTH:]
    dictionary, parse = _lexical(phrase), _lexical(goes_on)
    shared_d, shared_p = _common(phrase, dictionary), _common(goes_on, parse)
    least = np.full((len(ids), SIDE + 1), np.iinfo(np.int64).max)
    d, p = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    for k in range(SIDE + 1):
        use = np.flatnonzero((low >= k) & (high >= SIDE - k))
        if not len(use):
            continue
        d[dictionary] = np.cumsum(shared_d < TRIGGER + k)
        p[parse] = np.cumsum(shared_p < SIDE - k)
        key = d[use] * (len(ids) + 1) + p[use]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low_ids = np.minimum.reduceat(ids[use][order], first)
        least[use[order], k] = np.repeat(low_ids, np.diff(np.append(first, len(key))))
    return least


# --- the steps, as functions over Arrow batches ---------------------------------

# Kinds of messages.
ENTRIES, CONTEXTS, STRINGS, HOT_KEYS = 0, 1, 2, 3

_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_MESSAGE_SQL = "bucket int, kind int, chunk long, blob binary"


def _rows(messages: list[tuple[int, int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for m in messages:
        held.append(m)
        size += len(m[3])
        if size >= most or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)


def _pack(size: int):
    schema = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py() or b""
                if ids and held + len(text) > size:
                    yield pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([Chunk.pack(ids, texts)], pa.binary())], schema=schema)
                    ids, texts, held, n = [], [], 0, n + 1
                ids.append(i.as_py())
                texts.append(text)
                held += len(text)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([Chunk.pack(ids, texts)], pa.binary())], schema=schema)

    return run


def _parts(bucket: np.ndarray) -> list[tuple[int, slice]]:
    cut = [*_runs(bucket).tolist(), len(bucket)]
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cut, cut[1:], strict=False)]


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64)


def _told(told: dict[tuple[int, int], bytes], kind: int, bucket: int, n: int) -> np.ndarray:
    raw = told.get((kind, bucket))
    return np.unpackbits(np.frombuffer(_open(raw), np.uint8))[:n].astype(bool) if raw else np.zeros(n, bool)


def _open_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys' lower 32 bits, digests, ids, and keys that are hot already."""
    raw = _open(blob)
    n, hot, base = np.frombuffer(raw, np.int64, 3)
    at = 24
    out = []
    for kind, count in ((np.uint32, n), (np.uint32, n), (np.uint16, n), (np.uint32, hot), (np.int64, n)):
        out.append(np.frombuffer(raw[at : at + count * np.dtype(kind).itemsize], kind))
        at += count * np.dtype(kind).itemsize
    rest, lower, upper, hot_keys, ids = out
    return np.cumsum(rest, dtype=np.uint32), lower.astype(np.uint64) | (upper.astype(np.uint64) << np.uint64(32)), ids + base, hot_keys


def _plain(key: np.ndarray, here: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose trigger is not hot in this chunk, and the keys that are."""
    first = _runs(key)
    many = np.diff(np.append(first, len(key))) >= here
    return ~_spread(many, first, len(key)), key[first[many]]


def _tell(bits: int, here: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = Chunk.unpack(blob)
                texts.parse(bits)
                key, digest, least, _ = texts.entries()
                plain, hot = _plain(key, here)
                key, digest, least = key[plain], digest[plain], least[plain]
                own, out = dict(_parts(_bucket(key))), []
                hot_parts = dict(_parts(_bucket(hot)))
                for b in sorted({*own, *hot_parts}):
                    s, t = own.get(b, slice(0, 0)), hot_parts.get(b, slice(0, 0))
                    rest = key[s].astype(np.uint32)
                    base = int(least[s].min()) if len(rest) else 0
                    out.append((b, ENTRIES, chunk, _squeeze(np.array([len(rest), len(hot[t]), base]), np.diff(rest, prepend=np.uint32(0)), digest[s].astype(np.uint32), (digest[s] >> np.uint64(32)).astype(np.uint16), hot[t].astype(np.uint32), least[s] - base)))
                yield from _rows(out)

    return run


def _by_bucket(answer):
    """Rows come sorted by bucket and kind; ``answer`` gets all of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, kind, chunk, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, kind) != now:
                    if held:
                        yield from _rows(answer(*now, held))
                    now, held = (bucket, kind), []
                held.append((chunk, blob))
        if held:
            yield from _rows(answer(*now, held))

    return run


def _meet_entries(most: int):
    def answer(bucket: int, _: int, held: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bytes]]:
        """To each chunk: which of its entries an earlier document has (bits),
        which it is the first to hold and has to send (bits), which keys are hot."""
        opened = [_open_entries(b) for _, b in held]
        key, digest, ids = (np.concatenate([o[k] for o in opened]) for k in range(3))
        said = np.unique(np.concatenate([o[3] for o in opened]))
        order = np.lexsort((digest, key))
        k, d, i = key[order], digest[order], ids[order]
        n = len(k)
        entry = np.ones(n, bool)
        entry[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        first, group = np.flatnonzero(entry), _runs(k)
        least = _spread(np.minimum.reduceat(i, first), first, n) if n else i
        low = _spread(np.minimum.reduceat(least, group), group, n) if n else i
        high = _spread(np.maximum.reduceat(least, group), group, n) if n else i
        several = _spread(np.add.reduceat(entry.astype(np.int64), group), group, n) if n else i
        hot = (several >= most) | _among(k, said)
        covered, sends = np.empty(n, bool), np.empty(n, bool)
        covered[order] = (i > least) & ~hot
        sends[order] = (i == least) & (low != high) & ~hot
        hot_keys = np.union1d(said, k[hot])
        out, at = [], 0
        for (chunk, _b), o in zip(held, opened, strict=True):
            span = slice(at, at + len(o[0]))
            at += len(o[0])
            mine = hot_keys[_among(hot_keys, np.union1d(o[0], o[3]))]
            for kind, flags in ((ENTRIES, covered[span]), (CONTEXTS, sends[span])):
                if flags.any():
                    out.append((bucket, kind, chunk, _squeeze(np.packbits(flags))))
            if len(mine):
                out.append((bucket, HOT_KEYS, chunk, mine.tobytes()))
        return out

    return answer


@dataclass
class Heard:
    """A chunk's entries and what it was told about them."""

    covered: np.ndarray
    sends: np.ndarray
    hot: np.ndarray
    least: np.ndarray
    own: np.ndarray
    key: np.ndarray

    @staticmethod
    def of(texts: Chunk, told: dict[tuple[int, int], bytes], here: int) -> Heard:
        key, _, least, own = texts.entries()
        keys = [np.frombuffer(b, np.uint32).astype(np.uint64) + (np.uint64(bucket) << np.uint64(32)) for (kind, bucket), b in told.items() if kind == HOT_KEYS]
        hot = _among(key, np.sort(np.concatenate(keys))) if keys else np.zeros(len(key), bool)
        covered, sends = np.zeros(len(key), bool), np.zeros(len(key), bool)
        plain = np.flatnonzero(_plain(key, here)[0])
        for b, s in _parts(_bucket(key[plain])):
            n = s.stop - s.start
            covered[plain[s]], sends[plain[s]] = _told(told, ENTRIES, b, n), _told(told, CONTEXTS, b, n)
        return Heard(covered, sends, hot, least, own, key)

    def senders(self, texts: Chunk) -> np.ndarray:
        """One trigger, in the first document, for each entry to be sent."""
        mine = np.flatnonzero(self.sends[self.own] & (texts.ids[texts.doc] == self.least[self.own]))
        entry = self.own[mine]
        order = np.argsort(entry, kind="stable")
        return mine[order][_runs(entry[order])]


def _string_buckets(strings: np.ndarray, bits: int) -> np.ndarray:
    return (strings[:, 0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _told_by(messages: list[dict] | None) -> dict[tuple[int, int], bytes]:
    return {(m["kind"], m["bucket"]): m["blob"] for m in messages or []}


def _ask(bits: int, here: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, messages in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                told = _told_by(messages)
                if not any(kind in (CONTEXTS, HOT_KEYS) for kind, _ in told):
                    continue
                texts = Chunk.unpack(blob)
                texts.parse(bits)
                heard, out = Heard.of(texts, told, here), []
                which = heard.senders(texts)
                rows = texts.contexts(which)
                ids = texts.ids[texts.doc[which]]
                out += [(b, CONTEXTS, chunk, _squeeze(ids[s], rows[s])) for b, s in _parts(_bucket(texts.key[which]))]
                many = np.flatnonzero(heard.hot[heard.own])
                if len(many):
                    strings, _, _ = texts.strings(many)
                    strings = strings[np.argsort(strings[:, 0].view(np.uint64))]
                    out += [(b, STRINGS, chunk, _squeeze(np.ascontiguousarray(strings[s].T))) for b, s in _parts(_string_buckets(strings, bits))]
                yield from _rows(out)

    return run


def _meet_contexts(bucket: int, kind: int, held: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """To each chunk, in the order it asked: for each string, whether an earlier
    document has it; for strings of hot triggers, the smallest id."""
    raw = [_open(b) for _, b in held]
    if kind == STRINGS:
        own = [np.frombuffer(r, np.int64).reshape(2, -1) for r in raw]
        every, at = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
        least = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(least, at, np.concatenate([x[1] for x in own]))
        cut = np.cumsum([x.shape[1] for x in own])[:-1]
        return [(bucket, kind, chunk, _squeeze(least[a])) for (chunk, _), a in zip(held, np.split(at, cut), strict=True)]
    wide = SIDE + WIDTH + 2
    sizes = [len(r) // (8 + wide) for r in raw]
    ids = np.concatenate([np.frombuffer(r, np.int64, n) for r, n in zip(raw, sizes, strict=True)])
    rows = np.concatenate([np.frombuffer(r, np.uint8, -1, 8 * n).reshape(n, wide) for r, n in zip(raw, sizes, strict=True)])
    earlier = corpus_classes(rows, ids) < ids[:, None]
    return [(bucket, kind, chunk, _squeeze(np.packbits(x))) for (chunk, _), x in zip(held, np.split(earlier, np.cumsum(sizes)[:-1]), strict=True)]


_REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, text_bytes binary"


def _marked(texts: Chunk, told: dict[tuple[int, int], bytes], answers: dict[tuple[int, int], bytes], bits: int, here: int) -> np.ndarray:
    """Which bytes go."""
    change = np.zeros(len(texts.data) + WIDTH + 1, np.int32)  # strings that go, as steps
    heard = Heard.of(texts, told, here)
    ids = texts.ids[texts.doc]
    # A context of an earlier document here or elsewhere: all its strings go.
    full = np.flatnonzero((heard.covered[heard.own] | (ids > heard.least[heard.own])))
    far, near = np.minimum(SIDE, texts.low[full]), np.maximum(0, SIDE - texts.high[full])
    some = far >= near
    np.add.at(change, texts.at[full][some] - far[some], 1)
    np.add.at(change, texts.at[full][some] - near[some] + 1, -1)
    which = heard.senders(texts)
    if len(which):
        parts = [np.unpackbits(np.frombuffer(_open(answers[CONTEXTS, b]), np.uint8))[: (s.stop - s.start) * (SIDE + 1)].reshape(-1, SIDE + 1) for b, s in _parts(_bucket(texts.key[which]))]
        earlier = np.zeros((len(heard.key), SIDE + 1), bool)
        earlier[heard.own[which]] = np.concatenate(parts).astype(bool)
        # The first document may hold the context more than once.
        first = np.flatnonzero(heard.sends[heard.own] & (ids == heard.least[heard.own]))
        i, j = np.nonzero(earlier[heard.own[first]])
        np.add.at(change, texts.at[first][i] - j, 1)
        np.add.at(change, texts.at[first][i] - j + 1, -1)
    many = np.flatnonzero(heard.hot[heard.own])
    if len(many):
        strings, places, own = texts.strings(many)
        order = np.argsort(strings[:, 0].view(np.uint64))
        least = np.empty(len(strings), np.int64)
        least[order] = np.concatenate([np.frombuffer(_open(answers[STRINGS, b]), np.int64) for b, _ in _parts(_string_buckets(strings[order], bits))])
        go = places[least[own] < texts.ids[np.searchsorted(texts.ends, places, "right")]]
        np.add.at(change, go, 1)
        np.add.at(change, go + 1, -1)
    starts = np.flatnonzero(np.cumsum(change) > 0)
    edge = np.zeros(len(texts.data) + WIDTH + 1, np.int32)
    edge[starts] += 1
    edge[starts + WIDTH] -= 1
    return np.cumsum(edge)[: len(texts.data)] > 0


def _remove(bits: int, here: int, texts_too: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text_bytes"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, messages, answers in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                texts = Chunk.unpack(blob)
                texts.parse(bits)
                gone = _marked(texts, _told_by(messages), _told_by(answers), bits, here)
                rows = []
                for k, (a, b) in enumerate(zip(texts.begins.tolist(), texts.ends.tolist(), strict=True)):
                    body, cut = texts.data[a:b], gone[a:b]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                    kept = body[~cut].tobytes() if len(turn) else body.tobytes()
                    rows.append((int(texts.ids[k]) if texts.known[k] else None, b - a, int(cut.sum()), len(turn) // 2, hashlib.sha256(kept).hexdigest(), turn.astype(np.int64).tobytes(), kept if texts_too else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame, texts_too: bool = False, chunk: int = CHUNK, here: int = HOT_HERE, hot: int = HOT) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    spans`` (pairs of little-endian longs, begin and end) and, if asked for, the
    remaining bytes as ``text_bytes``.

    A byte goes if a WIDTH-byte string that covers it also starts in a document
    with a smaller id. A null text counts as empty; a row without an id keeps
    its text and takes nothing from others; rows of one id take nothing from
    each other; an empty table gives an empty result.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("data"))
    chunks = written(rows.mapInArrow(_pack(chunk), "chunk long, blob binary"), "parse-chunks")
    # Buckets grow with the chunks, so that what meets in one stays as large.
    bits = int(min(20, max(8, np.ceil(np.log2(max(1, chunks.count()))))))
    deal = lambda df: df.repartition("bucket", "kind").sortWithinPartitions("bucket", "kind", "chunk")
    entries = deal(chunks.mapInArrow(_tell(bits, here), _MESSAGE_SQL)).mapInArrow(_by_bucket(_meet_entries(hot)), _MESSAGE_SQL)
    told = written(entries, "parse-entries")

    def per_chunk(messages: DataFrame, name: str) -> DataFrame:
        return messages.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kind", "blob")).alias(name))

    beside = chunks.join(per_chunk(told, "told"), "chunk", "left").select("chunk", "blob", "told")
    asked = deal(beside.mapInArrow(_ask(bits, here), _MESSAGE_SQL)).mapInArrow(_by_bucket(_meet_contexts), _MESSAGE_SQL)
    answers = written(asked, "parse-contexts")
    every = beside.join(per_chunk(answers, "answers"), "chunk", "left").select("chunk", "blob", "told", "answers")
    return every.mapInArrow(_remove(bits, here, texts_too), _REMOVED)
