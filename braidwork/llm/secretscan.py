"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

A candidate stands near a sensitive word or goes on from one that does. Zstandard, primed with a dictionary
of identifiers and with the text around the candidate, compresses that text
with and without it; the bytes the candidate adds, over its length, are its
novelty. Names, paths and words found nearby add little; key material adds
almost its entropy and is reported as kind ``novel``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the contract and what their matches must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the length can stand in the pattern
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words that make a context sensitive, and identifiers that prime the compressor.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential", "private_key", "private key", "access_key", "access key", "authorization", "bearer")
IDENTIFIERS = (
    "username user_name password passwd passphrase secret client_secret client_id token access_token refresh_token id_token api_key apikey "
    "authorization bearer basic credential credentials private_key public_key access_key secret_access_key aws_access_key_id connection_string "
    "database_url localhost hostname endpoint https http www config settings environment production development staging test example default "
    "required optional invalid expired missing change_me changeme placeholder your_password_here your_token_here your_api_key_here none null true "
    "false undefined string integer boolean return function class import export public static void self this request response session header "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000 1234567890 -----BEGIN PRIVATE KEY----- "
)
_SENSITIVE = re.compile("|".join(re.escape(w) for w in SENSITIVE), re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Letters that most words have many of, and changes from small to capital: letters alone
#: are key material with few of the first and this many of the second.
_VOWEL, _RISE, RISES, VOWELS = re.compile(r"[aeiouAEIOU]"), re.compile(r"[a-z][A-Z]"), 4, 0.27
#: Characters before and after a sensitive word that are its context, and around a candidate that prime the compressor.
AROUND = 512
#: What may stand between lines of one key.
_JOINT = re.compile(r"""[\s"'\\nr,;>|#*.]{1,32}""")
#: Letters of one case that make a repeated candidate a name.
_NAME = re.compile(r"[a-z]{16,}|[A-Z]{16,}")
#: Bytes added for each character of a candidate; base64 of random bytes adds 0.75 and more, hex 0.5 and more.
NOVELTY = 0.45


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novelty(before: str, candidate: str, after: str) -> float:
    """Bytes that ``candidate`` adds to its surroundings, for each character."""
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() + before.encode("utf-8", "replace") + after.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=19, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)
    tail = before[-32:]
    return (len(coder.compress((tail + candidate).encode("utf-8", "replace"))) - len(coder.compress(tail.encode("utf-8", "replace")))) / len(candidate)


def _without(text: str, core: str, cut_left: bool, cut_right: bool) -> str:
    """``text`` without copies of ``core``, whole or cut off at an end that is cut."""
    left = text.replace(core, " ")
    left = left[len(core) - 1 :] if cut_left else left
    return left[: len(left) - len(core) + 1] if cut_right else left


def _key_like(body: str) -> bool:
    """Letters and digits, or letters alone that are no words joined by capitals."""
    if not _LETTER.search(body):
        return False
    return bool(_DIGIT.search(body)) or (len(_RISE.findall(body)) >= RISES and len(_VOWEL.findall(body)) < VOWELS * len(body))


def _candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters, divided at the sensitive words inside them."""
    starts = [a for a, _ in words]
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        for k in range(max(0, bisect_left(starts, at) - 1), len(words)):
            a, b = words[k]
            if a >= m.end():
                break
            if b > at:
                if a - at >= 16:
                    yield at, a
                at = b
        if m.end() - at >= 16:
            yield at, m.end()


def novel_spans(text: str, taken: list[tuple[int, int, int]], least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that no fixed pattern touches, and
    every further occurrence of what they hold.

    A context is AROUND characters before and after a sensitive word, and goes
    on through candidates that only a joint divides. Copies of the candidate do
    not prime the compressor.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    found, cores, last, was_novel = [], {}, -1, False
    for a, b in _candidates(text, words):
        k, n = bisect_right(ends, a) - 1, bisect_left(starts, b)
        joined = last >= 0 and bool(_JOINT.fullmatch(text, last, a))
        if not (joined or (k >= 0 and a - ends[k] <= AROUND) or (n < len(words) and starts[n] - b <= AROUND)):
            continue
        last, goes_on, was_novel = b, joined and was_novel, False
        body = text[a:b]
        if any(x < b and a < y for x, _, y in taken):
            continue
        if not goes_on and not _key_like(body):
            continue
        core = body.strip("=_-+/") or body
        lo, hi = max(0, a - AROUND - len(core)), min(len(text), b + AROUND + len(core))
        before, after = text[lo:a], text[b:hi]
        if _NAME.search(core) and (core in before or core in after):
            before, after = before[-AROUND:], after[:AROUND]
        else:
            before, after = _without(before, core, lo > 0, False), _without(after, core, False, hi < len(text))
        if core in cores or novelty(before, body, after) >= least:
            found.append((a, 3, b))
            cores[core] = None
            was_novel = True
    held = sorted((a, b) for a, _, b in [*taken, *found])
    for core in cores:
        at = text.find(core)
        while len(core) >= 16 and at >= 0:
            end = at + len(core)
            k = bisect_left(held, (end, 0))
            if not any(x < end and at < y for x, y in held[max(0, k - 8) : k]):
                found.append((at, 3, end))
                insort(held, (at, end))
            at = text.find(core, end)
    return found


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_text(text: str | None) -> tuple[int, int, int, str, str, int]:
    text = text or ""
    base = base_spans(text)
    novel = novel_spans(text, base)
    count = [sum(k == x for _, k, _ in base) for x in range(3)]
    return (*count, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + novel)), len(novel))


_OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, without a shuffle. A null text counts as empty; ids
    may be null or repeat, and repeated rows each have a row; a very long text
    is scanned whole; other columns, whatever their names, are not read; an
    empty table gives an empty result."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names])

    return kept.mapInArrow(run, f"doc_id {kind}, {_OUT}")
