"""Operator 5, secret scans: fixed patterns and dictionary-primed compression novelty.

Base kinds are patterns, leftmost and non-overlapping per kind.  The added
kind ``novel`` reports strings that compression cannot explain: a candidate
(20 or more token characters, some letters and some digits) in a sensitive
context (a word such as key or credential shortly before it, or before a
candidate that it follows without letters or digits between) is compressed
after a dictionary of common identifiers and the text around it, without the
candidate's other occurrences; its marginal bytes, measured against
compressing that dictionary's context alone, must be at least ``novelty`` of
its length or, if less, of what its own characters cost when shuffled: long
strings of a small alphabet are Huffman coded, random or not.  Identifiers and
paths cost few bytes, random strings most of their length.

Spans are code points, end exclusive, of the whole match.

Defined results: null or empty texts have no spans; texts are scanned whole;
repeated rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # maximal runs, so the short ones need not be visited
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST_RATE = 0.5
CONTEXT = re.compile(r"key|secret|token|passw|passphrase|credential|auth|bearer|private|signature|session|cookie", re.I | re.A)
#: Words that code and settings are made of; what a candidate shares with them is not news.
IDENTIFIERS = (" access account action address admin agent algorithm api application argument array async attribute auth authorization base64 bearer binary buffer bucket build byte cache callback"
               " certificate channel class client cluster code column command comment commit common component config configuration connection const container content context controller cookie count"
               " create credential current cursor data database date debug default delete description digest directory document domain driver element email enable encode encoding endpoint engine entry"
               " environment error event example exception execute export expression field file filter format frame function gateway generate global group handler hash header height history host http"
               " https identifier image import include index input instance integer interface internal invalid item iterator json kernel key label language layer length level library license limit line"
               " list listener local location logger login manager map master match member memory message meta method metric middleware model module mutable name namespace network node null number object"
               " offset operation option order output owner package parameter parent parser password path pattern payload permission pipeline platform plugin pointer policy port position prefix primary"
               " private process product production profile project property protocol provider proxy public publish query queue random range record reference refresh region registry release remote render"
               " report request resource response result return role root route row schema scope script search secret section select sequence serial server service session setting shard sha256 signature"
               " size socket source stage standard state static status storage stream string structure subject submit suffix support switch symbol system table tag target task template test thread time"
               " timeout timestamp title token trace transaction transform type undefined unique update upload uri url user utf8 value variable vector version view virtual void volume window worker wrapper"
               " abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 ----------------").encode()


def marginal_bytes(candidate: str, context: str, level: int = 3) -> int:
    """Bytes that ``candidate`` adds to its compressed context."""
    primed = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS + context.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
    return len(primed.compress(candidate.encode())) - len(primed.compress(b""))


def surroundings(text: str, s: int, e: int, around: int) -> str:
    """The text around a candidate, other occurrences of it blanked, also those that the window cuts."""
    word, n = text[s:e], e - s
    blank = " " * n
    return text[max(0, s - around - n): s].replace(word, blank)[-around:] + text[e: e + around + n].replace(word, blank)[:around]


def is_novel(word: str, context: str, novelty: float) -> bool:
    cost, n = marginal_bytes(word, context), len(word)
    if cost >= novelty * n:
        return True
    # half a byte a character is what random hex needs; below that even an unexplained string holds little
    if cost < novelty * n * LEAST_RATE:
        return False
    shuffled = "".join(random.Random(n).sample(word, n))
    return cost >= novelty * min(n, max(marginal_bytes(shuffled, context), LEAST_RATE * n))


def scan(text: str, around: int = 200, before: int = 40, novelty: float = 0.75) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as in ``KINDS``."""
    found: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort()
    starts, reach = [s for s, _, _ in found], list(accumulate((e for _, e, _ in found), max))
    last, sensitive = 0, False
    for m in CANDIDATE.finditer(text):
        s, e, word = m.start(), m.end(), m[0]
        runs_on = sensitive and s - last <= before and not any(map(str.isalnum, text[last:s]))
        last, sensitive = e, runs_on or CONTEXT.search(text, max(0, s - before), s) is not None
        if not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
            continue
        earlier = bisect_left(starts, e)  # base spans that begin before its end
        if earlier and reach[earlier - 1] > s or not sensitive:
            continue
        if is_novel(word, surroundings(text, s, e, around), novelty):
            found.append((s, e, 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_novel, base_sha256, spans, found) of every row; found: array of (start, stop, kind)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "found"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                rows = [scan(t.as_py() or "", **limits) for t in b.column(1)]
                base = [_joined([x for x in r if x[2] != "novel"]) for r in rows]
                counts = [pa.array([sum(x[2] == k for x in r) for r in rows], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([_joined(r) for r in rows], pa.string()),
                                                  pa.array([[{"start": s, "stop": e, "kind": k} for s, e, k in r] for r in rows], kind)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, found array<struct<start: long, stop: long, kind: string>>")
