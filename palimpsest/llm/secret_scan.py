"""Secret scans: fixed rules, and formats learned from what the rules find.

The rules' finds are labelled credentials. From a bounded sample of their distinct values a
probabilistic automaton is inferred for each kind, and one more from the words of all documents.
Every other run that has a letter is then scored by its likelihood under each kind's format: a secret
is one that is about as likely there as the kind's own examples are, and far likelier than as a word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from palimpsest.llm.automata import CLASSES, Automaton, infer
from palimpsest.llm.common import arrow_map, checkpoint, table, texts

KINDS = ("assign", "access", "hex", "format")
#: The rules.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: What may be a credential without a rule that says so: a run with a letter, of parts that single dots join. Digits alone are numbers.
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-]\.)(?=(?:[0-9+/_=-]|\.(?!\.))*[A-Za-z])[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
WORD = re.compile(rb"[A-Za-z][A-Za-z0-9_-]{3,}")
#: Distinct examples of a kind, and of words, that an automaton is inferred from, and the longest that are.
EXAMPLES, LONGEST_EXAMPLE = 400, 256
#: How many powers of ten likelier a credential must be than a word.
MARGIN = 3.0
#: Powers of ten that it costs an ordinary run to be made of one more piece.
JOIN = 1.0
#: Of a kind's own examples so many are at least as likely, a character, as a candidate must be, give or take SLACK powers of ten.
SHARE, SLACK = 0.98, 0.15
#: Shapes whose scores a task remembers at once, and the longest that it does.
REMEMBERED, LONGEST_REMEMBERED = 1 << 17, 64
_PIECE = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_BETWEEN_WORDS = bytes(c if chr(c).isalnum() and c < 128 or c in b"_-" else 32 for c in range(256))
_SYMBOLS = bytes(ord(CLASSES.get(chr(c), chr(c))) for c in range(256))


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, first byte, byte after) of the rules' finds, in order of start, then of kind."""
    out = []
    if b"=" in text or b":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs that could be credentials and that no rule's find touches; ``found`` is in order of start."""
    out, at, reach = [], 0, 0
    for a, b in (m.span() for m in CANDIDATE.finditer(text)):
        while at < len(found) and found[at][1] < b:
            reach = max(reach, found[at][2])
            at += 1
        if reach <= a:
            out.append(("format", a, b))
    return out


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return spans if text.isascii() else [(k, len(text[:a].decode()), len(text[:b].decode())) for k, a, b in spans]


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def labelled_value(kind: str, match: bytes) -> str:
    """The credential itself in a rule's find."""
    return (ASSIGN.match(match)[2] if kind == "assign" else match).decode()


class LeastHashed:
    """The distinct values with the least hashes among all that were added; two such samples merge into their union's."""

    def __init__(self, size: int):
        self.size, self.hashes, self.limit = size, {}, 1 << 64

    def add(self, values: set[bytes] | list[bytes]) -> None:
        for v in values:
            if (h := xxh64_intdigest(v)) < self.limit and v not in self.hashes and len(v) <= LONGEST_EXAMPLE:
                self.hashes[v] = h
                if len(self.hashes) >= 2 * self.size:
                    self.hashes = dict(sorted(self.hashes.items(), key=lambda x: x[1])[: self.size])
                    self.limit = max(self.hashes.values())


class LeastHashedWords(LeastHashed):
    def add(self, values: set[bytes] | list[bytes]) -> None:
        super().add([v for v in values if xxh64_intdigest(v) < self.limit and WORD.fullmatch(v)])


def examples(docs: DataFrame, size: int = EXAMPLES) -> dict[str, list[str]]:
    """By kind, and of ``word``: at most ``size`` distinct values over all documents, those with the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: LeastHashed(size) for k in KINDS[:3]} | {"word": LeastHashedWords(size)}
        for b in batches:
            words: set[bytes] = set()
            for text in texts(b):
                at, rest = 0, []
                for kind, x, y in base_spans(text):
                    found[kind].add([labelled_value(kind, text[x:y]).encode()])
                    rest.append(text[at:x])
                    at = max(at, y)
                words.update(b" ".join([*rest, text[at:]]).translate(_BETWEEN_WORDS).split())
            found["word"].add(words)
        rows = [(k, v.decode(), h - (1 << 63)) for k, f in found.items() for v, h in f.hashes.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "value", "hash"])

    sampled = checkpoint(docs.select("text").mapInArrow(run, "kind string, value string, hash long").distinct())
    out = {}
    for kind in (*KINDS[:3], "word"):
        if rows := sampled.where(F.col("kind") == kind).orderBy("hash", "value").limit(size).collect():
            out[kind] = [r["value"] for r in rows]
    return out


@dataclass(frozen=True)
class Format:
    """A kind's automaton, and how likely, a character, a candidate must be under it."""

    automaton: Automaton
    least: float


def formats(values: dict[str, list[str]]) -> dict[str, Format]:
    """A format for each kind that has examples, and for ``word``."""
    out = {}
    for kind, own in values.items():
        automaton = infer(own)
        likely = sorted((automaton.log10(v) / (len(v) + 1) for v in own), reverse=True)
        out[kind] = Format(automaton, likely[int(SHARE * (len(likely) - 1))] - SLACK)
    return out


def log10_as_ordinary(value: str, words: Automaton) -> float:
    """As a word, or as words, numbers and marks joined: dates, names of files, versions and the like."""
    joined = -JOIN
    for piece in _PIECE.findall(value):
        joined -= JOIN
        if piece.isalpha():
            joined += words.log10(piece.lower() if piece.isupper() or piece[1:].islower() else piece)
        else:
            joined -= len(piece)
    return max(words.log10(value), joined)


def is_credential(value: str, known: dict[str, Format]) -> bool:
    if "word" not in known or len(known) == 1:
        return False
    likely = [x for k, f in known.items() if k != "word" and (x := f.automaton.log10(value)) >= f.least * (len(value) + 1)]
    return bool(likely) and max(likely) - log10_as_ordinary(value, known["word"].automaton) >= MARGIN


def by_format(text: bytes, found: list[tuple[str, int, int]], automata: dict[str, Format], known: dict[bytes, bool]) -> list[tuple[str, int, int]]:
    """The candidates that are credentials. ``known`` remembers answers by shape, on which alone they depend."""
    if "word" not in automata or len(automata) == 1:
        return []
    out = []
    for s in candidates(text, found):
        value = text[s[1] : s[2]]
        shape = value.translate(_SYMBOLS)
        if (answer := known.get(shape)) is None:
            answer = is_credential(value.decode(), automata)
            if len(shape) <= LONGEST_REMEMBERED:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[shape] = answer
        if answer:
            out.append(s)
    return out


def learned(docs: DataFrame) -> dict[str, Format]:
    return formats(examples(docs))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs`` (doc_id, text).

    ``spans`` adds to the rules' finds those that only their format gives away, kind
    ``format``. Positions are code points, the end exclusive.

    Edge cases: a null or empty text has no finds, empty ``spans`` and the checksum of
    nothing; repeated rows are scanned each; where the rules find nothing at all there is
    nothing to learn and no span is added; an empty table gives no rows; other columns are ignored.
    """
    automata, known = learned(docs), {}

    def batch(b: pa.RecordBatch) -> pa.Table:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
            own = base_spans(text)
            more = by_format(text, own, automata, known)
            counts = [sum(s[0] == k for s in own) for k in KINDS[:3]]
            rows.append((doc_id, *counts, hashlib.sha256(shown(in_code_points(text, own)).encode()).hexdigest(), shown(in_code_points(text, in_order(own + more)))))
        return pa.table(list(map(list, zip(*rows, strict=True))), schema=pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def mask(text: bytes, automata: dict[str, Format], mark: bytes, known: dict[bytes, bool]) -> bytes:
    """The text with every find, by rule or by format, replaced by ``mark``; finds that overlap count as one."""
    found = base_spans(text)
    found = in_order(found + by_format(text, found, automata, known))
    out, at = [], 0
    for _, a, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return b"".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; no row goes, and a null text stays null.

    Where there is an ``n_chars``, it becomes the new length of the texts that change.
    """
    schema, replace = docs.schema, partial(mask, automata=learned(docs), mark=mark.encode(), known={})

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        i = b.schema.get_field_index("text")
        old = b.column(i).cast(pa.binary()).to_pylist()
        clean = [None if t is None else replace(t) for t in old]
        b = b.set_column(i, b.schema.field(i), pa.array(clean, pa.binary()).cast(b.schema.field(i).type))
        if (k := b.schema.get_field_index("n_chars")) < 0:
            return b
        sizes = [n if new == t else len(new.decode()) for n, t, new in zip(b.column(k).to_pylist(), old, clean, strict=True)]
        return b.set_column(k, b.schema.field(k), pa.array(sizes, b.schema.field(k).type))

    return arrow_map(docs, batch, schema)
