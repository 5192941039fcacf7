"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Patterns of lengths come from ``pack_plan`` over the histogram of piece lengths, which
has at most ``capacity`` rows. A piece finds its place by its length and its number among
the pieces of that length, so places are dealt out by Spark and no task packs alone.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, checkpoint, table, texts
from palimpsest.llm.pack_plan import plan
from palimpsest.llm.sharding import number_slots

CAPACITY = 2048
END = b"\0\0\0\0"
#: Words, and parts of words, whose ids a Python worker keeps, and the longest of them in bytes; beyond that it begins anew.
CACHED_WORDS = 200_000
CACHED_PARTS = 400_000
LONGEST_CACHED = 64
#: Words that are learned at once.
LEARNED_AT_ONCE = 4096
#: Words that are left to the tokenizer: with an apostrophe, perhaps a special token, or a letter beyond U+027F; up to that one,
#: no letter combines with its neighbours or changes case by context.
ODD = re.compile(rb"[\xca-\xff']|<\|")
#: The letters and numbers of all other words in lower case.
LETTERS, NUMBERS = ("".join(regex.findall(kind, "".join(sorted({c for i in range(0x280) for c in chr(i).lower()})))) for kind in (r"\p{L}", r"\p{N}"))
#: How this tokenizer cuts lower-case words without an apostrophe; the space stands between words.
PARTS = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|\x20|[^\x20\x85\xa0{LETTERS}{NUMBERS}]+")
#: Between words' ids: no four bytes of ids are like this, since an id's upper two are 0.
BETWEEN = b"\xff\xff\xff\xff"

#: How byte-level models show a byte: as itself where that can be seen, else by a letter from U+0100 on.
_SEEN = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
BYTE_LETTERS = {c: chr(256 + i) for i, c in enumerate(sorted(set(range(256)) - set(_SEEN)))}

_encoders: dict = {}


def _packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Parts(dict):
    """Words' parts -> ids, as little-endian uint32 bytes; others than long ones stay."""

    def __init__(self, model):
        super().__init__({" ": BETWEEN})
        self.model = model
        self.packed = [i.to_bytes(4, "little") for i in range(1 << 16)]

    def __missing__(self, p: str) -> bytes:
        shown = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])
        if len(shown) <= LONGEST_CACHED:
            self[p] = ids
        return ids


class WordEncoder:
    """Words to ids, as little-endian uint32 bytes. Each worker process has one.

    This tokenizer drops white space and never joins what stands on its two sides, so a
    text's ids are those of its words in turn; likewise a plain word's are those of its
    parts (letters, a digit, or other characters). Both are kept, since words repeat.
    New words are cut side by side, as one text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts = Parts(self.tokenizer.model)

    def learn(self, new: set[bytes]) -> None:
        words = list(new)
        for i in range(0, len(words), LEARNED_AT_ONCE):
            some = words[i : i + LEARNED_AT_ONCE]
            if ODD.search(text := b" ".join(some)):
                odd = [w.decode() for w in some if ODD.search(w)]
                for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                    self.words[w.encode()] = _packed(e.ids)
                if not (some := [w for w in some if not ODD.search(w)]):
                    continue
                text = b" ".join(some)
            ids = b"".join(map(self.parts.__getitem__, PARTS.findall(text.decode().lower())))
            self.words.update(zip(some, ids.split(BETWEEN), strict=True))

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Each text's ids and id 0 after them."""
        out = []
        for i in range(0, len(batch), 64):
            known = self.words
            if len(known) > CACHED_WORDS:
                known.clear()
            if len(self.parts) > CACHED_PARTS:
                self.parts = Parts(self.tokenizer.model)
            some = [text.split() for text in batch[i : i + 64]]
            found = [list(map(known.get, own)) for own in some]
            gaps = [[k for k, ids in enumerate(x) if ids is None] if None in x else [] for x in found]
            new = {own[k] for own, empty in zip(some, gaps, strict=True) for k in empty}
            self.learn(new)
            for own, x, empty in zip(some, found, gaps, strict=True):
                for k in empty:
                    x[k] = known[own[k]]
                x.append(END)
                out.append(b"".join(x))
            for w in new:
                if len(w) > LONGEST_CACHED:
                    del known[w]
        return out


def encode(batch: list[bytes], tokenizer_file: str) -> list[bytes]:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file].encode(batch)


def tokenised_pieces(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents' ids, cut where they exceed ``capacity``."""
    path = tokenizer_file or default_tokenizer()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def batch(b: pa.RecordBatch) -> pa.Table:
        rows, parts = [], []
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(texts(b), path), strict=True):
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                parts += [part] * with_ids
        out = pa.table(list(map(list, zip(*rows, strict=True))), schema=pa.schema(fields))
        if not with_ids:
            return out
        ends = np.cumsum([0, *(r[3] for r in rows)], dtype=np.int32)
        return out.append_column("ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), batch, schema)


def places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, numbers, first sequence, offset): where pieces of a length go, by their number."""
    out, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for lengths, times in plan(histogram, capacity):
        offset = 0
        for length in lengths:
            out.append((length, taken[length], times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text): (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    Edge cases: a null, empty or blank text is the one id 0; longer documents than
    ``capacity`` are cut into pieces of it, the last as long as the rest; rows that repeat
    are packed each; numbers among equal lengths follow hashes and ids, so ties never
    matter; an empty table gives no rows; other columns are ignored.
    """
    pieces = checkpoint(tokenised_pieces(docs, tokenizer_file, capacity, with_ids))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    where = docs.sparkSession.createDataFrame(places(histogram, capacity), "length long, first long, times long, sequence long, offset long")
    numbered = number_slots(pieces, "length", ["doc_id", "piece", "ids_crc32"], ["doc_id", "piece"])
    # The places depend on the capacity and the plan, not on the number of documents.
    placed = numbered.join(F.broadcast(where), (numbered["length"] == where["length"]) & (F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("first") + F.col("times")))
    return placed.select("doc_id", "piece", "start", numbered["length"], "ids_crc32", (F.col("sequence") + F.col("slot") - F.col("first")).alias("sequence_id"), "offset", *["ids"] * with_ids)


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
