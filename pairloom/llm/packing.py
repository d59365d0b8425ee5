"""Best-fit packing by large-item matching.

Documents are tokenised, closed by a separator and cut where they are longer than
a sequence.  Which lengths go together depends on the number of pieces of each
length alone, so the plan is made of a table of at most ``capacity`` rows: pieces
above a third of the capacity are matched greedily, the longest with the longest
that fits, at most two to a sequence; shorter ones, longest first, go where they
leave the smallest gap, and open a new sequence only if there is no gap.  The plan
is a list of runs: so many pieces of one length, from which sequence on, at which
offset.  Its size is bounded by the capacity, whatever the number of pieces.

Pieces are then numbered within their length, in blocks over hash bits, and look
up their run.  No document is ever moved with its text.

Defined results: NULL counts as empty; an empty text is its separator.  Repeated
rows are packed one by one.  The numbers of sequences are dense from 0.  Texts of
any length are encoded whole and cut into pieces, none is dropped; columns that are
not named as keys are not read, and an empty table has no sequences.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from pairloom.llm.common import filled, materialize

CAPACITY = 2048
SEPARATOR = 0
CACHE_WORDS = 250_000
CACHED_BYTES = 64
STRETCH = 4 << 20


# --- tokens -----------------------------------------------------------------------------------------------------------


# Marks that end a word without being a part of it, and the first
# letter beyond the alphabets whose words are encoded without the whole pipeline.
END_MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
BEYOND = "\u0530"
SIGMA = "\u03a3"  # its lower case depends on where it stands
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


class WordIds(dict):
    """Ids of words, as unsigned 32-bit little-endian bytes, and by them those of texts.

    The tokenizer of this file lower-cases and drops white space before it merges,
    so a text's ids are those of its words in a row.  Words come back often; their
    ids are kept in two generations of a fixed number of short words each: when the
    younger is full it becomes the older, and what is still in use moves back.

    Letters and the marks behind them are merged apart.  A word of letters alone,
    or with marks at its end, goes straight to the merges; any other word goes
    through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a word gets its literals from lower-casing alone
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHED_BYTES:
            self[word] = ids
        return ids

    def encode(self, word: bytes) -> bytes:
        stem = word.rstrip(END_MARKS)
        if stem.isalpha() or not stem:  # on bytes, of ASCII letters alone
            plain = stem.decode()
        else:
            plain = stem.decode(errors="replace")
            if plain.isalpha() and max(plain) < BEYOND and SIGMA not in plain:
                plain = normalize("NFC", plain).lower()
            if not plain.isalpha() or max(plain) >= BEYOND or SIGMA in plain:
                return _packed(self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids)
            plain = plain.encode().decode("latin-1").translate(self.letters)
        ids = _packed([t.id for t in self.merge(plain)]) if plain else b""
        if len(stem) == len(word):
            return ids
        marks = word[len(stem) :]
        return ids + (self[marks] if stem else _packed([t.id for t in self.merge(marks.decode())]))

    def ids(self, text: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        if any(s in text for s in self.special):
            return _packed(self.whole.encode(text.decode(errors="replace"), add_special_tokens=False).ids)
        if len(text) <= STRETCH:
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join(b"".join(map(self.__getitem__, part.lower().split())) for part in stretches(text))


def stretches(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space; a word of any length stays whole."""
    first = 0
    while first < len(text):
        gap = WHITE.search(text, min(first + STRETCH, len(text)))
        last = gap.start() if gap else len(text)
        yield text[first:last]
        first = last


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(
    docs: DataFrame, text_col: str, *keys: Column, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Per piece: the key columns, ``piece, start, length, ids_crc32`` and, if wanted, ``ids`` as bytes."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(*keys, filled(docs[text_col]).alias("_text"))
    end = SEPARATOR.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_ids(path)
        for batch in batches:
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary())):
                ids = memoryview(encoder.ids(text.as_py()) + end)
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(bytes(part))
            which = pa.array(row, pa.int64())
            columns = [c.take(which) for c in batch.columns[:-1]]
            columns += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    own = [StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32"))]
    out = StructType([*[f for f in rows.schema.fields if f.name != "_text"], *own, *[StructField("ids", BinaryType())][: int(with_ids)]])
    return rows.mapInArrow(run, out)


# --- the plan ---------------------------------------------------------------------------------------------------------


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, pieces, first sequence, pieces per sequence, offset)``."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: runs of sequences
    rooms: list[int] = []
    opened = 0

    def place(size: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((size, used[size], n, first, per, offset))
        used[size] += n

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not gaps[room]:
                insort(rooms, room)
            gaps[room].append((first, n))

    left = {size: n for size, n in counts.items() if 3 * size > capacity and n}
    order = sorted(left)
    while order:
        long = order[-1]
        at = bisect_right(order, capacity - long) - 1
        if at >= 0 and order[at] == long and left[long] < 2:
            at -= 1
        if at < 0:  # nothing large fits beside it
            place(long, left[long], opened, 1, 0)
            leave(capacity - long, opened, left[long])
            opened += left[long]
            left[long] = 0
        else:
            short = order[at]
            n = left[long] // 2 if short == long else min(left[long], left[short])
            place(long, n, opened, 1, 0)
            place(short, n, opened, 1, long)
            leave(capacity - long - short, opened, n)
            opened += n
            left[long] -= n
            left[short] -= n
            if short != long and not left[short]:
                order.remove(short)
        if not left[long]:
            order.pop()

    for size in sorted((s for s, n in counts.items() if 3 * s <= capacity and n), reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                leave(capacity, opened, -(-n // (capacity // size)))
                opened += -(-n // (capacity // size))
                at = bisect_left(rooms, size)
            room = rooms[at]
            first, m = gaps[room].pop()
            if not gaps[room]:
                rooms.pop(at)
            per = room // size
            full = min(m, n // per)
            if full:
                place(size, full * per, first, per, capacity - room)
                leave(room - per * size, first, full)
                n -= full * per
            if n and full < m:  # the last few share one sequence
                place(size, n, first + full, n, capacity - room)
                leave(room - n * size, first + full, 1)
                full, n = full + 1, 0
            leave(room, first + full, m - full)
    return runs


def pack(items: DataFrame, order_cols: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset``.  Lengths lie between 1 and ``capacity``.

    ``order_cols`` tell pieces apart; rows equal in all of them are interchangeable.
    """
    counts = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    runs = sorted(plan(counts, capacity))
    table = np.array(runs, np.int64).reshape(-1, 6)
    bits = max(1, math.ceil(math.log2(math.sqrt(sum(counts.values()) + 1))))
    h = F.xxhash64(*order_cols)
    blocked = items.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))
    sums = blocked.groupBy(length_col, "_b").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(length_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(length_col, "_b", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(length_col, "_b").orderBy("_h", *order_cols)
    ranked = (
        blocked.withColumn("_r", F.row_number().over(inside))
        .join(starts, [length_col, "_b"])
        .withColumn("_rank", (F.col("_s") + F.col("_r") - 1).cast("long"))
        .select(*items.columns, "_rank")
    )
    where = items.columns.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            size = batch.column(where).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            hit = table[np.searchsorted(keys, size << 44 | rank, "right") - 1]
            nth = rank - hit[:, 1]
            sequence, offset = hit[:, 3] + nth // hit[:, 4], hit[:, 5] + nth % hit[:, 4] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=out.names)

    out = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(run, out)


# --- the query --------------------------------------------------------------------------------------------------------


def digest(docs: DataFrame) -> DataFrame:
    cut = materialize(pieces(docs, "text", F.col("doc_id")), "pieces")
    return pack(cut, ["doc_id", "piece", "start", "ids_crc32"])
