"""Byte-level BPE: encoding by segment trees over pair ranks, and decoding.

A text is split into words by the tokenizer's own pattern.  Each word starts as
its bytes.  A segment tree holds, for every pair of adjacent pieces, the rank of
their merge and where it is; so its root is the leftmost merge of lowest rank.
That merge changes three leaves, each a walk to the root, until the root says
that nothing merges.

The trees of many short words are rows of one array: each step applies one merge
to every word that still has one.  A word longer than ``ROW_BYTES`` has a tree of
its own.  Words come back often, so their ids are kept in two generations of a
fixed number of words: what is still in use when the younger is full moves on.

Defined results: NULL counts as empty and has no ids.  The literals of special
tokens become their ids, as the tokenizer library does it.  Bytes that are not
UTF-8 are read as U+FFFD.  Texts of any length are encoded whole, some
megabytes of words at a time, on the order of thirty bytes for each byte of the
longest word.  Repeated rows are encoded one by one, all other columns are kept
as they are, whatever their names; a column that has the name of the result is
replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from pairloom.llm.common import filled

ROW_BYTES = 64
CACHE_WORDS = 120_000
CACHED_CHARS = 64
STRETCH = 1 << 20
FLUSH_CHARS = 2 << 20
SLICE_ROWS = 512
NONE = np.int64(1) << 62
# A cut that no word crosses: one space between two characters that are none.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> str:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


class Merges:
    """Pair ranks of a vocabulary, and the merging of words by segment trees."""

    def __init__(self, vocab: dict[str, int], merges: list):
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        # Ranks of pairs of bytes, looked up by the bytes.
        self.of_bytes = self.ranks(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 where it has none."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as unsigned 32-bit little-endian bytes."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (2, 4, 8, 16, 32, ROW_BYTES):
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(which):
                for i, ids in zip(which.tolist(), self._rows([words[i] for i in which.tolist()], sizes[which], width)):
                    out[i] = ids
        for i in np.flatnonzero(sizes > ROW_BYTES).tolist():
            out[i] = self.single(words[i])
        return out

    def _rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        """Words of at most ``width`` bytes, one tree of ``width`` leaves for each."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        used = place < sizes[:, None]
        # One more column on each side stands for the ends of a word.
        ids = np.zeros((n, width + 2), np.int64)
        ids[:, 1:-1] = self.first[raw]
        after = np.minimum(place + 2, sizes[:, None] + 1)  # column of the next piece
        behind = np.zeros((n, width + 2), np.int64)
        behind[:, 1:-1] = place
        nxt = np.full((n, width + 2), 0, np.int64)
        nxt[:, 1:-1] = after
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.of_bytes[raw[:, :-1], raw[:, 1:]]
        tree[:, width : 2 * width - 1] = np.where(used[:, 1:] & (rank >= 0), rank * width + place[:-1], NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        alive = used.copy()
        end = sizes + 1
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root % width  # leaf of the pair, and of its left piece
            new = self.merged[root // width]
            gone = nxt[rows, at + 1]
            follow = nxt[rows, gone]
            ids[rows, at + 1] = new
            nxt[rows, at + 1] = follow
            behind[rows, follow] = at + 1
            alive[rows, gone - 1] = False
            has_next = follow < end[rows]
            rank = self.ranks(new, ids[rows, follow])
            self._put(tree, rows, at, np.where(has_next & (rank >= 0), rank * width + at, NONE), width)
            self._put(tree, rows, gone - 1, NONE, width)
            before = behind[rows, at + 1]
            some = np.flatnonzero(before)
            if len(some):
                r, b = rows[some], before[some]
                rank = self.ranks(ids[r, b], new[some])
                self._put(tree, r, b - 1, np.where(rank >= 0, rank * width + b - 1, NONE), width)
            rows = rows[tree[rows, 1] < NONE]
        flat = ids[:, 1:-1][alive].astype("<u4").tobytes()
        ends = (4 * alive.sum(1).cumsum()).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        """Set one leaf of each row and what lies above it."""
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def single(self, word: bytes) -> bytes:
        """One word of any length, with a tree of its own."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        raw = np.frombuffer(word, np.uint8)
        none = int(NONE)
        leaves = np.full(2 * width, NONE, np.int64)
        rank = self.of_bytes[raw[:-1], raw[1:]]
        leaves[width : width + n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), NONE)
        half = width
        while half > 1:
            leaves[half // 2 : half] = np.minimum(leaves[half : 2 * half : 2], leaves[half + 1 : 2 * half : 2])
            half //= 2
        tree = array("q", leaves.tobytes())
        ids = array("i", self.first[raw].astype("<i4").tobytes())
        nxt, behind = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        rank_of, merged, size = self.rank_of, self.merged, self.size

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                best = a if a < b else b
                if tree[node] == best:
                    return
                tree[node] = best

        def key(a: int, b: int) -> int:
            if a < 0 or b >= n:
                return none
            rank = rank_of.get(ids[a] * size + ids[b])
            return none if rank is None else rank * width + a

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = nxt[at]
            follow = nxt[at] = nxt[gone]
            ids[at] = merged[rank]
            ids[gone] = -1
            if follow < n:
                behind[follow] = at
            put(gone, none)
            put(at, key(at, follow))
            if behind[at] >= 0:
                put(behind[at], key(behind[at], at))
        kept = np.frombuffer(ids, np.int32)
        return kept[kept >= 0].astype("<u4").tobytes()


# Fixed value: the white space below ``HIGH`` (Python's own class has the separators 1C to 1F too).
WHITE = "\t\n\x0b\x0c\r \x85\xa0"
# Characters from here on are left to the full pattern, which is slower.
HIGH = "\u0530"
HIGHER = re.compile(f"[{HIGH}-\U0010ffff]")


def _plain_pattern() -> re.Pattern:
    """The tokenizer's pattern for texts of characters below ``HIGH``, with its classes spelled out."""
    kinds: dict[str, str] = {"L": "", "N": ""}
    for c in map(chr, range(ord(HIGH))):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind] += c
    letter, number = kinds["L"], kinds["N"]
    return re.compile(
        rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )


def _known_class(text: str) -> bool:
    """Whether this Python knows all characters; of others the pattern engine and the tokenizer may know different classes."""
    return all(unicodedata.category(c) != "Cn" for c in set(HIGHER.findall(text)))


class Decoder:
    """The bytes of every id of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        pieces = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]

    def decode(self, ids: bytes) -> str:
        """The text of ids; an id without a piece stands for nothing."""
        pieces = self.pieces
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.max() >= len(pieces):
            numbers = numbers[numbers < len(pieces)]
        parts = (numbers[a : a + STRETCH].tolist() for a in range(0, len(numbers), STRETCH))
        return b"".join(b"".join(map(pieces.__getitem__, part)) for part in parts).decode(errors="replace")


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.plain_split = _plain_pattern().findall
        self.library_split = tokenizer.pre_tokenizer.pre_tokenize_str
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = {s: struct.pack("<I", i) for s, i in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.literals = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, with the literals of special tokens between them, some at a time."""
        parts = self.literals.split(text) if self.literals else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield [part]
            elif part.isascii() or not HIGHER.search(part):
                yield from map(self.plain_split, stretches(part))
            elif _known_class(part):
                yield from map(self.split, stretches(part))
            else:
                yield [part[a:b] for _, (a, b) in self.library_split(part)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of these words, which are kept for the next texts."""
        ids = {w: self.special[w] for w in words & self.special.keys()}
        missing = []
        for w in words - ids.keys():
            known = self.known.get(w) or self.older.get(w)
            if known is None:
                missing.append(w)
            else:
                ids[w] = known
        ids.update(zip(missing, self.merges.encode([w.encode("utf-8", "replace") for w in missing])))
        return ids

    def keep(self, ids: dict[str, bytes]) -> None:
        self.known.update((w, i) for w, i in ids.items() if len(w) <= CACHED_CHARS)
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit little-endian bytes."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        chars = 0
        for text in texts:
            if len(text) > FLUSH_CHARS:
                out += self._flush(waiting)
                waiting, chars = [], 0
                out.append(b"".join(self._flush(self.words(text))))
                continue
            waiting.append([w for some in self.words(text) for w in some])
            chars += len(text)
            if chars > FLUSH_CHARS:
                out += self._flush(waiting)
                waiting, chars = [], 0
        return out + self._flush(waiting)

    def _flush(self, texts) -> list[bytes]:
        """Ids of lists of words; of a generator one list is held at a time."""
        if not isinstance(texts, list):
            return [ids for words in texts for ids in self._flush([words])]
        ids = self.learn(set().union(*texts))
        found = [b"".join(map(ids.__getitem__, words)) for words in texts]
        self.keep(ids)
        return found


def stretches(text: str) -> Iterator[str]:
    """A long text in parts that no word crosses."""
    first = 0
    while first < len(text):
        cut = CUT.search(text, first + STRETCH) if first + STRETCH < len(text) else None
        last = cut.start() if cut else len(text)
        yield text[first:last]
        first = last


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _mapped(rows: DataFrame, name: str, kind, work) -> DataFrame:
    """All columns of ``rows.row`` and the result of ``work`` on ``rows.value``."""
    out = StructType([rows.schema["row"], StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0), work(batch.column(1))], names=["row", name])

    return rows.mapInArrow(run, out).select("row.*", name)


def _rows(df: DataFrame, value, without: str) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in df.columns if c != without]
    return df.select(F.struct(*kept, *([] if kept else [F.lit(None).alias("_")])).alias("row"), value.alias("value"))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Add the ids of each text as unsigned 32-bit little-endian bytes."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(encoder(path).encode([t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()]), pa.binary())

    return _mapped(_rows(docs, filled(docs[text_col]), ids_col), ids_col, BinaryType(), work)


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Add the text of each row's ids; special tokens are their literals."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def work(ids: pa.Array) -> pa.Array:
        return pa.array([decoder(path).decode(i) for i in ids.to_pylist()], pa.string())

    return _mapped(_rows(docs, F.coalesce(docs[ids_col], F.lit(b"")), text_col), text_col, StringType(), work)


# --- the query --------------------------------------------------------------------------------------------------------


def digest(docs: DataFrame) -> DataFrame:
    decoded = decode(encode(docs.select("doc_id", "text")).select("doc_id", "ids"))
    return decoded.select(
        "doc_id",
        F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
