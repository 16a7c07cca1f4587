"""Best-fit packing with bound-certified repacking.

Documents are tokenized, ended by an end id, and only those longer than a sequence are cut. Each group of pieces, at first
what a task reads, is packed by best-fit decreasing, and a lower bound from dual feasible functions certifies its number of
bins: equal numbers mean that no packing of these pieces is better. A group is settled if it is certified and its gaps come
to no more than a SETTLED part of its bins; a certified group with larger gaps, such as one of few pieces, can still share
bins with others. The bins with gaps of groups that aren't settled are dealt to new groups, which rerun best-fit decreasing
over the documents in them and keep the result where it needs fewer bins. Rounds end when all groups are settled, when the
number of bins equals the lower bound of all pieces, when the open bins have met in one group, or when a round has saved
less than a LEAST_GAIN part of the open bins.

Defined cases: a null text is empty and has just the end id; repeated rows and equal lengths are packed one by one; an
empty table gives no rows; a very long text gives as many pieces as it needs; the columns made here replace columns of the
same names. Bins with fewer than GAP free places are closed at once, which costs that many places a bin at most.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import boxed, in_slices, materialize, unboxed, without

CAPACITY = 4096
END_ID = 1
#: Bins with fewer free places than this are closed at once.
GAP = 16
#: Pieces that are packed together.
CHUNK = 100_000
#: Free places of a certified group that needn't be filled, and bins that a round must save, by share.
SETTLED = LEAST_GAIN = 0.001
#: Distinct words of a generation; a Python worker remembers the ids of two of them; the process then took 240 MB (190 MB at 100,000).
WORDS_KEPT = 250_000
PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
)
PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
MADE = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")

_tokenizers: dict[tuple[str, int | None], WordTokenizer] = {}


#: How a tokenizer that _plain_pieces() stands for cuts lower-cased text, and its other steps.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
#: Words of printable ASCII and of Latin letters that no normalization changes, and their pieces in lower case.
PLAIN = re.compile(r"[!-~\u00c0-\u012f\u0131-\u017f]+\Z")
_LETTER = r"a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {**{b: chr(b) for b in prints}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class WordTokenizer:
    """Ids of a tokenizer that treats what stands between ASCII spaces independently: those of a word are remembered.

    Where the tokenizer's steps are SPLIT and STEPS, words of plain letters are cut here, and only its model is asked, once
    for each piece; all other words go through the tokenizer itself.
    """

    def __init__(self, path: str, words_kept: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words_kept = words_kept or WORDS_KEPT
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = byte_letters()
        steps = json.loads(self.tokenizer.to_str())
        names = tuple([x["type"] for x in (steps[k] or {}).get(of, [])] for k, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.plain = names == STEPS and steps["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in steps["added_tokens"]) or r"(?!)")
        self.model = self.tokenizer.model

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > self.words_kept:
                self.pieces.clear()
            symbols = "".join(map(self.letters.__getitem__, piece.encode()))
            ids = self.pieces[piece] = struct.pack(f"<{len(found := self.model.tokenize(symbols))}I", *(t.id for t in found))
        return ids

    def _words(self, new: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        other = []
        for w in new:
            word = w.decode()
            if self.plain and PLAIN.match(word) and not self.special.search(word):
                yield w, b"".join(map(self._piece, PLAIN_SPLIT.findall(word.lower())))
            else:
                other.append(w)
        if other:
            codes = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
            yield from ((w, struct.pack(f"<{len(c.ids)}I", *c.ids)) for w, c in zip(other, codes, strict=True))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        for text in texts:
            words = text.split()
            if len(self.known) > self.words_kept:
                self.known, self.older = {}, self.known
            missing = set(words).difference(self.known)
            if missing:
                back = {w: self.older[w] for w in missing if w in self.older}
                self.known.update(back)
                self.known.update(self._words(list(missing.difference(back))))
            yield b"".join(map(self.known.__getitem__, words))


def tokenizer(path: str, words_kept: int | None = None) -> WordTokenizer:
    if (path, words_kept) not in _tokenizers:
        _tokenizers[path, words_kept] = WordTokenizer(path, words_kept)
    return _tokenizers[path, words_kept]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids) of a document."""
    step = 4 * capacity
    return [(k, k * capacity, len(ids[at : at + step]) // 4, ids[at : at + step]) for k, at in enumerate(range(0, len(ids), step))]


def pieces_of(docs: DataFrame, text: str, tokenizer_path: str, capacity: int = CAPACITY, words_kept: int | None = None) -> DataFrame:
    """A row for each piece, with the document's other columns boxed."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut_texts(texts: pa.Array) -> pa.Array:
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        cuts = [cut(ids + end, capacity) for ids in tokenizer(tokenizer_path, words_kept).encode(raw)]
        offsets = np.cumsum([0, *map(len, cuts)]).astype(np.int32)
        flat = [(k, start, n, zlib.crc32(ids)) for one in cuts for k, start, n, ids in one]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), PIECE, strict=True)] if flat else [pa.array([], f.type) for f in PIECE]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(PIECE)))

    @F.arrow_udf(PIECES)
    def tokenized(texts: pa.Array) -> pa.Array:
        return in_slices(cut_texts, texts)

    return docs.select(*boxed(without(docs.columns, [*MADE, text])), F.inline(tokenized(F.col(text))))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of each length by best-fit decreasing; bins of equal free space are taken last in, first out."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit f: there is a bin with f free places
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = filled >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                filled ^= 1 << free
        else:
            free, b, n = capacity, n, n + 1
        bins[i], places[i] = b, capacity - free
        by_free[free - size].append(b)
        filled |= 1 << (free - size)
    return bins, places


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest value that dual feasible functions give. counts: of each length from 0."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    number, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * x)))
    e = np.arange(1, capacity // 2 + 1)  # lengths below e count nothing, those above capacity - e a whole bin
    above = number[-1] - number[capacity - e + 1]
    between = total[capacity - e + 1] - total[e]
    best = max(best, int((-(-(above * capacity + between) // capacity)).max(initial=0)))
    for k in range(1, 16):  # x where x * (k + 1) / capacity is whole, else that rounded down, of k parts
        part = np.where(x * (k + 1) % capacity == 0, x * k, x * (k + 1) // capacity * capacity)
        best = max(best, -(-int((counts * part).sum()) // (k * capacity)))
    return best


def _repack(lengths: np.ndarray, old: np.ndarray | None, capacity: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bin, place, certified): a new packing, or the old one where it is certified or no worse."""
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    if old is None:
        bins, places = best_fit(lengths, capacity)
        return bins, places, int(bins.max()) + 1 == bound
    _, bins = np.unique(old, return_inverse=True)
    n_old = int(bins.max()) + 1
    if n_old > bound:
        new, places = best_fit(lengths, capacity)
        if int(new.max()) + 1 < n_old:
            return new, places, int(new.max()) + 1 == bound
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    lead = np.concatenate(([True], np.diff(bins[order]) > 0))
    places = np.empty_like(lengths)
    places[order] = starts - np.maximum.accumulate(np.where(lead, starts, 0))
    return bins, places, n_old == bound


def _packer(capacity: int, chunk: int, tag: int, old: bool, keep_open: bool):
    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (tag << 56) | (TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(held)
            lengths = table.column("length").to_numpy().astype(np.int64)
            bins, places, certified = _repack(lengths, table.column("sequence_id").to_numpy() if old else None, capacity)
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
            settled = certified and len(fill) * capacity - fill.sum() <= SETTLED * len(fill) * capacity
            is_open = (capacity - fill[bins] >= GAP) & (keep_open and not settled)
            made = {"sequence_id": bins + number, "offset": places, "certified": np.full(len(bins), certified), "open": is_open}
            table = table.drop_columns([name for name in made if name in table.column_names])
            for name, values in made.items():
                table = table.append_column(name, pa.array(values))
            number += len(fill)
            yield from table.combine_chunks().to_batches(max_chunksize=10_000)

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk and not old:  # old bins must not be cut; their groups are of a bounded size
                yield from packed()
                held, n = [], 0
        if n:
            yield from packed()

    return pack_rows


def pack(
    docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, chunk: int = CHUNK, words_kept: int | None = None
) -> DataFrame:
    """A row for each piece: the document's other columns, piece, start, length, ids_crc32, sequence_id, offset, and whether
    the number of bins of the group in which it was packed at last is certified."""
    pieces = materialize(pieces_of(docs, text, tokenizer_path, capacity, words_kept), "pieces")
    kinds = {"sequence_id": T.LongType(), "offset": T.LongType(), "certified": T.BooleanType(), "open": T.BooleanType()}
    schema = T.StructType([*pieces.schema, *(T.StructField(name, kind) for name, kind in kinds.items())])
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # as many rows as lengths
        histogram[length] = n
    bound = lower_bound(histogram, capacity)
    state = materialize(pieces.mapInArrow(_packer(capacity, chunk, 0, False, True), schema), "packed")
    closed: list[DataFrame] = []
    n_closed, n_before, last = 0, None, False
    while not last:
        first = F.when(F.col("offset") == 0, 1)  # each bin has one piece at its start
        n_open, bins_open, n_here = state.agg(F.count_if("open"), F.count(F.when(F.col("open"), first)), F.count(first)).first()
        n_bins = n_closed + n_here
        if n_bins <= bound or bins_open < 2 or (n_before is not None and n_before - n_bins < LEAST_GAIN * bins_open):
            break
        closed.append(state)
        n_closed, n_before = n_bins - bins_open, n_bins
        groups = -(-n_open // chunk)
        last = groups == 1
        dealt = state.filter("open").repartition(groups, "sequence_id")
        state = materialize(dealt.mapInArrow(_packer(capacity, chunk, len(closed), True, not last), schema), "packed")
    out = state
    for x in closed:
        out = out.unionByName(x.filter("NOT open"))
    return out.select(*unboxed(without(docs.columns, [*MADE, text])), *MADE)
