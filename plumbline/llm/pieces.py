"""Encoding and decoding with a SentencePiece BPE vocabulary by suffix-array matching.

A batch of texts is cut at spaces into units that no piece crosses.  The distinct units of
the batch are concatenated and indexed by a suffix array as deep as the longest piece.
Binary search of every piece in the suffix array gives the range of its occurrences; these
are the edges of the lattice, sorted by position.  Relaxing follows the merge order of
byte-pair encoding: of all edges whose two halves stand as symbols, the one with the best
score, then the leftmost, is taken, until none is left; all units of a batch go on together,
one edge each in a round.  Characters that are no piece become
byte pieces.  The result equals that of the SentencePiece library.

The vocabulary is read from a file on the driver and broadcast (tens of thousands of
pieces).  Batches are independent, whole texts are encoded in place, nothing is shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import kept, shared, trim

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
UNKNOWN_TEXT = " ⁇ "


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id.  ``scores`` is None for ids that are no text: they never match."""

    pieces: tuple[str, ...]
    scores: tuple[float | None, ...]
    bytes_at: tuple[int, ...]
    unknown: int


def read_vocabulary(path: str) -> Vocabulary:
    """Read a BPE model file.  Models whose pieces cross a space cannot be cut into units."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = tuple(model.id_to_piece(i) for i in ids)
    silent = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
              for i in ids]
    scores = tuple(None if silent[i] else model.get_score(i) for i in ids)
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, s in zip(pieces, scores, strict=True) if s is not None):
        raise ValueError("pieces cross a space")
    at = {pieces[i]: i for i in ids if model.is_byte(i)}
    return Vocabulary(pieces, scores, tuple(at.get(f"<0x{b:02X}>", -1) for b in range(256)), model.unk_id())


class Matcher:
    """A vocabulary made ready for binary search, and the units whose ids are known."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 300_000) -> None:
        """``remembered`` bounds the units whose ids are kept from one batch to the next."""
        self.vocabulary, self.remembered = vocabulary, remembered
        self.forget()
        self.ids = np.array([i for i, s in enumerate(vocabulary.scores) if s is not None], np.int64)
        texts = [vocabulary.pieces[i] for i in self.ids]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.single = {t: int(i) for t, i in zip(texts, self.ids, strict=True) if len(t) == 1}
        # Characters are numbered from 1; one that is in no piece is 0, as is the gap between units.
        self.alphabet = np.array(sorted({ord(c) for t in texts for c in t}), np.int64)
        if len(self.alphabet) >= 0xFFFF:
            raise ValueError("more characters than a key holds")
        ends = np.cumsum(self.sizes)
        numbers = self.numbered("".join(texts))
        low = np.zeros((len(texts), self.longest), ">u2")
        row = np.repeat(np.arange(len(texts)), self.sizes)
        low[row, np.arange(len(numbers)) - np.repeat(ends - self.sizes, self.sizes)] = numbers
        high = np.where(np.arange(self.longest) < self.sizes[:, None], low, 0xFFFF).astype(">u2")
        several = self.sizes > 1
        self.low, self.high = (self._keys(k[several]) for k in (low, high))
        self.several, self.widths = self.ids[several], self.sizes[several]
        self.bits = len(vocabulary.pieces).bit_length()
        self.scores = np.array([-np.inf if x is None else x for x in vocabulary.scores] + [-np.inf])

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbered(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).astype(np.uint16)

    def _keys(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of numbers as byte strings that sort alike."""
        return np.ascontiguousarray(numbers).view(f"S{2 * self.longest}").ravel()

    def edges(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces of two or more characters, sorted by position: the key
        start * (longest + 1) + size, and the piece.

        The suffix array holds the starts of all suffixes, sorted by as many characters as
        the longest piece has.  Binary search finds for every piece the range of suffixes that
        begin with it.
        """
        padded = np.concatenate([numbers, np.zeros(self.longest, np.uint16)])
        keys = self._keys(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[:len(numbers)].astype(">u2"))
        order = np.argsort(keys)
        keys = keys[order]
        low, high = np.searchsorted(keys, self.low), np.searchsorted(keys, self.high)
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        # One number holds key and piece, so that sorting moves both.
        packed = order[at] * (self.longest + 1) + np.repeat(self.widths, many)
        packed = (packed << self.bits) | np.repeat(self.several, many)
        packed.sort()
        return packed >> self.bits, packed & ((1 << self.bits) - 1)

    def encode_units(self, units: Sequence[str], chars: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the different units has, and all ids, indexed together in
        portions of about ``chars``."""
        counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        portion, total = [], 0
        for at, unit in enumerate(units):
            portion.append(unit)
            total += len(unit) + 1
            if total >= chars or at == len(units) - 1:
                some, ids = self._encode_portion(portion)
                counts.append(some)
                flat.append(ids)
                portion, total = [], 0
        return np.concatenate(counts), np.concatenate(flat)

    def _encode_portion(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\0".join(units)
        lengths = np.array([len(u) for u in units], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        numbers = self.numbered(text)
        numbers[begins[1:] - 1] = 0
        key, piece = self.edges(numbers)
        counts = np.zeros(len(units), np.int64)
        # Very long units take many rounds: they are relaxed one by one.
        large = np.flatnonzero(lengths > 4 * self.longest)
        alone: dict[int, tuple[int, ...]] = {}
        for k in large.tolist():
            a, b = np.searchsorted(key, [begins[k] * (self.longest + 1), (begins[k] + lengths[k]) * (self.longest + 1)])
            start, size = np.divmod(key[a:b], self.longest + 1)
            lattice = {(s, z): p for s, z, p in zip((start - begins[k]).tolist(), size.tolist(), piece[a:b].tolist(),
                                                    strict=True)}
            alone[k] = self._relax(units[k], lattice)
            counts[k] = len(alone[k])
        short = np.flatnonzero(lengths <= 4 * self.longest)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        many, found = self._relax_all(codes, key, piece, begins[short], lengths[short])
        counts[short] = many
        flat = np.zeros(counts.sum(), np.int32)
        mine = np.ones(len(flat), bool)
        ends = np.cumsum(counts)
        for k, ids in alone.items():
            flat[ends[k] - counts[k]:ends[k]] = ids
            mine[ends[k] - counts[k]:ends[k]] = False
        flat[mine] = found
        return counts, flat

    def _relax_all(self, codes: np.ndarray, key: np.ndarray, piece: np.ndarray, begins: np.ndarray, lengths: np.ndarray
                   ) -> tuple[np.ndarray, np.ndarray]:
        """Relax all units together, one merge in each unit a round: ids per unit, and all ids.
        The lattice is sparse: an edge is looked up by its key when a pair of symbols arises."""
        unit = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(unit)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + begins[unit]
        size, own = np.ones(len(unit), np.int64), np.full(len(unit), -1, np.int64)

        def look(start: np.ndarray, total: np.ndarray) -> np.ndarray:
            """The piece of an edge, or -1."""
            wanted = np.where(total <= self.longest, start * (self.longest + 1) + total, -1)
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            return np.where(key[place] == wanted, piece[place], -1) if len(key) else np.full(len(start), -1)

        # The piece that a symbol makes with the next one of its unit.
        joint = np.full(len(unit), -1, np.int64)
        inner = np.flatnonzero(unit[:-1] == unit[1:])
        joint[inner] = look(at[inner], size[inner] + size[inner + 1])
        done = []
        while len(unit):
            score = self.scores[joint]
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.maximum.reduceat(score, first)
            spread = np.diff(np.append(first, len(unit)))
            going = np.repeat(best > -np.inf, spread)
            hit = np.flatnonzero((score == np.repeat(best, spread)) & going)
            done.append((unit[~going], at[~going], own[~going]))
            hit = hit[np.append(True, unit[hit[1:]] != unit[hit[:-1]])] if len(hit) else hit
            size[hit] += size[hit + 1]
            own[hit] = joint[hit]
            going[hit + 1] = False
            fresh = np.zeros(len(unit), bool)
            fresh[hit] = True
            fresh[np.maximum(hit - 1, 0)] = True
            unit, at, size, own, joint, fresh = (x[going] for x in (unit, at, size, own, joint, fresh))
            # Only pairs with the merged symbol are new.
            new = np.flatnonzero(fresh)
            inside = np.zeros(len(new), bool)
            inside[new + 1 < len(unit)] = unit[new[new + 1 < len(unit)]] == unit[new[new + 1 < len(unit)] + 1]
            joint[new] = -1
            new = new[inside]
            joint[new] = look(at[new], size[new] + size[new + 1])
        unit, at, own = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((at, unit))
        unit, at, ids = unit[order], at[order], own[order]
        alone = np.flatnonzero(ids < 0)
        chars, kind = np.unique(codes[at[alone]], return_inverse=True)
        spelt = [list(self._char(chr(c))) for c in chars.tolist()]
        ids[alone] = np.array([x[0] for x in spelt], np.int64)[kind] if len(spelt) else ids[alone]
        times = np.ones(len(ids), np.int64)
        if len(spelt):
            times[alone] = np.array([len(x) for x in spelt])[kind]
        flat = np.repeat(ids, times)
        if (times > 1).any():
            # Characters that become several bytes.
            ends = np.cumsum(times)
            mine = {int(i): spelt[j] for i, j in zip(alone.tolist(), kind.tolist(), strict=True) if len(spelt[j]) > 1}
            for i, several in mine.items():
                flat[ends[i] - len(several):ends[i]] = several
        return np.bincount(unit, weights=times, minlength=len(lengths)).astype(np.int64), flat

    def _relax(self, unit: str, lattice: dict[tuple[int, int], int]) -> tuple[int, ...]:
        scores, n = self.vocabulary.scores, len(unit)
        size, before = [1] * n, list(range(-1, n - 1))
        # A candidate is a symbol and its right neighbour, known by begin, middle and end.
        heap = [(-scores[p], s, s + 1, s + 2) for (s, z), p in lattice.items() if z == 2]
        heapify(heap)
        while heap:
            _, a, b, c = heappop(heap)
            if not size[a] or a + size[a] != b or not size[b] or b + size[b] != c:
                continue
            size[a], size[b] = c - a, 0
            if c < n:
                before[c] = a
                end = c + size[c]
                if (p := lattice.get((a, end - a))) is not None:
                    heappush(heap, (-scores[p], a, c, end))
            left = before[a]
            if left >= 0 and (p := lattice.get((left, c - left))) is not None:
                heappush(heap, (-scores[p], left, a, c))
        out: list[int] = []
        at = 0
        while at < n:
            if size[at] > 1:
                out.append(lattice[at, size[at]])
            else:
                out.extend(self._char(unit[at]))
            at += size[at]
        return tuple(out)

    def _char(self, char: str) -> Iterable[int]:
        if (found := self.single.get(char)) is not None:
            return (found,)
        ids = [self.vocabulary.bytes_at[b] for b in char.encode("utf-8", "surrogatepass")]
        return ids if min(ids) >= 0 else (self.vocabulary.unknown,)

    def encode_batch(self, texts: Sequence[str | None]) -> list[list[int] | None]:
        """The ids of every text; none for an empty text, null for null."""
        flat, ends = self.encode_flat(texts)
        flat, ends = flat.tolist(), ends.tolist()
        return [None if t is None else flat[a:b] for t, a, b in zip(texts, ends, ends[1:], strict=False)]

    def encode_flat(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end; none for empty and null."""
        cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        units: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                units += cut(MARK + t.replace(" ", MARK))
            ends.append(len(units))
        if len(self.index) > self.remembered:
            self.forget()
        new = [u for u in dict.fromkeys(units) if u not in self.index]
        if new:
            counts, flat = self.encode_units(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        which = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        many = self.ends[which + 1] - self.ends[which]
        last = np.cumsum(many)
        flat = self.flat[np.repeat(self.ends[which] - (last - many), many) + np.arange(many.sum())]
        return flat, np.concatenate([[0], last])[np.array(ends)]

    def surfaces(self) -> list[bytes]:
        """The bytes that each id stands for."""
        v = self.vocabulary
        out = [p.replace(MARK, " ").encode() if s is not None else b""
               for p, s in zip(v.pieces, v.scores, strict=True)]
        out[v.unknown] = UNKNOWN_TEXT.encode()
        for byte, i in enumerate(v.bytes_at):
            if i >= 0:
                out[i] = bytes([byte])
        return out


def decode_ids(surfaces: Sequence[bytes], ids: Sequence[int] | None) -> str | None:
    """The text of ids; the space that encoding puts in front is taken off again."""
    if ids is None:
        return None
    text = b"".join(map(surfaces.__getitem__, ids)).decode("utf-8", "replace")
    return text.removeprefix(" ")


def decode_all(surfaces: pa.Array, flat: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    """The texts of many ids at once: the bytes of all ids in a row are cut at the texts' ends."""
    taken = surfaces.take(pa.array(flat.astype(np.int64)))
    octets = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    raw = taken.buffers()[2] or pa.py_buffer(b"")
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(octets[ends])), raw])
    try:
        texts = whole.cast(pa.large_string())
    except pa.ArrowInvalid:  # bytes that are no characters
        texts = pa.array([b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.large_string())
    front = pc.fill_null(pc.starts_with(texts, " "), False)
    texts = pc.if_else(front, pc.utf8_slice_codeunits(texts, 1), texts)
    return pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), texts).cast(pa.string())


def _portions(batch: pa.RecordBatch, lengths: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose rows have about ``size`` together: it bounds what a worker
    holds as Python objects at a time.  A longer row is a slice of its own."""
    lengths = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    whose = (np.cumsum(lengths, dtype=np.int64) - 1) // size
    starts = np.flatnonzero(np.diff(whose, prepend=-2)).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def _encoded(docs: DataFrame, vocabulary: Vocabulary, text: str, outs: Sequence[str]) -> DataFrame:
    """Ids, and with a second name in ``outs`` also what they decode to, from one step."""
    rest = [c for c in docs.columns if c not in outs]
    matcher = Matcher(vocabulary)
    get = kept(docs.sparkSession, (matcher, pa.array(matcher.surfaces(), pa.large_binary())))
    names = [f"c{i}" for i in range(len(rest))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        matcher, surfaces = get()
        for batch in batches:
            for part in _portions(batch, pc.binary_length(batch.column("llm_text")), 2 << 20):
                null = part.column("llm_text").is_null().to_numpy(zero_copy_only=False)
                flat, ends = matcher.encode_flat(part.column("llm_text").to_pylist())
                made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)),
                                                 mask=pa.array(null))]
                if len(outs) > 1:
                    made.append(decode_all(surfaces, flat, ends, null))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made],
                                                 [*names, *[f"o{i}" for i in range(len(made))]])
            batch = part = made = flat = ends = None
            trim()

    sent = docs.select(docs[text].alias("llm_text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(rest)])
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
    fields += [f"o{i} {kind}" for i, kind in zip(range(len(outs)), ("array<int>", "string"), strict=False)]
    return sent.mapInArrow(run, ", ".join(fields)).toDF(*rest, *outs)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` with the ids of the text column, an array of int.

    A null text has null ids, an empty one none.  Repeated rows get equal ids.  An existing
    column ``out`` is replaced.
    """
    return _encoded(docs, vocabulary, text, [out])


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids",
                  decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one step, so that rows pass a Python worker once."""
    return _encoded(docs, vocabulary, text, [ids, decoded])


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``coded`` with the text of the ids column; null for null."""
    rest = [c for c in coded.columns if c != out]
    get = shared(coded.sparkSession, Matcher(vocabulary).surfaces())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, surfaces = f"c{rest.index(ids)}", get()
        for part in chain.from_iterable(
                _portions(b, pc.list_value_length(b.column(name)), 1 << 20) for b in batches):
            texts = [decode_ids(surfaces, x) for x in part.column(name).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                             [*part.schema.names, "decoded"])

    sent = coded.select(*[coded[c].alias(f"c{i}") for i, c in enumerate(rest)])
    fields = [f"c{i} {coded.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
    return sent.mapInArrow(run, ", ".join([*fields, "decoded string"])).toDF(*rest, out)
