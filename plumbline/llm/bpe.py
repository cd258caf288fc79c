"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts of ordinary length go to the library whole.  A longer one is cut beforehand where the
split pattern must start a new match anyway: between a character that is no white space and
one that is.  No alternative of the pattern holds those two in this order, and none looks
back, so the matches, and with them the ids, are those of the whole text.  A very long run
of white space has no such place inside and would exhaust the stack of the library's regex
engine; its match is known without the engine (all of it at the end of the text, all but the
last character elsewhere) and is encoded as one piece.

Ids are kept packed, as little-endian unsigned 32-bit integers, the format of token files.
Decoding gives bytes, not text, as an id may stand for a part of a character.  Each batch is
independent; nothing is shuffled.  The ranks (tens of thousands) are broadcast.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A text of more characters is cut; cuts are so far apart at least.
LONG = 65_536

#: Characters of text, or ids, that a worker codes before it passes them on.
PORTION = 2 << 20


@dataclass
class Codec:
    """Ranks by token bytes and the pattern that splits a text.  ``long`` is the number of
    characters from which a text is cut; it does not change the ids."""

    ranks: dict[bytes, int]
    pattern: str
    long: int = LONG
    name: str = field(default="local")

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern, "long": self.long, "name": self.name}

    @cached_property
    def encoding(self):
        import tiktoken

        return tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def border(self):
        return regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")

    @cached_property
    def run(self):
        return regex.compile(r"\p{White_Space}{%d,}+" % self.long)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in pieces that are encoded apart, and whether one is a single match."""
        at = 0
        while len(text) - at > self.long:
            # A run of white space that begins right here is one match, if it is long.
            if run := self.run.match(text, at):
                end = run.end() if run.end() == len(text) else run.end() - 1
                yield text[at:end], True
                at = end
                continue
            # The next cut, but in front of a long run at the latest.
            cut = self.border.search(text, at + self.long)
            cut = cut.start() if cut else len(text)
            if run := self.run.search(text, at + 1, cut + self.long):
                cut = min(cut, run.start())
            yield text[at:cut], False
            at = cut
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for null."""
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) <= self.long:
            return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)
        out = [np.asarray(self.encoding._encode_single_piece(piece), np.uint32) if one else self.encode(piece)
               if len(piece) <= self.long else
               np.asarray(self.encoding.encode_to_numpy(piece, disallowed_special=()), np.uint32)
               for piece, one in self.pieces(text)]
        return np.concatenate(out)

    def decode(self, packed: bytes | None) -> bytes | None:
        """The bytes that packed ids stand for."""
        if packed is None:
            return None
        return self.encoding.decode_bytes(np.frombuffer(packed, "<u4").tolist())


def read_codec(path: str, pattern: str, long: int = LONG) -> Codec:
    """Read a rank file (a line per token: base64 bytes, rank)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern, long)


def _portions(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes in a column: what a worker holds as Python
    objects at a time.  A longer row is a slice of its own."""
    lengths = batch.column(column).cast(pa.large_binary())
    offsets = np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset:lengths.offset + len(lengths) + 1])
    starts = np.flatnonzero(np.diff((np.cumsum(offsets) - 1) // size, prepend=-2)).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def _mapped(rows: DataFrame, codec: Codec, source: Column, rest: list[str], outs: list[str],
            encodes: bool, decodes: bool) -> DataFrame:
    get = shared(rows.sparkSession, codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in batches:
            for part in _portions(batch, "llm_source", PORTION):
                given = part.column("llm_source").to_pylist()
                made = []
                if encodes:
                    given = [codec.encode(x).astype("<u4").tobytes() for x in given]
                    made.append(pa.array(given, pa.binary()))
                if decodes:
                    made.append(pa.array([codec.decode(x) for x in given], pa.binary()))
                kept = [part.column(f"c{i}") for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*[f"c{i}" for i in range(len(rest))],
                                                                  *[f"o{i}" for i in range(len(made))]])

    sent = rows.select(source.alias("llm_source"), *[rows[c].alias(f"c{i}") for i, c in enumerate(rest)])
    fields = [f"c{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
    fields += [f"o{i} binary" for i in range(len(outs))]
    return sent.mapInArrow(run, ", ".join(fields)).toDF(*rest, *outs)


def encode(docs: DataFrame, codec: Codec, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` with the packed ids of the text column.

    A null or empty text has no ids (an empty value, not null).  Repeated rows get equal
    ids; there are no ties.  An existing column ``out`` is replaced.  An empty table stays empty.
    """
    return _mapped(docs, codec, docs[text], [c for c in docs.columns if c != out], [out], True, False)


def decode(coded: DataFrame, codec: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``coded`` with the bytes of the packed ids column; null for null.  An
    existing column ``out`` is replaced."""
    return _mapped(coded, codec, coded[ids], [c for c in coded.columns if c != out], [out], False, True)


def encode_decode(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids",
                  decoded: str = "decoded") -> DataFrame:
    """Both in one step, so that rows pass a Python worker once: a round trip to check."""
    rest = [c for c in docs.columns if c not in (ids, decoded)]
    return _mapped(docs, codec, docs[text], rest, [ids, decoded], True, True)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of int."""
    octets = F.hex(ids)
    at = F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int"))
    little = F.transform(at, lambda i: F.concat(*[
        F.substring(octets, i * 8 + F.lit(7 - 2 * k), F.lit(2)) for k in range(4)]))
    some = F.transform(little, lambda h: F.conv(h, 16, 10).cast("int"))
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<int>")).otherwise(some)
