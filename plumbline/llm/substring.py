"""Substring dedup by automata of repeated phrases.

A window of ``width`` words recurs if its words also start anywhere else.  Documents are
searched in linear work at any size by routing text to small automata:

1. Every window is given an anchor: its ``anchor`` consecutive words with the least hash.
   Equal windows have equal anchors, so a window can recur only if its anchor does.
   Anchors stand about twice in every (width - anchor + 2) words; they are counted over
   all documents with map-side combine.
2. Documents that hold recurring anchors meet the list of them.  The words around each
   such anchor, a segment that spans all of its windows, go to the shard of the anchor.
3. In its shard the windows that start twice or more are confirmed, compiled into an
   Aho-Corasick automaton over words, and all segments of the shard are streamed through
   it.  Hits compare words, not hashes.
4. An anchor with more segments than a shard may hold gets shards of its own, over which
   its segments are dealt; its windows are counted beforehand with map-side combine.
5. Hits are spans of words; they meet their documents once more, and covered words go.

Texts pass a shuffle in compressed form, and only those that hold a recurring anchor go
further.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Repeats:
    """Words of a window, words of an anchor, segments that one task gathers."""

    width: int = 35
    anchor: int = 12
    segments: int = 4096


class Hashes(dict):
    """Hashes of words, remembered while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words, by differences of one running sum."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    back = np.full(len(hashes), pow(base, -1, 1 << 64), np.uint64)
    ahead = np.full(n, base, np.uint64)
    back[0] = ahead[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(back))])
    out = (sums[width:] - sums[:-width]) * np.cumprod(ahead)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


#: Low bits of a value that hold its position while minima are sought.
_PLACE = np.uint64((1 << 26) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the first least value of every run of ``width``, by doubling.

    Values are compared by their high bits; the first of equal ones counts.
    """
    least, reach = (values & ~_PLACE) | np.arange(len(values), dtype=np.uint64), 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return (least & _PLACE).astype(np.int64)


def anchors(hashes: np.ndarray, sizes: list[int], width: int, size: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, anchor hash, first window and number of windows of every run of windows
    that share an anchor, for documents whose word hashes stand one after the other."""
    n = len(hashes) - width + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    owner = np.repeat(np.arange(len(sizes)), sizes)
    grams = rolling(hashes, size)
    at = sliding_least(grams, width - size + 1)[:n]
    inside = np.flatnonzero(owner[:n] == owner[width - 1:])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4
    found, own = at[inside], owner[inside]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (own[1:] != own[:-1])])
    first = np.flatnonzero(new)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return (own[first], grams[found[first]].view(np.int64), inside[first] - begins[own[first]],
            np.diff(np.append(first, len(inside))))


def _portions(texts: Iterable[list[bytes]], words: int = 1 << 18) -> Iterator[list[list[bytes]]]:
    """Lists of words of consecutive texts, cut where they hold enough words together.

    Texts are taken one by one, so that only one portion is held as words at a time.
    """
    portion, total = [], 0
    for text in texts:
        portion.append(text)
        total += len(text)
        if total >= words:
            yield portion
            portion, total = [], 0
    if portion:
        yield portion


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _keyed(docs: DataFrame) -> DataFrame:
    """Two hashes of a row's id and text stand for the row; equal rows share them."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"),
                       F.xxhash64("text", "doc_id").alias("check"))


def marked(docs: DataFrame, spec: Repeats) -> DataFrame:
    """One narrow row per document: its words, the digest of all of them, its anchors."""
    width, size = spec.width, spec.anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            counts, digests, found = [], [], []
            for portion in _portions(map(_words, batch.column("text").to_pylist())):
                sizes = [len(w) for w in portion]
                flat = hashes.of(list(chain.from_iterable(portion)))
                own, marks, _, _ = anchors(flat, sizes, width, size)
                found += np.split(marks, np.searchsorted(own, np.arange(1, len(sizes))))
                digests += [hashlib.sha256(b" ".join(w)).digest() for w in portion]
                counts += sizes
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("check"),
                 pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "key", "check", "n_words", "digest", "anchors"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(
        run, f"doc_id {kind}, key long, check long, n_words long, digest binary, anchors array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """Rows with their text compressed, for the way through a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            texts = [pack(b" ".join(_words(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("check"),
                                              pa.array(texts, pa.binary())], ["key", "check", "packed"])

    return _keyed(docs).select("text", "key", "check").mapInArrow(
        run, "key long, check long, packed binary")


def _cut(batches: Iterator[pa.RecordBatch], shards: int, spec: Repeats) -> Iterator[list[tuple]]:
    """The segments (cell, salt, key, check, start, words) of some documents at a time."""
    width, most = spec.width, spec.segments
    unpack, hashes = zstandard.ZstdDecompressor().decompress, Hashes()
    # Lists of anchors are large as Python objects: few documents are taken at a time.
    parts = (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256))
    for part in parts:
        keys, checks, many = (part.column(c).to_pylist() for c in ("key", "check", "many"))
        texts = [unpack(p) for p in part.column("packed").to_pylist()]
        done = 0
        for portion in _portions(t.split() for t in texts):
            sizes = [len(w) for w in portion]
            own, *found = anchors(hashes.of(list(chain.from_iterable(portion))), sizes, width, spec.anchor)
            cuts = np.searchsorted(own, np.arange(len(sizes) + 1)).tolist()
            rows: list[tuple] = []
            for k, words in enumerate(portion):
                at, text = done + k, texts[done + k]
                counts = {x["h"]: x["n"] for x in many[at]}
                # Where every word begins; words are parted by one space.
                begins = [0, *accumulate(len(w) + 1 for w in words)]
                for h, first, n in zip(*(x[cuts[k]:cuts[k + 1]].tolist() for x in found), strict=True):
                    if (times := counts.get(h)) is None:
                        continue
                    apart = times > most
                    salt = (keys[at] + first) % -(-times // most) if apart else -1
                    rows.append((h if apart else h % shards, salt, keys[at], checks[at], first,
                                 text[begins[first]:begins[first + n + width - 1] - 1]))
            done += len(portion)
            yield rows


def segments(carriers: DataFrame, shards: int, spec: Repeats) -> DataFrame:
    """The words around every recurring anchor, addressed to a shard.

    ``salt`` is -1 in a shard of many anchors.  An anchor of its own has its hash as ``cell``
    and its segments dealt over salts 0 and up.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "salt", "key", "check", "start", "words"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for rows in _cut(batches, shards, spec):
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return carriers.mapInArrow(
        run, "cell long, salt int, key long, check long, start long, words binary")


def confirmed_apart(carriers: DataFrame, spec: Repeats) -> DataFrame:
    """Windows that recur among the segments of anchors with shards of their own, addressed
    to every shard of the anchor."""
    width, most = spec.width, spec.segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, held = Hashes(), [], 0
        for cut in _cut(batches, 1, spec):
            rows = pd.DataFrame({"cell": [r[0] for r in cut], "words": [r[5] for r in cut]})
            rows = rows.groupby(["cell", "words"]).size().reset_index(name="n")
            windows, owner, _ = _windows([hashes.of(w.split()) for w in rows["words"]], width)
            parts.append(pd.DataFrame({"cell": rows["cell"].to_numpy(np.int64)[owner], "window": windows,
                                       "n": rows["n"].to_numpy(np.int64)[owner]}))
            held += len(windows)
            if held > 200_000:
                parts = [pd.concat(parts).groupby(["cell", "window"], as_index=False)["n"].sum()]
                held = len(parts[0])
                if held > 100_000:
                    yield pa.RecordBatch.from_pandas(parts[0], preserve_index=False)
                    parts, held = [], 0
        if parts:
            total = pd.concat(parts).groupby(["cell", "window"], as_index=False)["n"].sum()
            yield pa.RecordBatch.from_pandas(total, preserve_index=False)

    def large(x: Column) -> Column:
        return x["n"] > most

    some = carriers.withColumn("many", F.filter("many", large)).filter(F.size("many") > 0)
    windows = (some.mapInArrow(run, "cell long, window long, n long")
               .groupBy("cell", "window").agg(F.sum("n").alias("n")).filter("n > 1").drop("n"))
    counts = (some.select(F.explode("many").alias("x")).select(F.col("x.h").alias("cell"), F.col("x.n").alias("n"))
              .distinct())
    salts = F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1)
    return windows.join(counts, "cell").select(F.col("cell").alias("own"), F.explode(salts).alias("dealt"), "window")


def _windows(hashed: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, segment and first word of every window of a list of segments."""
    flat = np.concatenate([np.zeros(0, np.uint64), *hashed])
    owner = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
    begins = np.concatenate([[0], np.cumsum([len(h) for h in hashed])]).astype(np.int64)
    n = max(0, len(flat) - width + 1)
    inside = np.flatnonzero(owner[:n] == owner[len(flat) - n:])
    own = owner[inside]
    return rolling(flat, width)[inside].view(np.int64), own, inside - begins[own]


def recurring_phrases(texts: list[tuple[int, ...]], times: np.ndarray, found: tuple[np.ndarray, ...],
                      confirmed: np.ndarray | None, width: int) -> list[tuple[int, ...]]:
    """The passages to look for among different segments that occur ``times`` each.

    A segment that occurs twice or more is one passage, whole.  Of the others, every
    confirmed window is.  Without ``confirmed`` the windows that start twice or more among
    these segments are.
    """
    windows, owner, offset = found
    if confirmed is None:
        values, index = np.unique(windows, return_inverse=True)
        confirmed = values[np.bincount(index, weights=times[owner], minlength=len(values)) > 1]
    single = (times[owner] == 1) & np.isin(windows, confirmed)
    first = np.flatnonzero(single)[np.unique(windows[single], return_index=True)[1]]
    phrases = [texts[k][i:i + width] for k, i in zip(owner[first].tolist(), offset[first].tolist(), strict=True)]
    return phrases + [texts[k] for k in np.flatnonzero(times > 1).tolist()]


def located(carriers: DataFrame, shards: int, spec: Repeats) -> DataFrame:
    """Spans (key, check, start, end) of words that recurring windows cover.

    In a shard equal segments are looked at once.
    """
    width = spec.width

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({c: pd.Series([], dtype=np.int64) for c in ("key", "check", "start", "end")})
        if not len(left):
            return nothing
        kinds, different = pd.factorize(left["words"])
        times = np.bincount(kinds)
        ids: dict[bytes, int] = {}
        texts = [tuple([ids.setdefault(w, len(ids)) for w in t.split()]) for t in different]
        known = np.array([xxhash.xxh64_intdigest(w) for w in ids], np.uint64)
        apart = left["salt"].iloc[0] >= 0
        if apart:
            # Its other segments are elsewhere: nothing occurs twice for sure but what was counted.
            times = np.ones_like(times)
        confirmed = right["window"].to_numpy() if apart else None
        phrases = recurring_phrases(texts, times, _windows([known[list(t)] for t in texts], width), confirmed, width)
        if not phrases:
            return nothing
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases:
            automaton.add_word(phrase)
        automaton.make_automaton()
        rows: list[tuple[int, int, int]] = []
        for k, text in enumerate(texts):
            spans: list[list[int]] = []
            for last, size in automaton.iter(text):
                begin = last + 1 - size
                while spans and begin <= spans[-1][1]:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, last + 1])
            rows += [(k, a, b) for a, b in spans]
        found = np.array(rows, np.int64).reshape(-1, 3)
        # Hand the spans of a segment to all rows that hold it.
        order = np.argsort(kinds, kind="stable")
        many = np.bincount(kinds)
        starts = np.concatenate([[0], np.cumsum(many)[:-1]])
        each = many[found[:, 0]]
        steps = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at = order[np.repeat(starts[found[:, 0]], each) + steps]
        base = left["start"].to_numpy()[at]
        return pd.DataFrame({"key": left["key"].to_numpy()[at], "check": left["check"].to_numpy()[at],
                             "start": base + np.repeat(found[:, 1], each), "end": base + np.repeat(found[:, 2], each)})

    groups = segments(carriers, shards, spec).groupBy("cell", "salt").cogroup(
        confirmed_apart(carriers, spec).groupBy("own", "dealt"))
    return groups.applyInPandas(run, "key long, check long, start long, end long")


def without(carriers: DataFrame, spans: DataFrame) -> DataFrame:
    """What is left of the documents that spans cover: key, check, n_removed, digest."""
    each = spans.distinct().groupBy("key", "check").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            removed, digests = [], []
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(),
                                     strict=True):
                words = unpack(packed).split()
                covered = np.zeros(len(words), bool)
                for span in spans:
                    covered[span["start"]:span["end"]] = True
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("check"), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.binary())], ["key", "check", "n_removed", "left"])

    # Equal rows share their result.
    once = carriers.select("key", "check", "packed").join(each, ["key", "check"]).dropDuplicates(["key", "check"])
    return once.mapInArrow(run, "key long, check long, n_removed long, left binary")


def remove_repeats(docs: DataFrame, spec: Repeats = Repeats()) -> DataFrame:  # noqa: B008
    """Take out every word that a recurring window covers, in all whole texts.

    Returns doc_id, n_words, n_removed and kept_sha256, the lowercase hexadecimal SHA-256
    of the kept words joined by single spaces.  Null and empty texts have no words; texts
    shorter than a window lose none.  Equal rows are documents of their own, so all their
    windows recur.  Null ids keep their row; other columns are not looked at.
    """
    marks = stored(marked(docs, spec))
    each = marks.select("key", F.explode("anchors").alias("h"))
    often = stored(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // spec.segments))
    many = each.join(often, "h").groupBy("key").agg(F.collect_set(F.struct("h", "n")).alias("many"))
    carriers = stored(_packed(docs).join(many, "key"))
    removed = without(carriers, located(carriers, shards, spec))
    digest = F.lower(F.hex(F.coalesce("left", "digest")))
    return (marks.drop("anchors").join(removed, ["key", "check"], "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    digest.alias("kept_sha256")))
