"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other numbers
or names has the same template. Windows of template tokens are hash-joined with the
benchmark's; a document holds an item if enough of the item's windows match and the slots
that the placeholders stand for map to each other one to one.

What is a name shows by its capital only, so a copy in capitals, title case or lower case has another template.
Each window therefore also has a folded form, in which case tells nothing and names are literal. Items too short for a
template, and those of which most tokens are slots, are searched by their very words.

The pass over the documents drops windows that no benchmark item can have by a
bitmap of fixed size, so almost nothing reaches the join. A larger benchmark only lets more windows
through; the join is exact either way.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_BYTES, measured_bytes, release, skew_join, stored, text_batches, text_hash, without

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d]\w*|[.!?\n]")
# Units, when they follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml l liter "
    "liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year "
    "years c f k degree degrees celsius fahrenheit percent dollar dollars cent cents euro euros mph kmh w kw kwh j kj v a hz khz mhz ghz b kb mb gb tb".split()
)
_END, _NUMBER, _PLAIN, _UNIT, _CAPITAL_UNIT, _CAPITAL = range(6)
_PLACEHOLDER = {_NUMBER: 0x9E3779B97F4A7C15, _UNIT: 0xC2B2AE3D27D4EB4F, _CAPITAL: 0x165667B19E3779F9}
_BITS = 26  # of the bitmap: 8 MB, whatever the benchmark's size
_PRIME = np.uint64(0x100000001B3)


class _Vocabulary(dict):
    """Raw token -> number; the hash and kind of a number stand in arrays. Emptied when it is large, to bound a worker's memory."""

    most = 100_000

    def __init__(self) -> None:
        super().__init__()
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.known, self.fresh = 0, []
        self.hashes, self.kinds = np.zeros(1 << 15, np.uint64), np.zeros(1 << 15, np.int8)

    def __missing__(self, token: str) -> int:
        first = token[0]
        lower = token.lower()
        unit = lower in UNITS
        capital = (_CAPITAL_UNIT if unit else _CAPITAL) if first.isupper() else _UNIT if unit else _PLAIN
        kind = _END if first in ".!?\n" else _NUMBER if first.isdigit() else capital
        self[token] = number = self.known + len(self.fresh)
        self.fresh.append((xxhash.xxh3_64_intdigest(lower), kind))
        return number

    def lookup(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and kinds of tokens."""
        if self.known > self.most:
            self._empty()
        numbers = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.fresh:
            total = self.known + len(self.fresh)
            if total > len(self.kinds):
                room = max(total, 2 * len(self.kinds)) - len(self.kinds)
                self.hashes, self.kinds = np.append(self.hashes, np.zeros(room, np.uint64)), np.append(self.kinds, np.zeros(room, np.int8))
            self.hashes[self.known : total] = np.array([h for h, _ in self.fresh], np.uint64)
            self.kinds[self.known : total] = [k for _, k in self.fresh]
            self.known, self.fresh = total, []
        return self.hashes[numbers], self.kinds[numbers]


def _window_hashes(hashes: np.ndarray, starts: np.ndarray | None, length: int) -> np.ndarray:
    """Hash of the windows at ``starts``, or of all."""
    n = len(hashes) - length + 1 if starts is None else len(starts)
    total = np.full(n, length, np.uint64)
    for k in range(length):
        total = (total ^ (hashes[k : k + n] if starts is None else hashes[starts + k])) * _PRIME
        total ^= total >> np.uint64(29)
    return total


def _in_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """Number of marked tokens in each window."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return sums[length:] - sums[:-length]


class Canonical:
    """A text's template: token hashes with placeholders, which tokens are slots, and the raw tokens.

    ``folded`` and ``fixed`` are the same for the folded form, where only numbers and units are slots.
    """

    __slots__ = ("hashes", "slot", "name", "folded", "fixed", "tokens", "keep", "words")

    def __init__(self, text: str | None, vocabulary: _Vocabulary):
        tokens = _TOKEN.findall(text) if text else []
        hashes, kinds = vocabulary.lookup(tokens)
        before = np.concatenate(([_END], kinds[:-1])) if len(kinds) else kinds
        name = (kinds >= _CAPITAL_UNIT) & (before != _END)  # the first word of a sentence is no name by its capital
        measured = before == _NUMBER
        unit = (kinds == _UNIT) & measured
        number = kinds == _NUMBER
        self.words = hashes
        hashes = hashes.copy()
        hashes[number], hashes[unit] = (np.uint64(_PLACEHOLDER[k]) for k in (_NUMBER, _UNIT))
        self.keep = np.flatnonzero(kinds != _END)
        self.name, self.slot = name[self.keep], (number | unit | name)[self.keep]
        self.hashes = self.folded = hashes[self.keep]
        self.fixed = self.slot
        if self.name.any():
            self.fixed = (number | unit | ((kinds == _CAPITAL_UNIT) & measured))[self.keep]
            self.folded = self.hashes.copy()
            self.folded[self.name & self.fixed] = np.uint64(_PLACEHOLDER[_UNIT])
            self.hashes[self.name] = np.uint64(_PLACEHOLDER[_CAPITAL])
        self.tokens = tokens

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each window in which at least half of the tokens are literal."""
        if len(self.hashes) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts = np.flatnonzero(2 * _in_windows(self.slot, length) <= length)
        return starts, _window_hashes(self.hashes, None, length)[starts]

    def folded_windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The same in the folded form, but only windows that hold a name: all others are the same in both."""
        if self.folded is self.hashes or len(self.hashes) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts = np.flatnonzero((_in_windows(self.name, length) > 0) & (2 * _in_windows(self.fixed, length) <= length))
        return starts, _window_hashes(self.folded, starts, length)

    def literal_windows(self, length: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each window that has no folded form, or of every one, of its very words and numbers."""
        if len(self.hashes) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts = np.flatnonzero((2 * _in_windows(self.fixed, length) > length) | every)
        return starts, _window_hashes(self.words[self.keep], starts, length)

    def slots(self, start: int, length: int, folded: bool = False) -> list[str]:
        slot = self.fixed if folded else self.slot
        return [self.tokens[self.keep[k]].lower() for k in range(start, start + length) if slot[k]]


#: Shorter items have no template: their very words are searched.
LEAST_TEMPLATE = 5


_TEMPLATE, _FOLDED, _LITERAL = 1, 2, 4  # bits: a window without names is of two forms; a literal one stands in for a folded one
_WINDOW_KIND = "hash long, start long, length int, slots array<string>"


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_WINDOW_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]


def benchmark_windows(benchmark: DataFrame, window: int = 8) -> DataFrame:
    """item_id, hash, start, length, slots, form, and the numbers ``of`` and ``of_folded`` windows of each item in either form.

    An item of fewer than ``window`` tokens is one window.
    """
    names = ["item_id", "hash", "start", "length", "slots", "of", "of_folded", "form"]

    def of_item(item, canonical: Canonical) -> Iterator[tuple]:
        length = min(window, len(canonical.hashes))
        short = length < LEAST_TEMPLATE
        if not short:
            starts, hashes = canonical.windows(length)
            again, folded = canonical.folded_windows(length)
            named = _in_windows(canonical.name, length) > 0
            of = len(starts), len(again) + int((~named[starts]).sum())
            for s, h in zip(starts.tolist(), hashes.view(np.int64).tolist()):
                yield item, h, s, length, canonical.slots(s, length), *of, _TEMPLATE if named[s] else _TEMPLATE | _FOLDED
            for s, h in zip(again.tolist(), folded.view(np.int64).tolist()):
                yield item, h, s, length, canonical.slots(s, length, True), *of, _FOLDED
        if short or not of[1]:  # too short, or mostly numbers and units throughout, so no template tells it
            starts, hashes = canonical.literal_windows(length, short)
            for s, h in zip(starts.tolist(), hashes.view(np.int64).tolist()):
                yield item, h, s, length, [], 0, len(starts), _FOLDED | _LITERAL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary()
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                canonical = Canonical(text, vocabulary)
                if len(canonical.hashes):
                    out += of_item(item, canonical)
            yield _columns(out, names, [batch.schema.field(0).type, *_WINDOW_TYPES, pa.int64(), pa.int64(), pa.int32()])

    rows = benchmark.select("item_id", "text").filter("item_id IS NOT NULL")
    return rows.mapInArrow(run, f"item_id {dict(rows.dtypes)['item_id']}, {_WINDOW_KIND}, of long, of_folded long, form int")


def candidate_windows(documents: DataFrame, bitmap: bytes, lengths: Sequence[int], literal: bool = False) -> DataFrame:
    """row, doc_id, text_hash, hash, start, length and slots of those windows that the bitmap lets through, ``literal`` ones only if asked for."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)
    fixed = tuple(lengths)
    names = ["row", "doc_id", "text_hash", "hash", "start", "length", "slots"]

    def forms_of(canonical: Canonical, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if length < LEAST_TEMPLATE:
            yield 2, *canonical.literal_windows(length, True)
            return
        yield 0, *canonical.windows(length)
        yield 1, *canonical.folded_windows(length)
        if literal:
            yield 2, *canonical.literal_windows(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        bits = np.frombuffer(shared.value, np.uint8)
        vocabulary = _Vocabulary()
        for batch in text_batches(batches):
            out = []
            for doc_id, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                canonical = Canonical(text.as_py(), vocabulary)
                for length in fixed:
                    for form, starts, hashes in forms_of(canonical, length):
                        if not len(starts):
                            continue
                        low = hashes & np.uint64((1 << _BITS) - 1)
                        hit = np.flatnonzero(bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                        for s, h in zip(starts[hit].tolist(), hashes[hit].view(np.int64).tolist()):
                            out.append((row, doc_id, digest, h, s, length, canonical.slots(s, length, form > 0) if form < 2 else []))
                row += 1
            yield _columns(out, names, [pa.int64(), batch.schema.field(0).type, pa.int64(), *_WINDOW_TYPES])

    rows = documents.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(run, f"row long, doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, {_WINDOW_KIND}")


def _bitmap(items: DataFrame) -> bytes:
    """The lowest bits of all window hashes as a bitmap; made on the executors, so that at most its 8 MB reach the driver."""
    place = F.col("hash").bitwiseAND((1 << _BITS) - 1) + 1  # the functions count from 1
    made = items.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(1 << (_BITS - 3))
    for r in made.collect():
        at = (r["bucket"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def consistent(pairs: list[tuple[list[str], list[str]]]) -> bool:
    """Whether the slot values of an item and of a document map to each other one to one."""
    forth: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(forth.setdefault(a, b) == b and back.setdefault(b, a) == a for item, document in pairs for a, b in zip(item, document))


def _judge(found: list[dict], of: int, of_folded: int) -> tuple[float, int]:
    """The best consistent alignment of a document with an item: covered share and number of windows.

    Windows are tried together first; if their slots contradict each other (several
    variants of a question in one document), each alignment is judged by itself. This is done for the
    templates, for the folded form, and for both together, as parts of a copy may be renamed and others in capitals.
    """
    best = (0.0, 0)
    every = max(of, of_folded)
    for forms, total in ((_TEMPLATE, of), (_FOLDED, of_folded), (_TEMPLATE | _FOLDED, every)):
        some = [w for w in found if w["form"] & forms]
        groups = [some]
        if not consistent([(w["item_slots"], w["doc_slots"]) for w in some]):
            by_shift = defaultdict(list)
            for w in some:
                by_shift[w["start"] - w["item_start"]].append(w)
            groups = [g for g in by_shift.values() if consistent([(w["item_slots"], w["doc_slots"]) for w in g])]
        matched = max((len({w["item_start"] for w in g}) for g in groups), default=0)
        best = max(best, (min(1.0, matched / total) if total else 0.0, matched))
    return best


def _leaking_rows(documents: DataFrame, benchmark: DataFrame, window: int, coverage: float) -> DataFrame:
    """doc_id, text_hash, item_id, coverage, n_windows, one row for each pair of a document's row and an item."""
    kind, item_kind = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, text_hash long, item_id {item_kind}, coverage double, n_windows long"
    items = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    lengths = {r["length"]: r["literal"] for r in items.groupBy("length").agg(F.bool_or(F.col("form") >= _LITERAL).alias("literal")).collect()}  # at most ``window`` rows
    if not lengths:
        return documents.sparkSession.createDataFrame([], schema)
    found = stored(candidate_windows(documents, _bitmap(items), sorted(lengths), any(lit for n, lit in lengths.items() if n >= LEAST_TEMPLATE)), "candidate-windows")
    side = items.select("hash", "length", "item_id", "of", "of_folded", "form", F.col("start").alias("item_start"), F.col("slots").alias("item_slots"))
    held = found.groupBy("hash", "length").agg(F.count(F.lit(1)).alias("rows"))
    small = measured_bytes(side) <= BROADCAST_BYTES
    joined = found.join(F.broadcast(side), ["hash", "length"]) if small else skew_join(found, side, ["hash", "length"], held, found.count())
    joined = joined.select(
        "row", "doc_id", "text_hash", "item_id", "of", "of_folded", F.struct("start", "item_start", "form", F.col("slots").alias("doc_slots"), "item_slots").alias("w")
    )
    # A group is one document with one item: its size is bound by the document's length.
    grouped = joined.groupBy("row", "item_id").agg(*(F.first(c).alias(c) for c in ("doc_id", "text_hash", "of", "of_folded")), F.collect_list("w").alias("found"))
    least = F.least(*(F.when(F.col(c) > 0, F.col(c)) for c in ("of", "of_folded")))
    likely = grouped.filter(F.size(F.array_distinct(F.transform("found", lambda w: w["item_start"]))) >= coverage * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                share, matched = _judge(r["found"], r["of"], r["of_folded"])
                if share >= coverage:
                    out.append((r["doc_id"], r["text_hash"], r["item_id"], share, matched))
            kinds = [batch.schema.field("doc_id").type, pa.int64(), batch.schema.field("item_id").type, pa.float64(), pa.int64()]
            yield _columns(out, ["doc_id", "text_hash", "item_id", "coverage", "n_windows"], kinds)

    out = stored(likely.select("doc_id", "text_hash", "item_id", "of", "of_folded", "found").mapInArrow(run, schema), "leaks")
    release(items, found)
    return out


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, coverage, n_windows, one row per pair.

    ``coverage`` is the least share of an item's windows that a document must have. Items of fewer than
    ``window`` tokens are one window. Items of fewer than five tokens, and those of which numbers and units fill more than half of
    every window, are found only with the very same words. Case does not
    matter: the share is the best of the templates, of the folded form, and of both together.

    Edge cases: null or empty texts hold nothing, items with a null id or without any word are left out, a null
    doc_id is reported as null; repeated rows are searched one by one, and their best result counts; other columns
    are ignored; an empty benchmark or table gives no row. Whole texts are searched. Ids may be of any type.
    """
    pairs = _leaking_rows(documents, benchmark, window, coverage)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("n_windows").alias("n_windows"))


def remove_leaks(documents: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5) -> DataFrame:
    """The rows without those that hold a benchmark item; all columns stay.

    Each row is judged by its own text, so rows that repeat a doc_id, or have none, stay or go one by one. Null and empty texts
    stay; an empty benchmark removes nothing; columns of any names pass through.
    """
    return without(documents, _leaking_rows(documents, benchmark, window, coverage).select("doc_id", "text_hash").distinct())
