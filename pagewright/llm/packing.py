"""Hierarchical multi-length packing.

Every document's token ids (with a closing id) are routed to context-size tiers:
whole windows of the largest tier are cut off first, and what remains goes to the
smallest tier that holds it. Each tier is packed best fit into windows of its own size;
gaps of long windows are filled from the pools of shorter tiers, where needed with part
of a piece. What is open when a task ends is split at powers of two, so that no
sequence needs padding beyond a power of two. Sequences of one size are dealt to step groups of
equally many tokens.

Documents are packed within their input partition: ids never travel, a task needs
memory for one batch and the open pools only, and a repeated task gives the same rows. There is
no shuffle at any input size, and less than one window of each tier per task is cut up.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import text_batches


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    A ``.json`` file for ``tokenizers`` has the same vocabulary as the ``.tiktoken`` file
    beside it. The latter's encoder gives the same ids of ordinary text about five times faster and is used where it is
    there. A text that holds the string of an added token is encoded by ``tokenizers`` itself, which makes that string one id.
    """
    import os

    @lru_cache(maxsize=1)
    def defining():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def by_definition(text: str) -> list[int]:
        return defining().encode(text, add_special_tokens=False).ids

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return by_definition
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        added = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    ordinary = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: by_definition(text) if any(a in text for a in added) else ordinary(text)


class Piece:
    """A run of one document's ids: where it starts and the ids as little-endian 32-bit bytes."""

    __slots__ = ("document", "start", "ids")

    def __init__(self, document: int, start: int, ids: memoryview):
        self.document, self.start, self.ids = document, start, ids

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.document, self.start, self.ids[: 4 * length]), Piece(self.document, self.start + length, self.ids[4 * length :])


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` return closed windows as lists of pieces.

    ``tiers`` are powers of two, e.g. 128 to 1024. ``pool`` is the number of pieces of a
    tier that are gathered before the tier is packed; it bounds the memory.
    """

    def __init__(self, tiers: Sequence[int], pool: int = 256):
        self.tiers = sorted(tiers)
        if any(t < 1 or t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self.largest = self.tiers[-1]
        self.pool = pool
        self.waiting: dict[int, deque[Piece]] = {t: deque() for t in self.tiers}

    def add(self, document: int, ids: bytes) -> list[list[Piece]]:
        closed = []
        rest = Piece(document, 0, memoryview(ids))
        while len(rest) >= self.largest:
            window, rest = rest.cut(self.largest)
            closed.append([window])
        if len(rest):
            rest.ids = memoryview(bytes(rest.ids))  # what waits must not hold on to the whole document
            tier = self.tiers[bisect_left(self.tiers, len(rest))]
            if len(rest) == tier:
                closed.append([rest])
            else:
                self.waiting[tier].append(rest)
                if len(self.waiting[tier]) >= self.pool:
                    closed += self._pack(tier)
        return closed

    def _pack(self, tier: int) -> list[list[Piece]]:
        """Pack a tier's pool: longest piece first, each window filled best fit, the gap from shorter tiers."""
        pool = sorted(self.waiting[tier], key=len)
        self.waiting[tier].clear()
        lengths = [len(p) for p in pool]
        closed = []
        while pool:
            window, room = [pool.pop()], tier - lengths.pop()
            while room and lengths and lengths[0] <= room:  # the largest that fits
                at = bisect_left(lengths, room + 1) - 1
                room -= lengths.pop(at)
                window.append(pool.pop(at))
            for shorter in reversed(self.tiers[: self.tiers.index(tier)]):
                room = self._fill(window, room, shorter)
            if room and pool:  # no shorter piece is left: part of a piece of this tier
                head, tail = pool.pop(0).cut(room)
                lengths.pop(0)
                window.append(head)
                at = bisect_left(lengths, len(tail))
                lengths.insert(at, len(tail))
                pool.insert(at, tail)
                room = 0
            if room:
                self.waiting[tier].extend(window)
                break
            closed.append(window)
        return closed

    def _fill(self, window: list[Piece], room: int, tier: int) -> int:
        waiting = self.waiting[tier]
        while room and waiting:
            piece = waiting.popleft()
            if len(piece) > room:
                piece, tail = piece.cut(room)
                waiting.appendleft(tail)
            window.append(piece)
            room -= len(piece)
        return room

    def finish(self) -> list[list[Piece]]:
        """Pack what waits, long tiers first; the last open pieces are split at powers of two."""
        closed = []
        for tier in reversed(self.tiers):
            closed += self._pack(tier)
        left = deque(p for t in self.tiers for p in self.waiting[t])
        for t in self.tiers:
            self.waiting[t].clear()
        total = sum(map(len, left))
        while total:
            size = min(self.largest, 1 << (total.bit_length() - 1))
            window: list[Piece] = []
            room = size
            while room:
                piece = left.popleft()
                if len(piece) > room:
                    piece, tail = piece.cut(room)
                    left.appendleft(tail)
                window.append(piece)
                room -= len(piece)
            closed.append(window)
            total -= size
        return closed


class StepGroups:
    """Deals sequences to groups of equally many tokens, one size after the other within a group.

    A group holds ``tokens // size`` sequences of one size, so each step of a training run
    handles the same number of tokens at one context length.
    """

    def __init__(self, tokens: int):
        self.tokens = tokens
        self.open: dict[int, tuple[int, int]] = {}
        self.made = 0

    def assign(self, size: int) -> int:
        padded = 1 << (size - 1).bit_length()
        group, held = self.open.get(padded, (None, 0))
        if group is None:
            group, self.made = self.made, self.made + 1
        held += padded
        self.open[padded] = (None, 0) if held + padded > self.tokens else (group, held)
        return group


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    tiers: Sequence[int] = (128, 256, 512, 1024),
    step_tokens: int = 65_536,
    pool: int = 256,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group.

    Each token id of a document (its text's ids, then ``end_id``) lies in exactly one
    piece. Within a sequence the offsets are gapless from 0. sequence_id and step_group are unique over
    all tasks: the task's partition number stands above bit 33.

    Edge cases: a null or empty text is the closing id alone; null ids pass through; repeated
    rows are packed one by one; other columns are ignored; an empty table gives no row. A long
    text is cut into windows as a whole, never at a prefix. doc_id may be of any type. The last group of each
    sequence length in a task holds fewer tokens than ``step_tokens``.
    """
    fixed_tiers = tuple(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        encode = _encoder(tokenizer)
        packer, groups = Packer(fixed_tiers, pool), StepGroups(step_tokens)
        names: dict[int, list] = {}  # open documents: id, tokens, tokens not yet returned
        sequence, count = first, 0
        end = [end_id]
        out: list[tuple] = []

        def close(windows: list[list[Piece]]) -> None:
            nonlocal sequence
            for window in windows:
                size = sum(map(len, window))
                group, offset = first + groups.assign(size), 0
                for piece in window:
                    known = names[piece.document]
                    n = len(piece)
                    out.append((known[0], piece.start, n, zlib.crc32(piece.ids), known[1], sequence, offset, size, group))
                    offset += n
                    known[2] -= n
                    if not known[2]:
                        del names[piece.document]
                sequence += 1

        for batch in text_batches(batches, 2 << 20):
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1)):
                tokens = np.array(encode(text.as_py() or "") + end, "<u4")
                names[count] = [doc_id, len(tokens), len(tokens)]
                close(packer.add(count, tokens.tobytes()))
                count += 1
            id_type = batch.schema.field(0).type
            yield _rows(out, id_type)
            out.clear()
        close(packer.finish())
        if out:
            yield _rows(out, id_type)

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(
        run,
        f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long",
    )


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, id_type if i == 0 else pa.int64()) for i, c in enumerate(columns)], names)
