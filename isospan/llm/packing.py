"""Documents packed into sequences of a fixed number of tokens, by minimum bin slack.

A task works through its documents with a window of pieces that wait for a place. Whole sequences are cut off a document
at once, so what waits is shorter than a sequence. For each sequence the longest waiting piece is laid down and the room
behind it filled by a subset sum over the lengths that wait: the sums that can be reached are the bits of an integer, a
length with its count joins them by shifts, and the steps are walked back from the largest sum for how many of each
length to take. What room is left, if any, is filled by cutting one more piece. Sequences never cross tasks, so a task
that is run again replaces its own sequences whole and nothing is shuffled.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import doc_view, parts, texts
from .token_counts import byte_letters

#: Distinct chunks between white space whose ids a worker remembers, twice: beyond, those that it hasn't met since it last
#: was full are forgotten.
REMEMBERED = 500_000
#: Bytes of one text that are tokenized at once.
SLICE = 1 << 20
#: Pieces that wait at most before some are packed, and pieces in a batch of results.
WINDOW, BATCH = 4096, 1024
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
SPACES = b" \t\n\r\x0b\x0c"
#: Words of Latin-1 letters, after A-Z went to lower case.
WORD = re.compile("[a-zÀ-ÖØ-öø-ÿ]+").fullmatch


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The text cut at white space into parts of about the size, or longer where there is none."""
    at = 0
    while len(text) - at > size:
        end = min((k for s in SPACES if (k := text.find(s, at + size)) >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Ids:
    """Token ids as little-endian 32-bit numbers, of texts cut at ASCII white space: no token of the vocabulary and no
    step of its normalisation, which ends in composed lower case, reaches across."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores out
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _chunks(self, text: bytes) -> list[bytes]:
        """In lower case, so that fewer differ; unless that makes a special token of something else."""
        lower = text.lower()
        return (text if any(lower.count(s) != text.count(s) for s in self.special) else lower).split()

    def _learn(self, chunks: set[bytes]) -> None:
        """A full stop or comma behind a letter or digit is a token of its own, so what precedes it is known more often.
        A word of Latin-1 letters is one piece whose normal form is its lower case: the model alone is asked for it."""
        ends = {c for c in chunks if c[-1:] in b".," and c[-2:-1].isalnum()}
        new = chunks.difference(ends).union({c[:-1] for c in ends}, (b".", b",")).difference(self.known)
        known, other = self.known, []
        for c in new:
            if (ids := self.before.get(c)) is not None:
                known[c] = ids
            elif WORD(s := c.decode("utf-8", "replace")):
                word = s if c.isascii() else s.lower().encode().decode("latin-1").translate(self.letters)
                known[c] = array("I", [t.id for t in self.merge(word)]).tobytes()
            else:
                other.append((c, s))
        for at in range(0, len(other), 2000):
            part = other[at : at + 2000]
            coded = self.library.encode_batch_fast([s for _, s in part], add_special_tokens=False)
            known.update((c, array("I", e.ids).tobytes()) for (c, _), e in zip(part, coded, strict=True))
        known.update((c, known[c[:-1]] + known[c[-1:]]) for c in ends)

    def __call__(self, batch: list[bytes]) -> list[bytes]:
        chunks = [self._chunks(t) for t in batch]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        if new := set(chain.from_iterable(chunks)).difference(self.known):
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


@dataclass
class Document:
    doc_id: int | None
    tokens: int = 0
    left: int = 0  #: ids without a place so far
    placed: list[tuple] = field(default_factory=list)  #: start, ids, sequence, offset


@cache
def ids_of(path: str) -> Ids:
    """One for each vocabulary and worker, so that tasks that follow one another know what the ones before learnt."""
    return Ids(path)


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to the room from below; counts: by length."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        have, take = min(int(counts[length]), room // length), 1
        while have:
            take = min(take, have)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            have, take = have - take, take * 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


class Packer:
    """Takes documents and gives back those of which every piece has its place."""

    def __init__(self, capacity: int, window: int, first: int):
        self.capacity, self.window, self.sequence = capacity, window, first
        self.waiting: dict[int, deque] = {}
        self.counts = np.zeros(capacity + 1, np.int64)
        self.done: list[Document] = []

    def _place(self, doc: Document, start: int, ids: bytes, at: int) -> int:
        doc.placed.append((start, ids, self.sequence, at))
        doc.left -= len(ids) // 4
        if not doc.left:
            self.done.append(doc)
        return at + len(ids) // 4

    def _wait(self, doc: Document, start: int, ids: bytes) -> None:
        self.waiting.setdefault(len(ids) // 4, deque()).append((doc, start, ids))
        self.counts[len(ids) // 4] += 1

    def _next(self, length: int) -> tuple[Document, int, bytes]:
        self.counts[length] -= 1
        return self.waiting[length].popleft()

    def add(self, doc: Document, ids: Iterator[bytes]) -> None:
        """ids: of the document, in parts."""
        doc.left, rest, whole = 1 << 62, b"", 4 * self.capacity
        for part in ids:
            rest += part
            full = len(rest) - len(rest) % whole
            for at in range(0, full, whole):
                self._place(doc, doc.tokens, rest[at : at + whole], 0)
                doc.tokens, self.sequence = doc.tokens + self.capacity, self.sequence + 1
            rest = rest[full:]
        start, doc.left = doc.tokens, len(rest) // 4
        doc.tokens += doc.left
        if rest:
            self._wait(doc, start, rest)
            if self.counts.sum() >= self.window:
                self.pack(self.window // 2)
        else:
            self.done.append(doc)

    def pack(self, leave: int = 0) -> None:
        """Pack until no more pieces wait than are to be left, or what waits fills no sequence."""
        lengths, size = np.arange(len(self.counts)), self.capacity
        while self.counts.sum() > leave and self.counts @ lengths >= size:
            longest = int(np.flatnonzero(self.counts)[-1])
            at = self._place(*self._next(longest), 0)
            for length, n in fill(self.counts, size - at).items() if at < size else ():
                for _ in range(n):
                    at = self._place(*self._next(length), at)
            if at < size:  # every piece that waits is longer than the room
                doc, start, ids = self._next(int(np.flatnonzero(self.counts)[0]))
                cut = 4 * (size - at)
                self._wait(doc, start + size - at, ids[cut:])
                self._place(doc, start, ids[:cut], at)
            self.sequence += 1

    def finish(self) -> None:
        """Pack all; the last pieces, too few for a sequence, go to sequences of a power of two that need no padding."""
        self.pack()
        total, at = int(self.counts @ np.arange(len(self.counts))), 0
        size = 1 << total.bit_length() >> 1
        while total:
            doc, start, ids = self._next(int(np.flatnonzero(self.counts)[-1]))
            while ids:
                cut = 4 * (size - at)
                at = self._place(doc, start, ids[:cut], at)
                start, ids = start + cut // 4, ids[cut:]
                if at == size:
                    total, at, self.sequence = total - size, 0, self.sequence + 1
                    size = 1 << total.bit_length() >> 1

    def pieces(self) -> Iterator[pa.RecordBatch]:
        """The pieces of finished documents, which are then forgotten."""
        rows = [(d.doc_id, start, len(ids) // 4, ids, d.tokens, seq, at) for d in self.done for start, ids, seq, at in d.placed]
        self.done = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        for k in range(0, len(rows), BATCH):
            columns = zip(*rows[k : k + BATCH], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """The pieces of every document: doc_id, start (its ids before the piece), length, ids (little-endian unsigned 32-bit
    numbers), doc_tokens, sequence_id, offset (in the sequence, gapless from 0).

    vocabulary: path of a tokenizer file in the JSON format, the same on every executor, whose tokens don't reach across
    white space; end_id is put behind every document. Sequences have `capacity` ids (a power of two), but for the last
    few of each task, which have smaller powers of two, so that none needs padding. A document is cut at every
    `capacity` ids, where a sequence had room left, or in a task's last sequences; not otherwise.

    A null or empty text has its end_id alone; a null doc_id stays null; each of several rows of the same id is a
    document; an empty table has no pieces. Further columns are left out.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = ids_of(vocabulary), Packer(capacity, window, TaskContext.get().partitionId() << 33)
        for b in parts(batches, 200):
            ids, raw = b.column(0).to_pylist(), texts(b)
            small = [len(t) <= SLICE for t in raw]
            coded = iter(coder([t for t, s in zip(raw, small, strict=True) if s]))
            for doc_id, t, s in zip(ids, raw, small, strict=True):
                packer.add(Document(doc_id), chain([next(coded)] if s else (coder([x])[0] for x in slices(t)), [end]))
            yield from packer.pieces()
        packer.finish()
        yield from packer.pieces()

    return doc_view(docs).mapInArrow(run, PIECES)
