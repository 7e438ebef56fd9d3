"""Operator 13: packing documents into windows by minimum bin slack.

Each task streams its rows, encodes them, cuts whole windows off long documents and keeps what remains of
each document in a pool, by length. A window takes the longest remaining length; a subset-sum table over bitsets (one
Python integer, bit k: a total of k ids can be reached) then picks the multiset of remaining lengths that
comes closest to the capacity, and walking the tables backwards gives how often each length is used. The
multiset fills as many windows as the counts allow. Where the least slack isn't zero, the longest document left is
cut to fill it. What is left at the end of a task, less than a window, goes to sequences of powers of two, which
need no padding. So no window is padded, and documents are cut only where no multiset fits.

The pool is bounded in ids, whatever the task reads: beyond ``high`` ids windows are filled until a quarter is left. Nothing is
shuffled; a retried task reads the same split and packs it the same way.

Defined results: null and empty texts have the end id alone; rows are packed row by row, whatever their doc_id
(null, repeated); an empty table gives no rows; a text longer than the pool is cut as it comes. Special strings in texts are
single ids, as the library has it by default. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.common import held, ship, slices, spark_to_arrow, table
from gridlark.llm.tokens import ENTRY

WINDOW, END_ID = 2048, 1
_SCHEMA = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long"


#: Below this character letters lower to letters, and no two characters compose.
_LATIN_END = "\u0250"
#: The pre-tokens of lower-case words of printable characters below it: contractions, letters, single digits, anything else.
_PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\w\\s]|_)+")


class WordEncoder:
    """Texts to id bytes with a vocabulary file whose pre-tokenizer never looks across white space.

    What a word becomes is kept in two generations of ``bound`` bytes each.
    """

    def __init__(self, path: str, bound: int = 80 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bound, self.new, self.old, self.size = bound, {"": b""}, {}, 0
        # a vocabulary that marks the last token of each pre-token shows where one ends
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(size, bool)
            self.ends[[k for t, k in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def _coded(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), 4096):
            for e in self.library.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False):
                yield np.array(e.ids, self.dtype).tobytes()

    def _coded_together(self, words: list[str]) -> Iterator[bytes]:
        """Words whose pre-tokens are known to the pattern here: many in one text, cut where as many pre-tokens have ended."""
        for k in range(0, len(words), 8192):
            some = words[k : k + 8192]
            flat = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends[flat]) + 1
            cut = np.cumsum([1 if w.isalpha() else len(_PRE_TOKEN.findall(w.lower())) for w in some])
            if cut[-1] != len(ends):
                yield from self._coded(some)
                continue
            edge = [0, *(ends[cut - 1] * self.dtype.itemsize).tolist()]
            flat = flat.tobytes()
            for a, b in zip(edge, edge[1:]):
                yield flat[a:b]

    def _fill(self, words: set[str]) -> None:
        plain, other, old, bytes_ = [], [], self.old, 0
        for w in words - self.new.keys():
            if (known := old.get(w)) is not None:
                self.new[w] = known
                bytes_ += ENTRY + len(w) + len(known)
            elif self.ends is not None and max(w) < _LATIN_END and w.isprintable() and "\u0130" not in w:
                plain.append(w)
            else:
                other.append(w)
        for own, coded in ((plain, self._coded_together(plain)), (other, self._coded(other))):
            for w, c in zip(own, coded):
                self.new[w] = c
                bytes_ += ENTRY + len(w) + len(c)
        self.size += bytes_

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.size > self.bound:
            self.old, self.new, self.size = self.new, {"": b""}, 0
        odd = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        split = [() if k in odd else t.replace("\n", " ").split(" ") for k, t in enumerate(texts)]
        self._fill(set().union(*split))
        out = [b"".join(map(self.new.__getitem__, words)) for words in split]
        for k, coded in zip(sorted(odd), self._coded([texts[k] for k in sorted(odd)])):
            out[k] = coded
        return out


def least_slack(lengths: list[int], counts, capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of ``lengths`` (ascending) that holds the longest one and comes closest to ``capacity``, and its slack."""
    longest = lengths[-1]
    target = capacity - longest
    mask, reach, trail = (1 << target + 1) - 1, 1, []
    for at in range(bisect_left(lengths, target + 1) - 1, -1, -1):
        length = lengths[at]
        most = min(counts(length) - (length == longest), target // length)
        trail.append((length, most, reach))
        step = 1
        while most > 0:  # copies in powers of two: every number up to ``most`` is reached
            step = min(step, most)
            reach |= reach << step * length & mask
            most -= step
            step *= 2
        if reach >> target & 1:
            break
    left = best = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, most, before in reversed(trail):
        used = next(k for k in range(most + 1) if left >= k * length and before >> left - k * length & 1)
        if used:
            chosen[length] = chosen.get(length, 0) + used
            left -= used * length
    return chosen, target - best


class Packer:
    """The pool of one task. Pieces are rows of ``_SCHEMA`` with the piece's ids behind."""

    def __init__(self, first_sequence: int, dtype: np.dtype, window: int):
        self.sequence, self.dtype, self.window = first_sequence, dtype, window
        self.lengths: list[int] = []
        self.of: dict[int, list] = {}
        self.held = 0
        self.rows: list[tuple] = []

    def _put(self, doc, start: int, total: int, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        if n not in self.of:
            insort(self.lengths, n)
            self.of[n] = []
        self.of[n].append((doc, start, total, ids))
        self.held += n

    def _take(self, length: int) -> tuple:
        item = self.of[length].pop()
        if not self.of[length]:
            del self.of[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        self.held -= length
        return item

    def _piece(self, item: tuple, offset: int) -> int:
        doc, start, total, ids = item
        wide = np.frombuffer(ids, self.dtype).astype("<u4")
        self.rows.append((doc, start, len(wide), zlib.crc32(wide), total, self.sequence, offset, ids))
        return offset + len(wide)

    def add(self, doc, ids: bytes) -> None:
        width = self.dtype.itemsize
        total, start = len(ids) // width, 0
        while total - start >= self.window:
            self._piece((doc, start, total, ids[start * width : (start + self.window) * width]), 0)
            self.sequence += 1
            start += self.window
        if start < total:
            self._put(doc, start, total, ids[start * width :])

    def _cut(self, size: int, offset: int) -> int:
        """Fills ``size`` ids with the head of the longest item."""
        doc, start, total, ids = self._take(self.lengths[-1])
        edge = size * self.dtype.itemsize
        if edge < len(ids):
            self._put(doc, start + size, total, ids[edge:])
        return self._piece((doc, start, total, ids[:edge]), offset)

    def fill(self, until: int) -> None:
        """Fills windows while more than ``until`` ids, and enough for a window, are held."""
        while self.held > until and self.held >= self.window:
            chosen, slack = least_slack(self.lengths, lambda n: len(self.of[n]), self.window)
            times = 1 if slack else min(len(self.of[n]) // k for n, k in chosen.items())
            for _ in range(times):
                offset = 0
                for length, k in chosen.items():
                    for _ in range(k):
                        offset = self._piece(self._take(length), offset)
                if slack:
                    self._cut(slack, offset)
                self.sequence += 1

    def finish(self) -> None:
        """Fills what can be filled; the rest goes to sequences whose sizes are the powers of two in its total."""
        self.fill(0)
        size = self.window
        while self.held:
            while size > self.held:
                size //= 2
            offset = 0
            while offset < size:
                offset = self._cut(min(size - offset, self.lengths[-1]), offset)
            self.sequence += 1


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, high: int = 4 << 20, ids: bool = False) -> DataFrame:
    """Per piece of a document its place in the document and in its sequence; with ``ids``, also the ids themselves (little-endian, 2 or 4 bytes each)."""
    if window & window - 1:
        raise ValueError("the window must be a power of two")
    ship(docs.sparkSession)
    schema = _SCHEMA + (",ids binary" if ids else "")
    target = spark_to_arrow(schema)

    def run(batches):
        from pyspark import TaskContext

        encoder = held(f"words:{path}", lambda: WordEncoder(path))
        end = np.array([end_id], encoder.dtype).tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, encoder.dtype, window)

        def out():
            rows, packer.rows = packer.rows, []
            for k in range(0, len(rows), 8192):
                columns = list(zip(*rows[k : k + 8192]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for doc, coded in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    packer.add(doc, coded + end)
                    if packer.held > high:
                        packer.fill(high // 4)
                yield from out()
        packer.finish()
        yield from out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
