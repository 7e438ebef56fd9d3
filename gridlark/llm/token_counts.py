"""Operator 2: token counts by rank-synchronous array merging.

Pre-tokens of a batch lie end to end in one ragged numpy array of symbol ids. Each step finds every
sequence's lowest-rank pair and merges all its occurrences in all sequences at once; sequences
without a mergeable pair leave the array, and the symbols that survive are the tokens. Only pairs
beside a merge get a new rank. Merging all occurrences of the lowest-rank pair of a sequence equals
merging them one by one, as a merge can't make a pair of a lower rank than its own.

Defined results: null and empty texts have 0 bytes and 0 tokens. A special string in a text is one
token, as the library has it by default. Lone surrogates can't occur in Parquet strings. Repeated
rows are counted row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.common import held, scan, table
from gridlark.llm.tokens import BytePairFile, PieceCache, pieces

_SCHEMA = "doc_id long,n_bytes long,n_tokens long,over_limit boolean"
_NONE = np.int32(2**31 - 1)


class RankMerger:
    """Counts what byte sequences come to under a ranked list of merges."""

    def __init__(self, file: BytePairFile):
        vocab, self.width = file.vocab, file.size
        self.first = np.array([vocab[file.spelled(chr(b)) if b < 128 else bytes([b]).decode("latin-1").translate(file._map)] for b in range(256)], np.int64)
        pair = np.array([vocab[a] * self.width + vocab[b] for a, b in file.merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = pair[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in file.merges], np.int64)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (or _NONE) and what the pairs become."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE), self.made[at]

    def counts(self, words: list[bytes]) -> np.ndarray:
        size = np.array([len(w) for w in words], np.int64)
        out = size.copy()
        live = np.flatnonzero(size > 1)
        if not len(live) or not len(self.pairs):
            return out
        symbol = self.first[np.frombuffer(b"".join([words[i] for i in live]), np.uint8)]
        seq = np.repeat(np.arange(len(live)), size[live])
        last = np.append(seq[1:] != seq[:-1], True)
        rank = np.full(len(symbol), _NONE, np.int32)
        made = np.zeros(len(symbol), np.int64)
        rank[:-1], made[:-1] = self._rank(symbol[:-1], symbol[1:])
        rank[last] = _NONE
        while len(symbol):
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(symbol)))
            stop = best == _NONE
            if stop.any():
                out[live[seq[start[stop]]]] = length[stop]
                keep = np.repeat(~stop, length)
                symbol, seq, last, rank, made = (x[keep] for x in (symbol, seq, last, rank, made))
                best, length = best[~stop], length[~stop]
                if not len(symbol):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, length))
            # in a run of equal symbols the pairs overlap: take every other one from the left
            joined = np.append(False, chosen[1:] == chosen[:-1] + 1)
            if joined.any():
                run_start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(chosen))))
                chosen = chosen[(np.arange(len(chosen)) - run_start) % 2 == 0]
            symbol[chosen] = made[chosen]
            last[chosen] = last[chosen + 1]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            place = np.cumsum(keep) - 1
            symbol, seq, last, rank, made = (x[keep] for x in (symbol, seq, last, rank, made))
            fresh = place[chosen]
            fresh = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1]))
            rank[fresh] = _NONE
            fresh = fresh[~last[fresh]]
            rank[fresh], made[fresh] = self._rank(symbol[fresh], symbol[fresh + 1])
        return out


class TokenCounter:
    """Counts tokens of texts; one for each Python worker and vocabulary file."""

    def __init__(self, path: str):
        self.file = BytePairFile(path)
        self.merger = RankMerger(self.file)
        self.cache = PieceCache(self._work)

    def _work(self, missing: list[str], space: bool) -> list[int]:
        split = [self.file.pre_tokens(p, space) for p in missing]
        place: dict[str, int] = {}
        for own in split:
            for t in own:
                place.setdefault(t, len(place))
        n = self.merger.counts([t.encode("utf-8", "surrogatepass") for t in place]).tolist()
        return [sum(n[place[t]] for t in own) for own in split]

    def counts(self, texts: list[str]) -> list[int]:
        total = [0] * len(texts)
        first: list[tuple[int, str]] = []
        rest: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            sections, ids = self.file.sections(text)
            total[k] = len(ids)
            for section in sections:
                head, *tail = pieces(section)
                first.append((k, head))
                rest.append((k, tail))
        known = self.cache.fill({p for _, p in first}, False)
        for k, p in first:
            total[k] += known[p]
        known = self.cache.fill(set().union(*(tail for _, tail in rest)), True)
        for k, tail in rest:
            total[k] += sum(map(known.__getitem__, tail))
        return total


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per document its UTF-8 bytes, tokens under the vocabulary at ``path``, and whether they pass ``limit``."""

    def count(batch):
        counter = held(f"counter:{path}", lambda: TokenCounter(path))
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        n = counter.counts(texts)
        return {"doc_id": ids, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return scan(docs, ["doc_id", "text"], count, _SCHEMA, limit=4 << 20, holds=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
