"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts stand one after another in one array of symbols (ragged: a second array has where each begins).
In each round every sequence finds the lowest rank among its neighbouring pairs, and all places of that pair are merged
at once, in all sequences; a sequence without a pair that merges is done, and what is left of it is its count. Each
different pre-token is merged once and its count remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import ship, text_or_empty

#: Counts remembered by a worker; the memory is emptied when it is full.
MEMO = 600_000
#: Bytes of pre-tokens that are merged together; a longer pre-token is merged alone.
BATCH = 1 << 18
#: A pre-token of more bytes is merged by count_long.
LONG = 1 << 12
_NONE = np.iinfo(np.int64).max


class Merges:
    """The merges of a byte-level file as arrays: a pair's key, its rank and the symbol that it becomes.

    All places of the lowest pair may be merged at once because a symbol takes part only in merges of higher ranks than
    the one merge that makes it; files that break this are not taken (see `plain`).
    """

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        letters = pretokens.byte_letters()
        self.size = max(vocabulary.values()) + 1
        self.of_byte = np.array([vocabulary.get(letters[b], -1) for b in range(256)], np.int64)
        left, right, made = (np.array([vocabulary[x] for x in column], np.int64) for column in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        rank = np.arange(len(pairs), dtype=np.int64)
        born = np.full(self.size, -1, np.int64)
        born[made] = rank
        self.plain = bool((self.of_byte >= 0).all() and len(np.unique(made)) == len(made) and (born[left] < rank).all() and (born[right] < rank).all() and not np.isin(made, self.of_byte).any())
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], rank[order], made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE)
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each sequence of bytes."""
        out = np.zeros(len(sequences), np.int64)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        owner = np.flatnonzero(lengths)  # of the sequences that are still merged, which one it is
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        lengths = lengths[owner]
        rank = self._ranked(symbols, lengths)
        while len(owner):
            begins = np.cumsum(lengths) - lengths
            low = np.minimum.reduceat(rank, begins)
            on = low < _NONE
            if not on.all():
                out[owner[~on]] = lengths[~on]
                keep = np.repeat(on, lengths)
                symbols, rank, owner, lengths, low = symbols[keep], rank[keep], owner[on], lengths[on], low[on]
                if not len(owner):
                    break
            lowest = np.repeat(low, lengths)
            hit = rank == lowest
            place = np.arange(len(hit))
            first = hit.copy()
            first[1:] &= ~hit[:-1]
            since = place - np.maximum.accumulate(np.where(first, place, 0))
            hit &= since % 2 == 0  # of a run like a a a a each symbol goes into one pair, from the left
            at = np.flatnonzero(hit)
            symbols[at] = self.made[lowest[at]]
            keep = np.ones(len(hit), bool)
            keep[at + 1] = False  # the last symbol of a sequence has no pair, so at + 1 is in the same one
            lengths = np.add.reduceat(keep, np.cumsum(lengths) - lengths, dtype=np.int64)
            symbols, rank, merged = symbols[keep], rank[keep], hit[keep]
            stale = merged.copy()
            stale[:-1] |= merged[1:]
            new = np.flatnonzero(stale)
            rank[new] = self.ranks(symbols[new], symbols[np.minimum(new + 1, len(symbols) - 1)])
            rank[np.cumsum(lengths) - 1] = _NONE
        return out

    def count_long(self, sequence: bytes) -> int:
        """As count, for one long sequence, whose lowest pairs differ by thousands: places wait under their pair's rank, so a
        round costs as much as the places that it merges, not as the sequence."""
        symbols = self.of_byte[np.frombuffer(sequence, np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = self._ranked(symbols, np.array([n]))
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < _NONE]
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            for group in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1):
                if len(group):
                    key = int(rank[group[0]])
                    if key not in waiting:
                        waiting[key] = []
                        heappush(heap, key)
                    waiting[key].append(group)

        wait(np.arange(n))
        left = n
        while heap:
            low = heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(low)))
            at = at[rank[at] == low]  # others have changed since
            if not len(at):
                continue
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            gone = after[at]
            symbols[at], rank[gone] = self.made[low], _NONE
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left -= len(at)
            stale = np.unique(np.concatenate([at, before[at[before[at] >= 0]]]))
            following = after[stale]
            rank[stale] = np.where(following < n, self.ranks(symbols[stale], symbols[np.minimum(following, n - 1)]), _NONE)
            wait(stale)
        return left

    def _ranked(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rank of each symbol's pair with the next one; the last symbol of a sequence has none."""
        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        if len(lengths):
            rank[np.cumsum(lengths) - 1] = _NONE
        return rank


class Counts:
    """Numbers of tokens by a tokenizers or sentencepiece file, as its library gives them for whole texts.

    Plain byte-level files (no normalizer, dropout or prefix space, merges in order of birth) are counted by merging arrays;
    strings of their special tokens in a text are one token each, as is the library's default. Other files are left to
    their library.
    """

    def __init__(self, path: str):
        self.library = self.special = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(model.encode(t)) for t in texts]
            return
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        by_bytes = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not file.get("normalizer")
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip"))
        if by_bytes and not odd:
            self.merges = Merges(model["vocab"], model["merges"])
            if self.merges.plain:
                names = sorted((a["content"] for a in added), key=len, reverse=True)
                self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
                self.memo: dict[bytes, int] = {}
                return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.library = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: list[str]) -> np.ndarray:
        if self.library:
            return np.fromiter(self.library(texts), np.int64, len(texts))
        counts, pieces, owner = np.zeros(len(texts), np.int64), [], []
        for k, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            counts[k] = len(parts) - 1
            for part in parts:
                own = [part] if len(part) <= pretokens.PIECE else list(pretokens.safe_pieces(part, pretokens.PIECE))
                pieces += own
                owner += [k] * len(own)
        if not pieces:
            return counts
        matches, indices, until = pretokens.matches_of(pieces)
        before = np.concatenate([[0], np.cumsum(self._counts(matches)[indices])])
        np.add.at(counts, owner, np.diff(before[until]))
        return counts

    def _counts(self, matches: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        out = np.fromiter(map(self.memo.get, matches, repeat(-1)), np.int64, len(matches))
        missed = np.flatnonzero(out < 0)
        sizes = np.cumsum(np.fromiter((len(matches[k]) for k in missed.tolist()), np.int64, len(missed)))
        at = 0
        while at < len(missed):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH, "right")))
            long = [k for k in range(at, to) if sizes[k] - (sizes[k - 1] if k else 0) > LONG]
            if long:  # alone
                to = max(at + 1, long[0])
            new = [matches[k] for k in missed[at:to].tolist()]
            found = self.merges.count(new) if len(new) > 1 or len(new[0]) <= LONG else np.array([self.merges.count_long(new[0])])
            out[missed[at:to]] = found
            self.memo.update((m, n) for m, n in zip(new, found.tolist()) if len(m) < 256)
            at = to
        return out


@lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    return Counts(path)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of = counts_of(path).of
        for b in batches:
            for part in pretokens.slices(b):
                sizes = pc.binary_length(part.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(of(part.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row: bytes of the text in UTF-8, tokens of the whole text as the
    library of the file `tokenizer` counts them (no begin, end or added tokens), and whether they are more than limit.

    A null or empty text has 0 of both. Null and repeated ids pass through, each row by itself; an empty table gives no
    rows; other columns are ignored, whatever their names. Rows never meet, so nothing is shuffled. Texts of any length are
    split where pre-tokens end; a single pre-token is held as a whole.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_counter(tokenizer), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
