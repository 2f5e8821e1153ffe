"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

The items are dealt into blocks of bounded size, and a task for each block writes its index to the shared folder: the
sorted n-grams (seeds), where each one stands in which items, and the items' words. Every n-gram of an item is a
seed, however often or rarely it is held: in an edited copy any of them may be the only one left whole. One pass over the
documents joins their n-grams to the seeds of every block, by mapped files; where a document holds a seed, the item
is aligned with the words around it. Documents never move, and only names of blocks come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import filesystem, flat_array, row_of, ship, shared_dir, with_row
from .words import PUNCTUATION, shingles, word_hashes

_LEAK = "array<struct<item_id: bigint, score: double, matches: int, first_byte: int, end_byte: int>>"
_LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("matches", pa.int32()), ("first_byte", pa.int32()), ("end_byte", pa.int32())]))
MATCH, MISMATCH, GAP = 2, -1, -1
#: Stands for a null id within an index.
NO_ID = -(2**63)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: the best local score, its matches, and the first and end word of the passage."""
    n = len(words)
    place = np.arange(n + 1)
    rows = np.zeros((len(item) + 1, n + 1), np.int32)
    equal = item[:, None] == words[None, :]
    for i in range(len(item)):
        up = rows[i]
        best = np.maximum(up + GAP, 0)
        best[1:] = np.maximum(best[1:], up[:-1] + np.where(equal[i], MATCH, MISMATCH))
        best[0] = 0
        # a gap in the item: the best of all places to the left, less their distance
        rows[i + 1] = np.maximum.accumulate(best - GAP * place) + GAP * place
    i, j = np.unravel_index(int(rows.argmax()), rows.shape)
    score, end, matches = int(rows[i, j]), int(j), 0
    while i and j and rows[i, j]:
        if rows[i, j] == rows[i - 1, j - 1] + (MATCH if equal[i - 1, j - 1] else MISMATCH):
            matches += int(equal[i - 1, j - 1])
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matches, int(j), end


class Items:
    """A block of test items: ids, words (text k has words[bounds[k] : bounds[k + 1]]), the sorted seeds, and for seed s
    the items and places held[begins[s] : begins[s + 1]] where it stands."""

    ARRAYS = {"ids": "<i8", "words": "<u8", "bounds": "<i8", "seeds": "<u8", "begins": "<i8", "held": "<i8", "at": "<i8"}

    def __init__(self, n: int, **arrays: np.ndarray):
        self.n = n
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def of(cls, ids: list[int | None], texts: list[bytes], n: int) -> Items:
        parts, lengths = [np.zeros(0, np.uint64)], []
        for _, bounds, words, _, _ in word_hashes(pa.array(texts, pa.large_binary()), PUNCTUATION):
            parts.append(words)
            lengths.append(np.diff(bounds))
        words = np.concatenate(parts)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths) if lengths else np.zeros(0, np.int64))]).astype(np.int64)
        grams = [shingles(words[i:j], n) if j - i >= n else np.zeros(0, np.uint64) for i, j in zip(bounds[:-1], bounds[1:])]
        every = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        seeds, begins = np.unique(every[order], return_index=True)
        return cls(n, ids=np.array([NO_ID if i is None else i for i in ids], np.int64), words=words, bounds=bounds, seeds=seeds, begins=np.concatenate([begins, [len(every)]]).astype(np.int64), held=owner[order], at=place[order])

    def write(self, folder: str) -> None:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for name, kind in self.ARRAYS.items():
            with fs.open_output_stream(f"{root}/{name}.bin") as f:
                f.write(np.asarray(getattr(self, name), kind).tobytes())

    @classmethod
    def read(cls, folder: str, n: int) -> Items:
        return cls(n, **{name: flat_array(f"{folder}/{name}.bin", kind) for name, kind in cls.ARRAYS.items()})

    def item(self, k: int) -> np.ndarray:
        return self.words[self.bounds[k] : self.bounds[k + 1]]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of grams are seeds: their places in grams and among the seeds."""
        if not len(self.seeds) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == grams)
        return hit, at[hit]


def leaks_of(items: Items, words: np.ndarray, hits: np.ndarray, which: np.ndarray, least: float, min_words: int) -> dict[int, tuple]:
    """Best alignment of every item that has a seed in the text: item -> (score, matches, first word, end word)."""
    windows: dict[int, list[list[int]]] = {}
    for at, seed in zip(hits.tolist(), which.tolist()):
        own_places = slice(int(items.begins[seed]), int(items.begins[seed + 1]))
        for item, place in zip(items.held[own_places].tolist(), items.at[own_places].tolist()):
            m = int(items.bounds[item + 1] - items.bounds[item])
            begin, end = max(0, at - place - m // 2), min(len(words), at - place + m + m // 2 + 1)
            own = windows.setdefault(item, [])
            if own and begin <= own[-1][1]:
                own[-1] = [min(own[-1][0], begin), max(own[-1][1], end)]
            else:
                own.append([begin, end])
    out: dict[int, tuple] = {}
    for item, own in windows.items():
        target = items.item(item)
        need = min(min_words, len(target))
        for begin, end in own:
            for start in range(begin, end, 16 * len(target)):  # a long window in parts that overlap by more than an alignment
                part = words[start : min(end, start + 18 * len(target))]
                if np.isin(target, part).sum() < max(need, least * len(target)):  # not even with all of them in order
                    continue
                score, matches, first, last = align(target, part)
                share = score / (MATCH * len(target))
                if share >= least and matches >= need and (item not in out or share > out[item][0]):
                    out[item] = share, matches, start + first, start + last
    return out


def _index(out: str, n: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
        if ids:
            name = f"{out}/block-{TaskContext.get().taskAttemptId()}"
            Items.of(ids, texts, n).write(name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return index


@lru_cache(maxsize=1)
def _blocks(names: tuple[str, ...], n: int) -> list[Items]:
    return [Items.read(name, n) for name in names]


def _scan(names: tuple[str, ...], n: int, least: float, min_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(names, n)
        for b in batches:
            found: list[list[dict]] = []
            for _, bounds, words, starts, ends in word_hashes(b.column(1), PUNCTUATION):
                grams = shingles(words, n) if len(words) >= n else np.zeros(0, np.uint64)
                rows: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
                for items in blocks:
                    hit, which = items.find(grams)
                    row = np.searchsorted(bounds, hit, "right") - 1
                    whole = hit + n <= bounds[row + 1]
                    hit, which, row = hit[whole], which[whole], row[whole]
                    cuts = np.flatnonzero(np.diff(row, prepend=-1))
                    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)]):
                        k = int(row[i])
                        at = bounds[k]
                        best = leaks_of(items, words[at : bounds[k + 1]], hit[i:j] - at, which[i:j], least, min_words)
                        rows[k] += [{"item_id": None if items.ids[x] == NO_ID else int(items.ids[x]), "score": s, "matches": m, "first_byte": int(starts[at + f]), "end_byte": int(ends[at + e - 1])} for x, (s, m, f, e) in best.items()]
                found += rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _LEAK_ARROW)], names=["row", "leaks"])

    return scan


def leaks_of_rows(docs: DataFrame, items: DataFrame, columns: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, least: float = 0.5, min_words: int = 8, block_chars: int = 16 << 20) -> DataFrame:
    """row (a struct of `columns`; None: all of docs) and leaks; see find_leaks. No name of a column can clash."""
    spark = docs.sparkSession
    ship(spark)
    own = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("binary").alias("t")).where("t is not null")
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    dealt = own.repartition(1 + chars // block_chars, F.xxhash64("i", "t"))
    names = tuple(sorted(r.name for r in dealt.mapInArrow(_index(shared_dir(spark, "items"), n), "name string").collect()))  # one row a block
    rows = docs.select(row_of(docs if columns is None else docs.select(*columns)), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    kind = StructType([rows.schema["row"], *StructType.fromDDL(f"leaks {_LEAK}").fields])
    found = rows.mapInArrow(_scan(names, n, least, min_words), kind)
    return found.withColumn("leaks", F.array_sort("leaks"))


def find_leaks(docs: DataFrame, items: DataFrame, carry: list[str], **options) -> DataFrame:
    """The columns `carry` of docs and leaks: an array of the items that the text holds, with score, matching
    words and the passage's bytes, by item. A carried column called leaks comes back as leaks_carried.

    score is the Smith-Waterman score (2 for equal words, -1 for a different, added or missing one) over
    that of a perfect copy; an item leaks at `least` with at least min_words equal words (all of a shorter
    item). Words are lower-cased and parted at ASCII characters other than letters and digits. A null text
    has no leaks, and neither has an item that is null or has fewer than n words; a passage that shares no n words in
    a row with an item is not aligned with it. Items that repeat are reported each; a document that holds an item twice
    reports the better place, at a tie the first. Null and repeated ids pass through. An empty table on either side
    gives empty arrays. options are those of leaks_of_rows.
    """
    return with_row(leaks_of_rows(docs, items, carry, **options), carry, ["leaks"])
