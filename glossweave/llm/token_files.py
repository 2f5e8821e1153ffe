"""Token-ID output: flat unsigned integer files with 64-bit offsets, read by memory mapping.

A part is three flat little-endian files: .bin (the ids, 16 or 32 bits), .off (uint64, where each document
starts within the part, and the part's end) and .doc (int64 ids of documents). Parts are ranges of ascending document
ids; manifest.json has each part's name, its counts (`nulls`: so many documents at its beginning have no id) and its
base, the prefix sum of the ids in all parts before it. A name has its task's attempt in it, and only attempts that
succeeded are in the manifest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import filesystem, flat_array, partitions, ship, text_or_empty

_PART = "part int, name string, docs long, nulls long, ids long"
_ROW = "doc_id long, start long, n_tokens long, ids binary"
#: Matches remembered by a worker; the memory is emptied when it is full.
MEMO = 600_000


class Ids:
    """Ids of texts by a tokenizers file.

    For plain byte-level files a match of the splitting pattern always has the same ids, so a worker finds the
    matches of many texts at once by array operations, has Arrow number the different ones, has the file's BPE model
    encode each of those once and remembers it. Other files encode whole texts.
    """

    _LETTERS = pretokens.byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_match = not kind.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and kind["model"].get("dropout") is None and all(a["special"] for a in kind.get("added_tokens") or ())
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}  # match -> its number
        self.ids, self.begins = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # all matches' ids, and where each one's begin

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's number of them."""
        if not self.by_match or not texts:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths
        pieces, owner = [], []
        for k, t in enumerate(texts):
            own = [t] if len(t) <= pretokens.PIECE else list(pretokens.safe_pieces(t, pretokens.PIECE))
            pieces += own
            owner += [k] * len(own)
        matches, indices, until = pretokens.matches_of(pieces)
        numbers = self._numbers(matches)[indices]
        lengths = self.begins[numbers + 1] - self.begins[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.begins[numbers] - (ends - lengths), lengths)]
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, owner, np.diff(np.concatenate([[0], ends])[until]))
        return ids, counts

    def _numbers(self, matches: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO or len(self.ids) > 8 * MEMO:
            self._forget()
        memo, tokenize, letters = self.memo, self.tokenizer.model.tokenize, self._LETTERS
        out = np.fromiter(map(memo.get, matches, repeat(-1)), np.int64, len(matches))
        missed = np.flatnonzero(out < 0)
        if len(missed):
            new = [matches[k] for k in missed.tolist()]
            found = [[x.id for x in tokenize(m.decode("latin-1").translate(letters))] for m in new]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            out[missed] = np.arange(len(memo), len(memo) + len(new))
            memo.update(zip(new, range(len(memo), len(memo) + len(new))))
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])
        return out


@lru_cache(maxsize=2)
def tokenizer_ids(path: str) -> Ids:
    return Ids(path)


def _writer(out: str, tokenizer: str, end_id: int | None, dtype: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, root = filesystem(out)
        of, docs, lengths, nulls, stream = tokenizer_ids(tokenizer).of, [], [], 0, None
        for b in batches:
            for part in pretokens.slices(b):
                ids, counts = of(part.column(1).to_pylist())
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                nulls += part.column(0).null_count
                docs.append(np.asarray(part.column(0).fill_null(0), "<i8"))
                lengths.append(counts.astype("<u8"))
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{root}/{name}.bin")
                stream.write(ids.astype(dtype).tobytes())
        if stream is None:
            return
        stream.close()
        offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.concatenate(lengths), dtype="<u8")])
        for kind, data in (("off", offsets), ("doc", np.concatenate(docs))):
            with fs.open_output_stream(f"{root}/{name}.{kind}") as f:
                f.write(data.tobytes())
        columns = zip((task.partitionId(), name, len(offsets) - 1, nulls, int(offsets[-1])), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=["part", "name", "docs", "nulls", "ids"])

    return write


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every text, append end_id, and write the ids in ascending order of document ids; returns the manifest.

    out is a URI that all nodes reach. A null text is empty; rows with a null id come first; rows with equal ids
    stand in the order of their texts' hashes. An empty table gives a manifest without parts. Ids take 16 bits where the
    vocabulary allows, else 32. A task that is run again writes files of another name; those that the manifest doesn't
    name are deleted when all tasks are done.
    """
    spark = docs.sparkSession
    ship(spark)
    dtype = "<u2" if max(tokenizer_ids(tokenizer).size, (end_id or 0) + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("key"), text_or_empty(text_col).alias("body")).withColumn("tie", F.xxhash64("body"))
    ordered = rows.repartitionByRange(partitions(spark), "key", "tie").sortWithinPartitions("key", "tie").select("key", "body")
    parts, base = [], 0
    for r in sorted(ordered.mapInArrow(_writer(out, tokenizer, end_id, dtype), _PART).collect()):  # one row a part
        parts.append({"name": r.name, "docs": r.docs, "nulls": r.nulls, "ids": r.ids, "base": base})
        base += r.ids
    fs, root = filesystem(out)
    named = {f"{p['name']}.{kind}" for p in parts for kind in ("bin", "off", "doc")}
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith("part-") and f.base_name not in named:
            fs.delete_file(f.path)
    manifest = {"dtype": dtype, "tokenizer": tokenizer, "end_id": end_id, "ids": base, "parts": parts}
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _reader(out: str, dtype: str, batch_ids: int = 1 << 21):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, nulls, base in zip(*(b.column(k).to_pylist() for k in range(3))):
                ids, offsets, docs = (flat_array(f"{out}/{name}.{kind}", t) for kind, t in (("bin", dtype), ("off", "<u8"), ("doc", "<i8")))
                offsets = offsets.astype(np.int64)
                at = 0
                while at < len(docs):
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + batch_ids, "right")) - 1)
                    to = min(to, len(docs), at + 5000)
                    raw = [np.asarray(ids[offsets[k] : offsets[k + 1]]).astype("<u4").tobytes() for k in range(at, to)]
                    keys = pa.array(docs[at:to], pa.int64(), mask=np.arange(at, to) < nulls)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(base + offsets[at:to]), pa.array(np.diff(offsets[at : to + 1])), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at = to

    return read


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: start counts the ids of all documents before it; ids
    are little-endian unsigned 32-bit integers in one binary value, whatever the files' width."""
    ship(spark)
    fs, path = filesystem(f"{out}/manifest.json")
    with fs.open_input_file(path) as f:
        manifest = json.loads(f.read())
    parts = spark.createDataFrame([(p["name"], p["nulls"], p["base"]) for p in manifest["parts"]], "name string, nulls long, base long")
    return parts.repartition(max(1, len(manifest["parts"]))).mapInArrow(_reader(out, manifest["dtype"]), _ROW)
