"""Exact dedup by a log-structured merge index.

1. Each map task collects texts in a memtable. A full memtable is sorted by digest; texts with equal bytes become one entry
   with their number and the identifier that is kept; bodies go to a file of the task's attempt in the shared folder, and
   entries (digest, number, identifier, the body's address) move on. So bodies are never shuffled, and a text held by a third
   of all rows is one entry a memtable.
2. Entries meet by slices of the digest and are merged in its order. A hit, that is another entry with the same digest, counts
   after the bytes of both bodies were compared. The result is a sorted run of level 0 with a Bloom filter for each slice.
3. Runs of a full level are compacted into one of the next: an entry whose digest no other run's filter knows passes
   at once; any other is merged as above. A level has at most FAN runs, so an entry meets few filters and is moved once a level.

The index is a folder with a manifest, body files and the runs as Parquet; batches can be added at any later time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, hot_join, partitions, ship, shared_dir, text_or_empty

#: run: number of the run within its merge (0 within a batch); kind 0: a slice's filter (in bits), 1: an entry.
_ENTRY = "slice int, kind int, run int, digest binary, check binary, keep_id long, copies long, file long, place long, size long, bits binary"
_KINDS = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("run", pa.int32()), ("digest", pa.binary()), ("check", pa.binary()), ("keep_id", pa.int64()), ("copies", pa.int64()), ("file", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])
FILTER_BITS, FILTER_HASHES, FAN = 10, 4, 8


def _words(digests: pa.Array) -> np.ndarray:
    """The first 4 * (FILTER_HASHES + 1) bytes of each digest (short ones filled with zeros) as numbers."""
    n = 4 * (FILTER_HASHES + 1)
    return np.frombuffer(b"".join(d[:n].ljust(n, b"\0") for d in digests.to_pylist()), ">u4").reshape(-1, FILTER_HASHES + 1).astype(np.int64)


class Bloom:
    """A filter of digests; its hashes are words of the digest."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    @classmethod
    def of(cls, words: np.ndarray) -> Bloom:
        bits = np.zeros(max(1, -(-len(words) * FILTER_BITS // 8)), np.uint8)
        at = words[:, 1:].ravel() % (8 * len(bits))
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return cls(bits.tobytes())

    def has(self, words: np.ndarray) -> np.ndarray:
        at = words[:, 1:] % (8 * len(self.bits))
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)


def _best(keys: pa.Array, starts: np.ndarray, keep: str) -> pa.Array:
    """The largest or smallest key of each run of rows that begins at starts; null where all are."""
    known = np.asarray(keys.is_valid())
    pick, none = (np.maximum, -(2**63)) if keep == "largest" else (np.minimum, 2**63 - 1)
    best = pick.reduceat(np.asarray(keys.fill_null(none), np.int64), starts)
    return pa.array(best, pa.int64(), mask=~np.logical_or.reduceat(known, starts))


class Memtable:
    """Rows (key, body, digest, check) until they are flushed as sorted entries."""

    def __init__(self, keep: str):
        self.keep, self.batches, self.size = keep, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        self.size += batch.nbytes

    def entries(self, slices: int, file: int, place: int) -> tuple[pa.RecordBatch, bytes]:
        """Entries in digest order, and their bodies one after another (the first one at `place` of `file`)."""
        rows = pa.Table.from_batches(self.batches).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("digest", "ascending"), ("body", "ascending")])).combine_chunks()
        key, body, digest, check = (rows.column(c).chunk(0) for c in ("key", "body", "digest", "check"))
        same = np.asarray(pc.and_(pc.equal(digest[1:], digest[:-1]), pc.equal(body[1:], body[:-1])), bool)
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        first = pa.array(starts)
        body, digest = body.take(first), digest.take(first)
        sizes = np.asarray(pc.binary_length(body), np.int64)
        words = _words(digest)
        n = len(starts)
        columns = [pa.array(words[:, 0] * slices >> 32, pa.int32()), pa.array(np.ones(n), pa.int32()), pa.array(np.zeros(n), pa.int32()), digest, check.take(first), _best(key, starts, self.keep)]
        columns += [pa.array(np.diff(np.append(starts, len(rows)))), pa.array(np.full(n, file)), pa.array(place + np.cumsum(sizes) - sizes), pa.array(sizes), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, _KINDS)], schema=_KINDS), b"".join(body.to_pylist())


def _flush(out: str, number: int, memtable_bytes: int, slices: int, keep: str):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # attempts are numbered anew in each application, runs in the index
        file, place, stream = number << 36 | TaskContext.get().taskAttemptId(), 0, None
        table = Memtable(keep)

        def flushed() -> pa.RecordBatch:
            nonlocal place, stream
            entries, bodies = table.entries(slices, file, place)
            if stream is None:
                fs, root = filesystem(out)
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{root}/bodies-{file}.bin")
            stream.write(bodies)
            place += len(bodies)
            return entries

        for b in batches:
            if b.num_rows:
                table.add(b)
            if table.size >= memtable_bytes:
                yield flushed()
                table = Memtable(keep)
        if table.batches:
            yield flushed()
        if stream is not None:
            stream.close()

    return runs


class Bodies:
    """Bodies by address, from the shared folder."""

    def __init__(self, out: str):
        self.fs, self.root = filesystem(out)
        self.files: dict[int, object] = {}

    def read(self, file: int, place: int, size: int) -> bytes:
        if not size:
            return b""
        if file not in self.files:
            if len(self.files) >= 200:
                for f in self.files.values():
                    f.close()
                self.files.clear()
            self.files[file] = self.fs.open_input_file(f"{self.root}/bodies-{file}.bin")
        return self.files[file].read_at(size, place)


def _merged(rows: pa.RecordBatch, bodies: Bodies, keep: str) -> pa.RecordBatch:
    """Rows in digest order with one entry for each text: entries with one digest are compared byte by byte."""
    n = rows.num_rows
    digest = rows.column("digest")
    same = np.asarray(pc.equal(digest[1:], digest[:-1]), bool)
    if not same.any():
        return rows
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    sizes = np.diff(np.append(starts, n))
    alone = np.repeat(sizes == 1, sizes)
    out = []
    at = [rows.column(c).to_pylist() for c in ("file", "place", "size")] if len(starts) < 200 else [rows.column(c) for c in ("file", "place", "size")]
    value = (lambda c, i: c[i]) if isinstance(at[0], list) else (lambda c, i: c[i].as_py())
    for i, j in zip(starts[sizes > 1].tolist(), (starts + sizes)[sizes > 1].tolist()):
        texts: list[tuple[bytes, list[int]]] = []
        for k in range(i, j):
            body = bodies.read(*(value(c, k) for c in at))
            held = next((h for text, h in texts if text == body), None)
            if held is None:
                texts.append((body, [k]))
            else:
                held.append(k)
        out += [h for _, h in texts]
    order = np.array([k for h in out for k in h])
    begins = np.cumsum([0, *(len(h) for h in out[:-1])])
    several = rows.take(pa.array(order))
    best = _best(several.column("keep_id"), begins, keep)
    copies = np.add.reduceat(np.asarray(several.column("copies"), np.int64), begins)
    one = several.take(pa.array(begins))
    one = one.set_column(5, _KINDS.field("keep_id"), best).set_column(6, _KINDS.field("copies"), pa.array(copies))
    both = pa.Table.from_batches([rows.filter(pa.array(alone)), one]).combine_chunks()
    return both.take(pc.sort_indices(both, [("digest", "ascending")])).combine_chunks().to_batches()[0]


def _merge(out: str, keep: str):
    """Rows of a slice or several, sorted by (slice, kind, digest): merged entries, then the slice's new filter."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, now, carry = Bodies(out), None, None
        filters: dict[int, Bloom] = {}
        words: list[np.ndarray] = []

        def ready(rows: pa.RecordBatch) -> pa.RecordBatch:
            words.append(_words(rows.column("digest")))
            return rows.set_column(2, _KINDS.field("run"), pa.array(np.zeros(rows.num_rows), pa.int32()))

        def last() -> Iterator[pa.RecordBatch]:
            nonlocal carry
            if carry is not None:
                yield ready(_merged(carry, bodies, keep))
            carry = None
            if words:
                row = {"slice": now, "kind": 0, "run": 0, "bits": Bloom.of(np.concatenate(words)).bits.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_KINDS)
            words.clear()
            filters.clear()

        for whole in batches:
            whole = pa.RecordBatch.from_arrays(whole.columns, schema=_KINDS)
            numbers = np.asarray(whole.column("slice"))
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                if i == j:
                    continue
                if now != numbers[i]:
                    yield from last()
                    now = int(numbers[i])
                b = whole.slice(i, j - i)
                kind = np.asarray(b.column("kind"))
                for run, bits in zip(b.column("run").to_pylist(), b.column("bits").to_pylist()):
                    if bits is None:
                        break  # filters come first
                    filters[run] = Bloom(bits)
                b = b.filter(pa.array(kind == 1))
                if filters and b.num_rows:
                    mine, w = np.asarray(b.column("run")), _words(b.column("digest"))
                    known = np.zeros(b.num_rows, bool)
                    for run, f in filters.items():
                        known |= f.has(w) & (mine != run)
                    if not known.all():
                        yield ready(b.filter(pa.array(~known)))
                        b = b.filter(pa.array(known))
                if not b.num_rows:
                    continue
                rows = b if carry is None else pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
                rows = _merged(rows, bodies, keep)
                digest = rows.column("digest")
                end = int(np.asarray(pc.not_equal(digest, digest[-1])).sum())  # the last digest may go on in the next batch
                carry = rows.slice(end)
                if end:
                    yield ready(rows.slice(0, end))
        yield from last()

    return merge


class DedupIndex:
    """An index in a folder that all nodes reach. keep: whether of equal texts the smallest or the largest id stays."""

    def __init__(self, spark: SparkSession, folder: str, keep: str = "smallest", memtable_bytes: int = 32 << 20):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep is smallest or largest, not {keep}")
        self.spark, self.folder, self.memtable_bytes = spark, folder, memtable_bytes
        fs, root = filesystem(folder)
        name = f"{root}/manifest.json"
        if fs.get_file_info(name).is_file:
            with fs.open_input_stream(name) as f:
                self.state = json.loads(f.read())
            if self.state["keep"] != keep:
                raise ValueError(f"the index keeps the {self.state['keep']} ids")
        else:
            self.state = {"keep": keep, "slices": partitions(spark), "next": 0, "levels": []}
        ship(spark)

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(f"{self.folder}/{name}")

    def _write(self, rows: DataFrame, level: int) -> None:
        """Merge rows into a new run of the level."""
        name = f"run-{self.state['next']:06d}"
        self.state["next"] += 1
        dealt = rows.repartitionById(self.state["slices"], F.col("slice")).sortWithinPartitions("slice", "kind", "digest", "run")
        dealt.mapInArrow(_merge(self.folder, self.state["keep"]), _ENTRY).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        while len(self.state["levels"]) <= level:
            self.state["levels"].append([])
        self.state["levels"][level].append(name)

    def _numbered(self, names: list[str]) -> DataFrame:
        rows = None
        for k, name in enumerate(names):
            run = self._run(name).withColumn("run", F.lit(k))
            rows = run if rows is None else rows.unionByName(run)
        return rows

    def _save(self) -> None:
        fs, root = filesystem(self.folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/manifest.json"
        with fs.open_output_stream(f"{name}.new") as f:
            f.write(json.dumps(self.state).encode())
        if fs.get_file_info(name).is_file:
            fs.delete_file(name)
        fs.move(f"{name}.new", name)

    def add(self, texts: DataFrame) -> None:
        """Add rows (key, body, digest, check) as a run; full levels are compacted."""
        flushed = texts.select("key", "body", "digest", "check").mapInArrow(_flush(self.folder, self.state["next"], self.memtable_bytes, self.state["slices"], self.state["keep"]), _ENTRY)
        self._write(flushed, 0)
        level, gone = 0, []
        while len(self.state["levels"][level]) >= FAN:
            names = self.state["levels"][level]
            self._write(self._numbered(names), level + 1)
            self.state["levels"][level] = []
            gone += names
            level += 1
        self._save()
        fs, root = filesystem(self.folder)
        for name in gone:  # nothing names them any more
            fs.delete_dir(f"{root}/{name}")

    def entries(self) -> DataFrame:
        """(digest, check, keep_id, copies) of every different text."""
        names = [n for level in self.state["levels"] for n in level]
        if not names:
            return self.spark.createDataFrame([], _ENTRY).select("digest", "check", "keep_id", "copies")
        rows = self._numbered(names)
        if len(names) > 1:
            dealt = rows.repartitionById(self.state["slices"], F.col("slice")).sortWithinPartitions("slice", "kind", "digest", "run")
            rows = dealt.mapInArrow(_merge(self.folder, self.state["keep"]), _ENTRY)
        return rows.where("kind = 1").select("digest", "check", "keep_id", "copies")


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """(key, body, digest, check, sha) of each row, as an index takes them."""
    body = text_or_empty(text_col)
    sha = F.unhex(F.sha2(body, 256))
    own = docs.select(F.col(id_col).cast("long").alias("key"), body.cast("binary").alias("body"), sha.alias("sha"))
    return own.select("key", "body", F.substring("sha", 1, digest_bytes).alias("digest"), (F.substring("sha", 17, 16) if digest_bytes == 32 else F.col("sha")).alias("check"), "sha")


def told(rows: DataFrame, index: DedupIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of rows of `members` that the index holds."""
    # a row whose text is alone needs nothing from the index
    classes = index.entries().where("copies > 1").withColumn("both", F.concat("digest", "check")).drop("digest", "check")
    own = rows.select("key", F.concat("digest", "check").alias("both"), "sha")
    found = hot_join(own, classes, "both", "copies")
    keep_id = F.when(F.col("copies").isNull(), F.col("key")).otherwise(F.col("keep_id"))
    return found.select(F.col("key").alias("doc_id"), keep_id.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), F.col("key").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_bytes: int = 32 << 20, digest_bytes: int = 32) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, by an index of docs alone.

    Texts are equal when their UTF-8 bytes are; a null text is an empty one. Of equal texts the row with
    the smallest (or largest) id stays. Null ids count in group_size but stay only where all ids of the
    group are null. Rows that repeat an id and its text are reported alike. An empty table gives no
    rows; columns besides the two are ignored. digest_bytes shortens the index's digest (for tests);
    bytes are compared, so results don't change.
    """
    spark = docs.sparkSession
    index = DedupIndex(spark, shared_dir(spark, "dedup-index"), keep, memtable_bytes)
    rows = members(docs, id_col, text_col, digest_bytes)
    index.add(rows)
    return told(rows, index)
