"""N-gram Jaccard join by count-vector R-trees.

1. Each task hashes the distinct shingles of its texts and writes the sorted sets to a flat file of its attempt in
   the shared folder; a set's address names that file and the place in it. Equal sets become one representative.
2. Shingles have one global order: rare ones by hash, then those that a bounded sample of sets shows to
   be frequent. Two sets that are similar enough share one of the first shingles in this order (of n
   shingles, n less the overlap that a partner needs, plus one). Sets that share such a shingle form a block.
   A shingle of very many sets is dealt over several tasks, and blocks above a bound are cut into chunks.
3. Every member of a large block is compared with the block's first one. This puts nearly all of a group of near copies
   into one class, and chunks of one class need no further search.
4. In the other blocks, tokens are hashed into groups, and the counts of a set's tokens in the groups are its point.
   A search of the R-tree of these points bounds overlap by the sum of the coordinates' minima, against
   node corners first. Surviving pairs of different classes are verified on the sets. The units of this work are
   small blocks and pairs of chunks, dealt over tasks by their members, whatever group they belong to.
5. Links become components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, hot_join, partitions, ship, shared_dir, text_or_empty, written
from .components import connected_components
from .words import shingles, word_hashes

_U = np.uint64
_SET = "key long, sha binary, n long, digest binary, gid long"
#: A set's address: the number of the attempt that wrote it, and its place in that file (in 8 bytes).
_PLACE_BITS = 36
_MOST_ATTEMPTS = 1 << 63 - _PLACE_BITS


def _store(out: str, k: int):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        if attempt >= _MOST_ATTEMPTS:
            raise ValueError("too many task attempts in one application for the addresses of sets")
        stream, place, known = None, 0, {}
        for b in batches:
            for row, bounds, words, _, _ in word_hashes(b.column(2)):
                count = len(bounds) - 1
                sizes, digests, gids, raw = np.zeros(count, np.int64), [], [], []
                for i in range(count):
                    own = np.unique(shingles(words[bounds[i] : bounds[i + 1]], k)).astype("<u8")
                    sizes[i] = len(own)
                    data = own.tobytes()
                    digest = hashlib.blake2b(data, digest_size=16).digest()
                    if digest not in known:  # equal sets of a task are stored once
                        if len(known) > 1_000_000:
                            known.clear()
                        known[digest] = attempt << _PLACE_BITS | place
                        raw += [len(own).to_bytes(8, "little"), data]
                        place += 1 + len(own)
                    digests.append(digest)
                    gids.append(known[digest])
                if stream is None:
                    fs, root = filesystem(out)
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{root}/sets-{attempt}.bin")
                stream.write(b"".join(raw))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, count), b.column(1).slice(row, count), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(gids, pa.int64())], names=["key", "sha", "n", "digest", "gid"])
        if stream is not None:
            stream.close()

    return store


class Sets:
    """Sorted sets by address, from the shared folder: mapped where it is mounted, else read by place, never whole files."""

    FIRST_READ = 8192

    def __init__(self, out: str):
        self.fs, self.root = filesystem(out)
        self.files: dict[int, object] = {}

    def __getitem__(self, gid: int) -> np.ndarray:
        number, at = gid >> _PLACE_BITS, gid & (1 << _PLACE_BITS) - 1
        file = self.files.get(number)
        if file is None:
            if len(self.files) >= 500:
                self.files.clear()
            path = f"{self.root}/sets-{number}.bin"
            file = self.files[number] = np.memmap(path, "<u8", "r") if self.fs.type_name == "local" else self.fs.open_input_file(path)
        if isinstance(file, np.memmap):
            return np.asarray(file[at + 1 : at + 1 + int(file[at])])
        raw = file.read_at(self.FIRST_READ, 8 * at)
        n = int.from_bytes(raw[:8], "little")
        if len(raw) < 8 + 8 * n:
            raw += file.read_at(8 + 8 * n - len(raw), 8 * at + len(raw))
        return np.frombuffer(raw, "<u8", n, 8)


def _frequent(out: str, least: int, most: int, tokens: int):
    """Write the shingles in at least `least` of the given sets to a file, the `most` most frequent of them, and their
    counts to another. Sets beyond a sum of `tokens` shingles are left out of this sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, found, size = Sets(out), [], 0
        for g in (g for b in batches for g in b.column(0).to_pylist()):
            if size < tokens:
                found.append(sets[g])
                size += len(found[-1])
        values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, _U), np.zeros(0, np.int64))
        often = np.argsort(-counts, kind="stable")[:most]
        often = np.sort(often[counts[often] >= least])  # values are sorted, so places are
        name = f"frequent-{TaskContext.get().taskAttemptId()}"
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)  # there may be no sets at all
        for kind, data in (("values", values[often].astype("<u8")), ("shares", (counts[often] / max(1, len(found))).astype("<f8"))):
            with fs.open_output_stream(f"{root}/{name}.{kind}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(often)], pa.int64())], names=["name", "found"])

    return count


def _read(out: str, name: str, dtype: str) -> np.ndarray:
    fs, root = filesystem(out)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def _prefixes(out: str, frequent: str | None, total: int, part: int, percent: int):
    """(token, deal, gid) of each set's first shingles. A shingle that the sample expects in more than `part` of the
    `total` sets is dealt into parts 1, 2, ... by the set; others are part 0."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(out)
        late, shares = (_read(out, f"{frequent}.values", "<u8"), _read(out, f"{frequent}.shares", "<f8")) if frequent else (np.zeros(0, _U), np.zeros(0))
        parts = np.maximum(1, np.ceil(shares * total / part)).astype(np.int64)
        for b in batches:
            tokens, owners, deals, held = [], [], [], 0

            def ready() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(deals).astype(np.int32)), pa.array(np.concatenate(owners))], names=["token", "deal", "gid"])

            for g in b.column(0).to_pylist():
                own = sets[g]
                n = len(own)
                size = n - -(-n * percent // 100) + 1
                deal = np.zeros(size, np.int64)
                if len(late):
                    at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                    is_late = late[at] == own
                    rare = own[~is_late]
                    own = np.concatenate([rare, own[is_late]])
                    if size > len(rare):
                        own_parts = parts[at[is_late][: size - len(rare)]]
                        deal[len(rare) :] = np.where(own_parts > 1, 1 + (g * 0x9E3779B97F4A7C15 >> 40 & 0xFFFFFF) % own_parts, 0)
                tokens.append(own[:size])
                deals.append(deal)
                owners.append(np.full(size, g, np.int64))
                held += size
                if held > 100_000:
                    yield ready()
                    tokens, owners, deals, held = [], [], [], 0
            if tokens:
                yield ready()

    return emit


_BLOCK = "token long, deal int, chunk int, whole boolean, size int, members binary"


def _blocks(chunk: int):
    """Runs of equal (token, deal) in sorted rows: sets of two or more members, in chunks where there are many. A dealt
    token's runs, and those in chunks, are not whole: their members may have partners in another row."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, number, told, out = None, [], 0, set(), []

        def close(last: bool) -> None:
            nonlocal held, number
            gids = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            while len(gids) > chunk or last and (len(gids) > 1 or (number or token[1]) and len(gids)):
                part, gids = gids[:chunk], gids[chunk:]
                data = part.astype("<i8").tobytes()
                whole = last and number == 0 and not len(gids) and token[1] == 0
                digest = hashlib.blake2b(data, digest_size=12).digest()
                if not whole or digest not in told:  # many tokens of near copies have the same owners
                    if len(told) > 200_000:
                        told.clear()
                    if whole:
                        told.add(digest)
                    out.append((token[0], token[1], number, whole, len(part), data))
                number += 1
            held = [gids] if len(gids) and not last else []

        def ready() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            b = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["token", "deal", "chunk", "whole", "size", "members"])
            out.clear()
            return b

        for b in batches:
            tokens, deals, gids = (b.column(k).to_numpy() for k in range(3))
            if not len(tokens):
                continue
            cuts = np.flatnonzero((tokens[1:] != tokens[:-1]) | (deals[1:] != deals[:-1])) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(tokens)]])
            many = (ends - begins > 1) | (begins == 0) | (ends == len(tokens)) | (deals[begins] > 0)
            for i, j in zip(begins[many].tolist(), ends[many].tolist()):
                own = (int(tokens[i]), int(deals[i]))
                if token is not None and own != token:
                    close(True)
                    held, number = [], 0
                token = own
                held.append(gids[i:j])
                if sum(map(len, held)) > 4 * chunk:
                    close(False)
                if len(out) >= 2000 or sum(len(r[5]) for r in out[-64:]) > 1 << 20:
                    yield ready()
        if token is not None:
            close(True)
        yield ready()

    return group


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block's first member and each other one."""
    for b in batches:
        for members in b.column(0).to_pylist():
            gids = np.frombuffer(members, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gids) - 1, gids[0])), pa.array(gids[1:])], names=["a", "b"])


def _verify(out: str, percent: int):
    """The pairs (sorted by a) that are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, first, left = Sets(out), None, None
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if x != first:
                    first, left = x, sets[x]
                good[k] = similar(left, sets[y], percent)
            yield b.filter(pa.array(good))

    return verify


_MEMBER = "token long, deal int, chunk int, whole boolean, gid long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, members in enumerate(b.column(4).to_pylist()):
            gids = np.frombuffer(members, "<i8")
            again = pa.array(np.full(len(gids), k))
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in b.columns[:4]), pa.array(gids)], names=["token", "deal", "chunk", "whole", "gid"])


_CHUNK = "token long, whole boolean, number string, class long, members binary, roots binary"


def _by_class(pure: int):
    """Chunks again, from rows sorted by (token, deal, chunk, root): a class with at least `pure` members in the chunk is a row of
    its own, the others make one row without a class. Whole blocks stay one row, or none if they are of one class."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gids, roots, out = None, [], [], []

        def close() -> None:
            g, r = np.concatenate(gids), np.concatenate(roots)
            rest = np.ones(len(g), bool)
            name = f"{now[1]}-{now[2]}"
            if now[3] and r[0] == r[-1]:
                return
            if not now[3]:
                cuts = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]])
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if j - i >= pure:
                        rest[i:j] = False
                        out.append((now[0], False, name, int(r[i]), g[i:j].tobytes(), r[i:j].tobytes()))
            if rest.any():
                out.append((now[0], now[3], name, None, g[rest].tobytes(), r[rest].tobytes()))

        def ready() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            b = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["token", "whole", "number", "class", "members", "roots"])
            out.clear()
            return b

        for b in batches:
            keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            g, r = b.column(4).to_numpy(), b.column(5).to_numpy()
            if not len(g):
                continue
            changed = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])
            cuts = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(g)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = tuple(x[i].item() for x in keys)
                if now is not None and own != now:
                    close()
                    gids, roots = [], []
                now = own
                gids.append(g[i:j])
                roots.append(r[i:j])
                if len(out) >= 100:
                    yield ready()
        if now is not None:
            close()
        yield ready()

    return group


class CountRTree:
    """A bulk-loaded R-tree over count vectors; a node keeps the upper corner and the range of sizes below it.

    Corners of zero would bound nothing: overlap is bounded by minima against upper corners alone.
    """

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*(points[:, j] for j in range(min(3, points.shape[1]))), sizes))  # by size first: sizes prune most
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels, corner, low, high = [], self.points, self.sizes, self.sizes
        while len(corner) > self.FAN:
            at = np.arange(0, len(corner), self.FAN)
            corner, low, high = np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((corner, low, high))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of the points whose bound lets the Jaccard similarity reach percent."""
        below = None
        for corner, low, high in [*reversed(self.levels), (self.points, self.sizes, self.sizes)]:
            at = np.arange(len(corner)) if below is None else below[below < len(corner)]
            at = at[(100 * size >= percent * low[at]) & (100 * high[at] >= percent * size)]
            bound = np.minimum(corner[at], point).sum(1, dtype=np.int64)
            at = at[(100 + percent) * bound >= percent * (size + low[at])]
            below = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        return self.order[at]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


class Classes:
    """Union-find."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _points(found: list[np.ndarray]) -> np.ndarray:
    """Counts of each set's tokens by group; as many groups as keep about two tokens of the largest set in each."""
    groups = 16
    while groups < 512 and groups * 2 < max(map(len, found)):
        groups *= 2
    shift = _U(64 - (groups.bit_length() - 1))
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    at = np.repeat(np.arange(len(found)), lengths) * groups + (np.concatenate(found) >> shift).astype(np.int64)
    return np.bincount(at, minlength=len(found) * groups).reshape(len(found), groups).astype(np.uint16 if lengths.max() < 1 << 16 else np.uint32)


def _search(out: str, percent: int):
    """Links between members of different classes, for units (left, left's roots, right, right's roots); without a
    right side the left one's members are searched among themselves."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, classes, failed = Sets(out), Classes(), set()
        for b in batches:
            links: list[tuple[int, int]] = []
            for sides in zip(*(b.column(k).to_pylist() for k in range(4))):
                if len(classes.up) > 1_000_000:
                    classes = Classes()
                mine, my_roots, other, other_roots = (None if x is None else np.frombuffer(x, "<i8").tolist() for x in sides)
                left, right = mine, other or []
                everyone = left + right
                for g, root in zip(everyone, (my_roots or left) + (other_roots or right)):
                    if classes.find(g) != classes.find(root):
                        classes.join(g, root)
                if len({classes.find(g) for g in everyone}) == 1:
                    continue
                found = [sets[g] for g in everyone]
                points = _points(found)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                tree = CountRTree(points[: len(left)], sizes[: len(left)])
                for q in range(len(left), len(everyone)) if right else range(1, len(left)):
                    root = classes.find(everyone[q])
                    for c in tree.search(points[q], int(sizes[q]), percent).tolist():
                        pair = (everyone[c], everyone[q]) if everyone[c] < everyone[q] else (everyone[q], everyone[c])
                        if not right and c >= q or classes.find(everyone[c]) == root or pair in failed:
                            continue
                        if similar(found[c], found[q], percent):
                            classes.join(*pair)
                            root = classes.find(everyone[q])
                            links.append(pair)
                        else:
                            if len(failed) > 200_000:
                                failed.clear()
                            failed.add(pair)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return search


def _units(large: DataFrame, classes: DataFrame, chunk: int) -> DataFrame:
    """The work that large blocks leave when the classes of their stars are known."""
    n = partitions(large.sparkSession)
    members = large.select("token", "deal", "chunk", "whole", "members").mapInArrow(_members, _MEMBER)
    rooted = members.join(classes.select(F.col("node").alias("gid"), "component"), "gid", "left").select("token", "deal", "chunk", "whole", "gid", F.coalesce("component", "gid").alias("root"))
    dealt = rooted.repartition(n, "token", "deal", "chunk").sortWithinPartitions("token", "deal", "chunk", "root", "gid")
    parts = written(dealt.mapInArrow(_by_class(max(2, chunk // 16)), _CHUNK), "chunks")
    whole = parts.where("whole").select("members", "roots", F.lit(None).cast("binary").alias("others"), F.lit(None).cast("binary").alias("others_roots"))
    rest, pure = parts.where("not whole and class is null"), parts.where("class is not null")
    several = pure.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("token")
    mixed = pure.join(several, "token", "left_semi")

    def pairs(a: DataFrame, b: DataFrame, when: str) -> DataFrame:
        b = b.select("token", F.col("number").alias("number2"), F.col("class").alias("class2"), F.col("members").alias("others"), F.col("roots").alias("others_roots"))
        return a.join(b, "token").where(when).select("members", "roots", F.when(F.col("number") != F.col("number2"), F.col("others")).alias("others"), F.when(F.col("number") != F.col("number2"), F.col("others_roots")).alias("others_roots"))

    crossed = rest.select("token", "number", "class", "members", "roots")
    apart = pairs(crossed.withColumn("number", F.concat("number", F.lit("r"))), pure, "true")
    return whole.unionByName(pairs(crossed, rest, "number <= number2")).unionByName(apart).unionByName(pairs(mixed.withColumn("number", F.concat("number", F.lit("m"))), mixed, "class < class2"))


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, sample_sets: int, sample_shingles: int, sample_least: int, frequent_most: int, chunk: int, star: int, part: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): of each row of docs key, sha (of its text), n, digest (of its set); of each different set that is
    not empty digest, gid, class, copies and the least (key is null, key, sha) of the sets' rows."""
    spark = docs.sparkSession
    ship(spark)
    out, n = shared_dir(spark, "sets"), partitions(spark)
    body = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.unhex(F.sha2(body, 256)).alias("sha"), body.cast("binary").alias("body"))
    rows = written(texts.mapInArrow(_store(out, k), _SET), "set-rows")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "sha")).alias("first")
    reps = written(rows.where("n > 0").groupBy("digest").agg(first, F.min("gid").alias("gid"), F.count("*").alias("copies")), "set-reps")
    sample = reps.orderBy("digest").limit(sample_sets).select("gid").coalesce(1)
    found = sample.mapInArrow(_frequent(out, sample_least, frequent_most, sample_shingles), "name string, found long").collect()  # one row
    late = found[0].name if found and found[0].found else None
    by_file = reps.select("gid").repartition(n, F.expr(f"shiftright(gid, {_PLACE_BITS})")).sortWithinPartitions("gid")
    tokens = by_file.mapInArrow(_prefixes(out, late, reps.count(), part, percent), "token long, deal int, gid long")
    tokens = tokens.repartition(n, "token", "deal").sortWithinPartitions("token", "deal", "gid")
    blocks = written(tokens.mapInArrow(_blocks(chunk), _BLOCK), "blocks")
    small, large = blocks.where(f"whole and size < {star}"), blocks.where(f"not whole or size >= {star}")
    stars = large.where("size > 1").select("members").mapInArrow(_stars, "a long, b long").distinct().repartition(n, "a", "b").sortWithinPartitions("a", "b")
    near = connected_components(written(stars.mapInArrow(_verify(out, percent), "a long, b long"), "star-links"))
    none = F.lit(None).cast("binary")
    units = small.select("members", none.alias("roots"), none.alias("others"), none.alias("others_roots")).unionByName(_units(large, near, chunk))
    spread = units.groupBy(F.xxhash64("members", "roots", "others").alias("unit"), F.md5("members").alias("left"), F.md5(F.coalesce("others", F.lit(b""))).alias("right")).agg(*(F.first(c).alias(c) for c in ("members", "roots", "others", "others_roots")))
    spread = spread.repartition(n, "unit")  # by a number: adaptive execution leaves as many tasks
    links = written(spread.select("members", "roots", "others", "others_roots").mapInArrow(_search(out, percent), "a long, b long"), "links")
    edges = near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    member = connected_components(edges)
    named = reps.join(member.select(F.col("node").alias("gid"), "component"), "gid", "left")
    return rows, named.select("digest", "gid", F.coalesce("component", "gid").alias("class"), "copies", "first")


def _firsts(classes: DataFrame) -> DataFrame:
    """classes with `least`: the least (key is null, key, sha) of the whole class."""
    least = classes.groupBy("class").agg(F.min("first").alias("least"), F.count("*").alias("size"))
    return hot_join(classes, least, "class", "size").select("digest", "copies", "least")


_DEFAULTS = {"k": 5, "percent": 75, "sample_sets": 20_000, "sample_shingles": 1 << 22, "sample_least": 3, "frequent_most": 1 << 20, "chunk": 1024, "star": 16, "part": 1 << 20}


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, text_sha256, first (whether it is the component's first row).

    Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased. A set has the distinct
    k-word shingles; the whole sequence if there are fewer words; nothing without words or text. Sets
    link when 100 * intersection >= percent * union; component_id is the smallest id reachable by links.
    Empty sets link with nothing. Rows with a null id link like others; their component_id is null only if no row of the
    component has an id. Rows that share an id are linked each by its own text. The first row of a component has
    its smallest id (null only if all are), at a tie the smallest digest of the text; rows that repeat an id and a text
    are first alike. An empty table gives no rows; other columns are ignored.

    All pairs above the threshold are found: the sample (at most sample_sets sets, sample_shingles shingles of theirs,
    and frequent_most frequent ones) only settles the order of shingles, on which the result does not depend; neither
    does it on chunk (members that are searched at once), star (the least size of a block whose members meet its
    first one before) and part (rows of one shingle in a task).
    """
    rows, classes = _classes(docs, id_col, text_col, **(_DEFAULTS | options))
    joined = hot_join(rows.select("key", "sha", "n", "digest"), _firsts(classes), "digest", "copies")
    own = F.struct(F.col("key").isNull().alias("none"), "key", "sha")
    least = F.when(F.col("n") > 0, F.col("least.key")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), least.alias("component_id"), F.lower(F.hex("sha")).alias("text_sha256"), ((F.col("n") == 0) | (F.col("least") == own)).alias("first"))
