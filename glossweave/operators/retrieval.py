"""Similarity and retrieval over vector tables (id, vec array<double>).

Products are blocked: tables are cut into blocks of rows, two blocks meet as matrices in one worker, and only the k
best, counts or wanted places travel. No pairs of rows are listed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.sources.shared import ship, written

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def normalized(df: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """vec divided by its length; done once a row, so joins only multiply."""
    return df.withColumn("__len", norm(F.col("vec")) + epsilon).withColumn("vec", F.transform("vec", lambda x: x / F.col("__len"))).drop("__len")


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """(block, ids, vecs): normalized rows (id, vec) in blocks of about `rows`, by a hash of the id, vectors one behind the other; written, so that
    blocks that meet are read and not shuffled."""
    n = max(1, -(-df.count() // rows))
    own = normalized(df).select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.struct("id", "vec").alias("row"))
    files = min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = own.repartition(files, "block").groupBy("block").agg(F.collect_list("row").alias("rows"))
    return written(held.select("block", F.col("rows.id").alias("ids"), F.flatten("rows.vec").alias("vecs")), "blocks")


def _matrix(ids, vecs) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(ids, np.int64), np.asarray(vecs, np.float64).reshape(len(ids), -1)


#: Queries that a task holds at once (64 components: 64 MB), and products that it looks at at once.
HELD, AT_ONCE = 1 << 17, 1 << 21


def top_k(queries: DataFrame, gallery: DataFrame, k: int, block_rows: int = 2000, held: int = HELD) -> DataFrame:
    """(q, g, sim, place): the k most similar gallery rows of each query, at a tie (to 1e-12) the smaller id.

    Queries and gallery are dealt into groups by a hash of the id, and each group of queries meets each group of the gallery in a cell of its own. Rows
    travel one by one, so no row, page or batch is large. A task holds the queries of a cell (at most about `held`) with their k best, and the gallery
    passes by; of each cell only k rows a query travel on.
    """
    a, b = (written(normalized(df).where("vec is not null").select("id", "vec"), "unit-vectors") for df in (queries, gallery))
    n_a, n_b, wanted = a.count(), b.count(), math.ceil(math.sqrt(3 * a.sparkSession.sparkContext.defaultParallelism))
    m, n = (max(1, -(-x // held), min(wanted, -(-x // max(1, block_rows // 4)))) for x in (n_a, n_b))
    ship(a.sparkSession)
    own = lambda x: F.pmod(F.xxhash64("id"), F.lit(x)).cast("int")
    left = a.select("id", "vec", own(m).alias("group")).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"), "id", "vec", "group")
    right = b.select("id", "vec", own(n).alias("group")).select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("other"), "id", "vec", "group")
    rows = left.select((F.col("group") * n + F.col("other")).alias("cell"), F.lit(0).alias("side"), "id", "vec").unionAll(right.select((F.col("other") * n + F.col("group")).alias("cell"), F.lit(1).alias("side"), "id", "vec"))
    dealt = rows.repartitionById(m * n, "cell").sortWithinPartitions("cell", "side")
    partial = dealt.mapInArrow(lambda batches: _cells(batches, k), "q long, g long, sim double")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "g")
    return partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


class _Nearest:
    """The k best of each query over all gallery rows that it has met."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.g, self.sim = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)

    def meet(self, g: np.ndarray, vecs: np.ndarray) -> None:
        step = max(1, AT_ONCE // max(1, len(g)))
        for s in range(0, len(self.ids), step):
            sims = self.vecs[s : s + step] @ vecs.T
            worst, worst_g = self.sim[s : s + step, -1], self.g[s : s + step, -1]
            bound = worst - 2e-12  # sums are told apart to 1e-12
            if len(g) > self.k and np.isinf(worst).any():
                bound = np.maximum(bound, np.partition(sims, len(g) - self.k, axis=1)[:, len(g) - self.k] - 2e-12)
            row, col = np.nonzero(sims >= bound[:, None])
            sim, found = np.round(sims[row, col], 12), g[col]
            better = (sim > worst[row]) | (sim == worst[row]) & (found < worst_g[row])
            row, sim, found = row[better], sim[better], found[better]
            if len(row):
                self._take(s, row, sim, found)

    def _take(self, s: int, row: np.ndarray, sim: np.ndarray, found: np.ndarray) -> None:
        touched = np.unique(row)
        row, sim, found = np.concatenate([np.repeat(touched, self.k), row]), np.concatenate([self.sim[s + touched].ravel(), sim]), np.concatenate([self.g[s + touched].ravel(), found])
        order = np.lexsort((found, -sim, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]  # each has k at least
        self.sim[s + touched], self.g[s + touched] = sim[order].reshape(-1, self.k), found[order].reshape(-1, self.k)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = ~np.isneginf(self.sim)
        return np.repeat(self.ids, some.sum(axis=1)), self.g[some], self.sim[some]


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """batches: (cell, side, id, vec), the queries (side 0) of a cell before its gallery."""
    cell, queries, near = None, [], None

    def told() -> Iterator[pa.RecordBatch]:
        q, g, sim = near.best() if near is not None else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for s in range(0, len(q), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in (q, g, sim)], ["q", "g", "sim"])

    for batch in batches:
        cells, sides, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(ids):
            continue
        vecs = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1), len(ids)]
        for since, until in zip(cuts, cuts[1:]):
            if cells[since] != cell:
                yield from told()
                cell, queries, near = cells[since], [], None
            if not sides[since]:
                queries.append((ids[since:until].copy(), vecs[since:until].copy()))
                continue
            if near is None and queries:
                near = _Nearest(np.concatenate([x for x, _ in queries]), np.concatenate([x for _, x in queries]), k)
                queries = []
            if near is not None:
                near.meet(ids[since:until], vecs[since:until])
    yield from told()


def _best(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The same of units of two blocks (block, ids, vecs, ids2, vecs2)."""
    held: dict[int, _Nearest] = {}
    for f in frames:
        for row in f.itertuples(index=False):
            held.setdefault(row.block, _Nearest(*_matrix(row.ids, row.vecs), k)).meet(*_matrix(row.ids2, row.vecs2))
    for near in held.values():
        yield pd.DataFrame(dict(zip(("q", "g", "sim"), near.best())))


def _units(a: DataFrame, b: DataFrame, when: str = "true") -> DataFrame:
    """Pairs of blocks. Each partition of the one side reads the blocks of the other; none is sent once a pair."""
    ship(a.sparkSession)
    return a.crossJoin(b.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("vecs").alias("vecs2"))).where(when)


def precision_at_k(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """One row: queries and, for each k, the share whose gold (q, gold) is among the k first. Null without queries."""
    hits = gold.join(ranked, (gold.q == ranked.q) & (gold.gold == ranked.g), "left").select(F.col("place"))
    return hits.agg(F.count("*").alias("queries"), *(F.round(F.avg(F.coalesce((F.col("place") <= k).cast("double"), F.lit(0.0))), 6).alias(f"p{k}") for k in ks))


def label_precision(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One row: queries, hits and share of queries that find their label among the k first."""
    q = labels.select(F.col("id").alias("q"), F.col("label").alias("ql"))
    g = labels.select(F.col("id").alias("g"), F.col("label").alias("gl"))
    found = ranked.where(F.col("place") <= k).join(q, "q").join(g, "g").groupBy("q").agg(F.bool_or(F.col("ql") == F.col("gl")).alias("hit"))
    return found.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("precision"))


def wrong(ranked: DataFrame, gold: DataFrame, most: int) -> DataFrame:
    """The first `most` queries whose best row is not their gold one."""
    return ranked.where("place = 1").join(gold, "q").where("g <> gold").orderBy("q").limit(most).select("q", "gold", F.col("g").alias("predicted"))


def mean_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, vec): the component-wise mean of vectors of one length; tasks add whole vectors up, one row a group travels. Rows without a vector
    count for nothing."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    whole = rows.where("vec is not null").select(*keys, array_to_vector("vec").alias("__v"))
    return whole.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias("vec"))


def token_vectors(rows: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(token, vec): the mean of a token's vectors in all its contexts (token, vec), divided by its length."""
    return normalized(mean_vectors(rows, "token"), epsilon)


def chosen_pairs(df: DataFrame, chosen: list, most: int = 1000) -> DataFrame:
    """(a, b, sim) of the unordered pairs of a short list of ids (at most `most`; a longer one is an error), of those that are in df."""
    if len(set(chosen)) > most:
        raise ValueError(f"more than {most} chosen ids")
    own = normalized(df.where(F.col("id").isin(list(set(chosen)))))
    a, b = own.select(F.col("id").alias("a"), F.col("vec").alias("va")), own.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", dot(F.col("va"), F.col("vb")).alias("sim"))


def pooled_sentences(tokens: DataFrame, vectors: DataFrame, size: int, exclude: list[str] | None = None, on: str = "token") -> DataFrame:
    """(sentence, vec): mean of the vectors of a sentence's tokens (sentence, token); repeats count, unknown tokens don't,
    and a sentence without a known token has zeros. on: the column that tokens and vectors share."""
    key = F.col(on) if not exclude else F.when(~F.col("token").isin(exclude), F.col(on))
    met = tokens.select("sentence", key.alias("__key")).join(vectors.select(F.col(on).alias("__on"), "vec"), F.col("__key") == F.col("__on"), "left")
    # sums by component are rows of fixed size: a task adds up before anything travels
    sums = met.groupBy("sentence").agg(F.count("vec").alias("n"), *(F.sum(F.get("vec", F.lit(k))).alias(f"s{k}") for k in range(size)))
    return sums.select("sentence", F.array(*(F.coalesce(F.col(f"s{k}") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)) for k in range(size))).alias("vec"))


def _pair_units(df: DataFrame, block_rows: int) -> DataFrame:
    """Blocks against themselves and the ones after them: every unordered pair of rows is in one unit."""
    a = _blocks(df, block_rows)
    return _units(a, a, "block <= block2")


def _pair_sims(row) -> tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """Similarities of a unit's unordered pairs, and a function from their places to the pairs' ids, the smaller one first."""
    (ids, left), (ids2, right) = _matrix(row.ids, row.vecs), _matrix(row.ids2, row.vecs2)
    sims, places = (left @ right.T).ravel(), None
    if row.block == row.block2:
        places = np.flatnonzero(np.triu(np.ones((len(ids), len(ids)), bool), 1).ravel())
        sims = sims[places]

    def named(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.divmod(at if places is None else places[at], len(ids2))
        return np.minimum(ids[i], ids2[j]), np.maximum(ids[i], ids2[j])

    return sims, named


def similarity_distribution(df: DataFrame, block_rows: int = 1000, bins: int = 1 << 16) -> DataFrame:
    """One row over all ordered pairs of different rows: mean, lower median, sample SD, minimum and quantiles (0.01, 0.05, 0.95, 0.99;
    interpolated). Null without pairs.

    Unordered pairs are taken once, by blocks as matrices. A first pass counts them by bins and sums them; the second
    brings only values from the bins that hold a wanted place, so the quantiles are exact and no list of all pairs is made.
    """
    spark = df.sparkSession
    units = _pair_units(df, block_rows)
    bin_of = lambda s: np.clip(((s + 1.0) * (bins / 2)).astype(np.int64), 0, bins - 1)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                sims, _ = _pair_sims(row)
                held, which = np.unique(bin_of(sims), return_inverse=True)
                yield pd.DataFrame({"bin": held, "n": np.bincount(which), "s": np.bincount(which, sims), "s2": np.bincount(which, sims * sims)})

    found = units.mapInPandas(count, "bin long, n long, s double, s2 double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).orderBy("bin").collect()  # a row a bin
    total = 2 * sum(r.n for r in found)
    if not total:
        return spark.createDataFrame([], "pairs long, mean double, lower_median double, sd double, least double, q01 double, q05 double, q95 double, q99 double")
    wanted = {"least": [0], "lower_median": [-(-total // 2) - 1]} | {f"q{100 * p:02.0f}": [math.floor(p * (total - 1)), math.ceil(p * (total - 1))] for p in (0.01, 0.05, 0.95, 0.99)}
    ends = np.cumsum([2 * r.n for r in found])
    holder = {place: int(np.searchsorted(ends, place, "right")) for places in wanted.values() for place in places}
    needed = np.array(sorted({found[h].bin for h in holder.values()}))

    def bring(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                sims, _ = _pair_sims(row)
                at = bin_of(sims)
                own = np.isin(at, needed)
                yield pd.DataFrame({"bin": at[own], "sim": sims[own]})

    within = units.mapInPandas(bring, "bin long, sim double")
    places = spark.createDataFrame([(found[h].bin, place, (place - (int(ends[h - 1]) if h else 0)) // 2) for place, h in holder.items()], "bin long, place long, inner long")
    numbers = within.withColumn("inner", F.row_number().over(Window.partitionBy("bin").orderBy("sim")) - 1)
    value = {r.place: r.sim for r in numbers.join(F.broadcast(places), ["bin", "inner"]).collect()}  # one row a wanted place
    mean = 2 * math.fsum(r.s for r in found) / total
    sd = math.sqrt(max(0.0, (2 * math.fsum(r.s2 for r in found) - total * mean * mean) / (total - 1)))

    def at(name: str, p: float) -> float:
        low, high = (value[x] for x in wanted[name])
        return low + (high - low) * (p * (total - 1) - math.floor(p * (total - 1)))

    row = (total, mean, value[wanted["lower_median"][0]], sd, value[0], *(at(f"q{100 * p:02.0f}", p) for p in (0.01, 0.05, 0.95, 0.99)))
    out = spark.createDataFrame([row], "pairs long, mean double, lower_median double, sd double, least double, q01 double, q05 double, q95 double, q99 double")
    return out.select("pairs", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def extreme_pairs(df: DataFrame, n: int, largest: bool, block_rows: int = 1000) -> DataFrame:
    """The n unordered pairs (a, b, sim) of greatest (or least) similarity, at a tie (to 1e-9) the smaller ids; each unit of two blocks
    gives its n best."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                sims, named = _pair_sims(row)
                if len(sims) > n:  # only what may be among the n best when rounded is sorted
                    last = np.partition(sims, len(sims) - n)[len(sims) - n] if largest else np.partition(sims, n - 1)[n - 1]
                    some = np.flatnonzero(sims >= last - 2e-9 if largest else sims <= last + 2e-9)
                else:
                    some = np.arange(len(sims))
                a, b = named(some)
                sims = np.round(sims[some], 9)
                order = np.lexsort((b, a, -sims if largest else sims))[:n]
                yield pd.DataFrame({"a": a[order], "b": b[order], "sim": sims[order]})

    pairs = _pair_units(df, block_rows).mapInPandas(best, "a long, b long, sim double")
    return pairs.orderBy(F.desc("sim") if largest else "sim", "a", "b").limit(n)


def neighbours_of(df: DataFrame, query: DataFrame, n: int, frequent_above: float | None = None) -> DataFrame:
    """The n rows most similar to the one query row, itself left out; `marked` where similarity is above the bound."""
    q = normalized(query).select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    out = normalized(df).crossJoin(F.broadcast(q)).where("id <> q").select("q", "id", F.round(dot(F.col("vec"), F.col("qv")), 9).alias("sim"))
    out = out.orderBy(F.desc("sim"), "id").limit(n)
    return out if frequent_above is None else out.withColumn("marked", F.col("sim") > frequent_above)


def pair_distance(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with distance: 1 less the cosine; null where a vector is missing."""
    v = normalized(vectors, 0.0)
    out = pairs.join(v.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a", "left").join(v.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b", "left")
    return out.withColumn("distance", F.round(1 - dot(F.col("va"), F.col("vb")), 9)).drop("va", "vb")


def close_far_random(pairs: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """(group, place, key, distance): the n closest, the n farthest of the others, and n of the rest by draw."""
    from glossweave.functions.text import draw

    own = pairs.select(key, "distance").where("distance is not null")
    close = own.orderBy("distance", key).limit(n).withColumn("grp", F.lit("close"))
    rest = own.join(F.broadcast(close.select(key)), key, "left_anti")
    far = rest.orderBy(F.desc("distance"), key).limit(n).withColumn("grp", F.lit("far"))
    rest = rest.join(F.broadcast(far.select(key)), key, "left_anti")
    some = rest.withColumn("draw", draw(seed, "random", F.col(key).cast("string"))).orderBy("draw", key).limit(n).drop("draw").withColumn("grp", F.lit("random"))
    order = {"close": [F.col("distance")], "far": [F.desc("distance")], "random": [draw(seed, "random", F.col(key).cast("string"))]}
    ranked = [d.withColumn("place", F.row_number().over(Window.orderBy(*order[g], key))) for g, d in (("close", close), ("far", far), ("random", some))]  # n rows each
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2])


def near_median(pairs: DataFrame, n: int, group: str, key: str) -> DataFrame:
    """Of each group the n rows closest to its upper median distance; at a tie the smaller distance, then the key."""
    w = Window.partitionBy(group)
    ranked = pairs.withColumn("__i", F.row_number().over(w.orderBy("distance", key))).withColumn("__n", F.count("*").over(w))
    middle = ranked.withColumn("median", F.max(F.when(F.col("__i") == F.floor(F.col("__n") / 2) + 1, F.col("distance"))).over(w))
    place = F.row_number().over(w.orderBy(F.round(F.abs(F.col("distance") - F.col("median")), 9), "__i"))
    return middle.withColumn("place", place).where(F.col("place") <= n).select(group, key, "distance", "median", "place")


def pca_2d(df: DataFrame) -> DataFrame:
    """(id, x, y): the two first principal components of the centred vectors; each sign makes the largest part positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select("id", array_to_vector("vec").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=2, inputCol="centred", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    sign = [1.0 if abs(axes[:, k].max()) >= abs(axes[:, k].min()) else -1.0 for k in range(2)]
    out = model.transform(centred).select("id", vector_to_array("p").alias("p"))
    return out.select("id", (F.col("p")[0] * sign[0]).alias("x"), (F.col("p")[1] * sign[1]).alias("y"))
