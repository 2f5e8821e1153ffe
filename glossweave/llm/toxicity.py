"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: in a toxic training document a word is toxic if
the word or one of its beginnings is far more common in toxic documents than in clean ones; all words of clean
documents are clean. A two-state chain with the word, its beginnings and its ending as features is
fitted to these tokens by its likelihood. Forward-backward marginals of a whole text then give each token's
probability; a logistic model of their largest log-odds and their sum gives the document's score, and
runs of probable tokens give the offending offsets.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import row_of, ship, with_row, written

_WORD = re.compile(r"[^\W\d_]+")
_SPAN = "array<struct<first: int, end: int, probability: double>>"
_SPAN_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
LANES = 512


def features(word: str) -> list[str]:
    w = word.lower()
    return [f"w:{w}", *(f"{n}:{w[:n]}" for n in (4, 5, 6) if len(w) >= n), f"e:{w[-4:]}"]


def _lanes(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts by falling length, so that those of one step of a lane end together."""
    order = np.argsort(-lengths, kind="stable")
    for k in range(0, len(order), LANES):
        part = order[k : k + LANES]
        if lengths[part[0]]:
            yield part[lengths[part] > 0]


def marginals(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of every token the probability of the toxic state; expected transitions (2 x 2); the log-partition.

    emission: each token's log-odds; text k has the tokens bounds[k] to bounds[k+1]. Scores of the clean state are 0.
    """
    out, pairs, log_z = np.zeros(len(emission)), np.zeros((2, 2)), 0.0
    t = np.exp(transition)
    factor = np.exp(np.clip(emission, -30, 30))
    lengths = np.diff(bounds)
    for lane in _lanes(lengths):
        own, first = lengths[lane], bounds[lane]
        longest = int(own[0])
        active = np.searchsorted(-own, -np.arange(longest), "left")  # texts that have a token at step s
        forward = np.zeros((longest, len(lane)))  # probability of toxic given the tokens so far
        scales = np.ones((longest, len(lane)))
        f = factor[first]
        raw1, raw0 = math.exp(start) * f, np.ones(len(lane))
        for s in range(longest):
            n = active[s]
            if s:
                f, p = factor[first[:n] + s], forward[s - 1, :n]
                raw1 = ((1 - p) * t[0, 1] + p * t[1, 1]) * f
                raw0 = (1 - p) * t[0, 0] + p * t[1, 0]
            scales[s, :n] = raw0 + raw1
            forward[s, :n] = raw1 / scales[s, :n]
        log_z += float(np.log(scales).sum())
        after0, after1 = np.ones(len(lane)), np.ones(len(lane))
        for s in range(longest - 1, -1, -1):
            n = active[s]
            p = forward[s, :n]
            if s + 1 < longest and (m := active[s + 1]):  # those that go on after this token
                f, scale = factor[first[:m] + s + 1], scales[s + 1, :m]
                b0, b1 = after0[:m] / scale, after1[:m] * f / scale
                q = forward[s, :m]
                pairs[0, 0] += ((1 - q) * t[0, 0] * b0).sum()
                pairs[0, 1] += ((1 - q) * t[0, 1] * b1).sum()
                pairs[1, 0] += (q * t[1, 0] * b0).sum()
                pairs[1, 1] += (q * t[1, 1] * b1).sum()
                after0[:m], after1[:m] = t[0, 0] * b0 + t[0, 1] * b1, t[1, 0] * b0 + t[1, 1] * b1
            one = p * after1[:n]
            out[first[:n] + s] = one / (one + (1 - p) * after0[:n])
    return out, pairs, log_z


def whole_marginals(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray, start: float, window: int = 512) -> np.ndarray:
    """The marginals of whole texts, long ones in windows.

    A step of the chain shrinks the (Hilbert) distance between any two beginnings by a factor that the transitions
    set (Birkhoff's bound), whatever the tokens are. Windows overlap by as many tokens as shrink it to 1e-15, so
    they agree with one pass over the text.
    """
    cross = math.exp(min(abs(transition[0, 0] + transition[1, 1] - transition[0, 1] - transition[1, 0]) / 2, 30))
    factor = (cross - 1) / (cross + 1)
    overlap = 2 if factor < 1e-9 else math.ceil(math.log(1e-15) / math.log(factor)) + 2
    window = max(window, 2 * overlap)
    lengths = np.diff(bounds)
    count = np.maximum(1, -(-lengths // window))
    text = np.repeat(np.arange(len(lengths)), count)
    inner = bounds[:-1][text] + window * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    inner_end = np.minimum(inner + window, bounds[1:][text])
    outer, outer_end = np.maximum(inner - overlap, bounds[:-1][text]), np.minimum(inner_end + overlap, bounds[1:][text])
    sizes = outer_end - outer
    own = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(own[-1]) + np.repeat(outer - own[:-1], sizes)
    p, _, _ = marginals(emission[places], own, transition, start)
    keep = (places >= np.repeat(inner, sizes)) & (places < np.repeat(inner_end, sizes))
    out = np.zeros(len(emission))
    out[places[keep]] = p[keep]
    return out


@dataclass
class Model:
    """What a fit gives. Features that the fit didn't meet have weight 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    document: tuple[float, float, float] = (0.0, 0.0, -2.0)

    def __post_init__(self):
        self._by: dict[str, dict[str, float]] = {k: {} for k in "w456e"}
        for f, v in self.weights.items():
            self._by[f[0]][f[2:]] = v

    def emission(self, word: str) -> float:
        """The bias and the weights of features(word), looked up without making their names."""
        w, by = word.lower(), self._by
        out = self.bias + by["w"].get(w, 0.0) + by["e"].get(w[-4:], 0.0)
        if len(w) >= 4:
            out += by["4"].get(w[:4], 0.0)
            if len(w) >= 5:
                out += by["5"].get(w[:5], 0.0)
                if len(w) >= 6:
                    out += by["6"].get(w[:6], 0.0)
        return out

    def scores(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_evidence(p, bounds) @ np.array(self.document), -30, 30)))


def _evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text: the largest token's log-odds, the log of the expected number of toxic tokens, 1."""
    out = np.zeros((len(bounds) - 1, 3))
    out[:, 0], out[:, 2] = -8.0, 1.0
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[full]
        top = np.clip(np.maximum.reduceat(p, at), 1e-9, 1 - 1e-9)
        out[full, 0] = np.maximum(np.log(top / (1 - top)), -8.0)
        out[full, 1] = np.log1p(np.add.reduceat(p, at))
    return out


def fit(texts: list[str], toxic: list[int], least: int = 3, ratio: float = 3.0, steps: int = 20, decay: float = 1e-4) -> Model:
    """A model of labelled texts. Where nothing tells toxic texts from others (no labels, one label alone, no word that toxic texts have
    oftener) it flags nothing: every score is half the share of toxic labels, so below 0.5."""
    y = np.asarray(toxic, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(document=(0.0, 0.0, math.log(share / (2 - share))))
    if not 0 < y.sum() < len(y):
        return model
    number: dict[str, int] = {}
    found, bounds = array("q"), [0]
    for t in texts:
        found.extend(number.setdefault(w, len(number)) for w in _WORD.findall(t.lower()))
        bounds.append(len(found))
    tokens, bounds = np.frombuffer(found, np.int64), np.asarray(bounds)
    names: dict[str, int] = {}
    flat, begins = array("q"), [0]  # the features of each word
    for w in number:
        flat.extend(names.setdefault(f, len(names)) for f in features(w))
        begins.append(len(flat))
    words = len(number)
    number.clear()
    flat, begins = np.frombuffer(flat, np.int64), np.asarray(begins)
    owner = np.repeat(np.arange(words), np.diff(begins))
    # labelled tokens
    held = np.zeros((2, len(names)))
    for k in range(len(texts)):
        own = np.unique(tokens[bounds[k] : bounds[k + 1]])
        sizes = begins[own + 1] - begins[own]
        at = np.repeat(begins[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        held[toxic[k], np.unique(flat[at])] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.zeros(len(names))
    for f in np.flatnonzero(held[1] >= least).tolist():
        c, clean = held[1, f], held[0, f]
        surprise = 2 * c * math.log(c / ((c + clean) * n1 / len(y))) + (2 * clean * math.log(clean / ((c + clean) * n0 / len(y))) if clean else 0.0)
        if surprise >= 2 * math.log(len(names)) + 4:  # more than the best of as many chance features
            odds[f] = math.log((c + 0.1) / (n1 + 1)) - math.log((clean + 0.1) / (n0 + 1))
    lexical = np.zeros(words, bool)
    np.logical_or.at(lexical, owner, odds[flat] >= ratio)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    label = (lexical[tokens] & (y[doc] > 0)).astype(float)
    if not label.any():
        return model
    # likelihood by gradient steps of each weight's own length; a text counts as sequences of at most 128 tokens here
    opens = np.zeros(len(tokens), bool)
    for k in range(len(texts)):
        opens[bounds[k] : bounds[k + 1] : 128] = True
    sequences = np.concatenate([np.flatnonzero(opens), [len(tokens)]])
    observed = np.zeros((2, 2))
    follow = ~opens
    np.add.at(observed, (label[:-1][follow[1:]].astype(int), label[1:][follow[1:]].astype(int)), 1)
    weights, bias, start, transition = np.zeros(len(names)), math.log(label.mean() / (1 - label.mean())), 0.0, np.zeros((2, 2))
    gathered = [np.full(len(names), 1e-6), 1e-6, 1e-6, np.full((2, 2), 1e-6)]
    for step in range(steps):
        word_score = bias + np.bincount(owner, weights[flat], words)
        p, pairs, _ = marginals(word_score[tokens], sequences, transition, start)
        off = label - p
        by_word = np.bincount(tokens, off, words)
        rate = 0.7 * (1 - step / (2 * steps))
        gradients = [np.bincount(flat, by_word[owner], len(names)) - decay * len(tokens) * weights * 0.01, off.sum(), off[opens].sum(), observed - pairs]
        moves = []
        for k, g in enumerate(gradients):
            gathered[k] = gathered[k] + g * g
            moves.append(rate * g / np.sqrt(gathered[k]))
        weights, bias, start, transition = weights + moves[0], bias + moves[1], start + moves[2], transition + moves[3]
        transition[0, 0] = 0.0  # the scale is free
    word_score = bias + np.bincount(owner, weights[flat], words)
    p = whole_marginals(word_score[tokens], bounds, transition, start)
    x = _evidence(p, bounds)
    d = np.array([0.3, 0.0, math.log(share / (1 - share))])
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ d, -30, 30)))
        ridge = np.diag([1.0, 1.0, 0.01])
        hessian = (x * (q * (1 - q))[:, None]).T @ x + ridge
        d = d + np.clip(np.linalg.solve(hessian, x.T @ (y - q) - ridge @ d), -2, 2)
    used = np.flatnonzero(np.abs(weights) > 1e-2)
    kept = set(used.tolist())
    return Model({f: float(weights[i]) for f, i in names.items() if i in kept}, float(bias), transition, float(start), tuple(float(v) for v in d))


def _tag(model: Model, span_least: float):
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # what is in memory does not grow with Arrow's batches
                b = whole.slice(at, 500)
                texts = b.column(1).to_pylist()
                emissions, bounds = [], np.zeros(len(texts) + 1, np.int64)
                for k, t in enumerate(texts):
                    ws = _WORD.findall(t)
                    for w in ws:
                        if w not in known:
                            known[w] = model.emission(w)
                    emissions.append(np.fromiter(map(known.__getitem__, ws), float, len(ws)))
                    bounds[k + 1] = bounds[k] + len(ws)
                    if len(known) > 300_000:
                        known.clear()
                p = whole_marginals(np.concatenate(emissions), bounds, model.transition, model.start)
                scores = model.scores(p, bounds)
                spans: list[list[dict]] = [[] for _ in texts]
                for k in np.unique(np.searchsorted(bounds, np.flatnonzero(p >= span_least), "right") - 1).tolist():
                    own = p[bounds[k] : bounds[k + 1]]
                    for i, m in enumerate(_WORD.finditer(texts[k])):
                        if own[i] >= span_least:
                            if spans[k] and i and own[i - 1] >= span_least:
                                spans[k][-1] |= {"end": m.end(), "probability": max(spans[k][-1]["probability"], float(own[i]))}
                            else:
                                spans[k].append({"first": m.start(), "end": m.end(), "probability": float(own[i])})
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(spans, _SPAN_ARROW)], names=["row", "score", "spans"])

    return tag


def fit_on(docs: DataFrame, labels: DataFrame, where=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 4000, most_chars: int = 32 << 20) -> Model:
    """Fit on labelled rows of docs, at most `most`: the first half of each label by a hash of the id, and of their texts, in that
    order, each that fits into what is left of most_chars characters.

    Both bounds hold what the driver gets, whatever the lengths of texts are. A text longer than a sixteenth of most_chars is
    not fitted to (it is scored as a whole, like any other), so no text takes the place of many. Rows with a null id, text or
    label, and those that `where` (a condition on the id column) leaves out, are not used. Of rows that share an id the least
    text is used. A label that repeats counts as toxic if one of its rows is. Without both labels the model flags nothing.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("mark"))
    if where is not None:
        marks = marks.where(where(F.col("key")))
    order = F.xxhash64(F.col("key").cast("string")), F.col("key")
    chosen = [marks.where(F.col("mark") == v).orderBy(*order).limit(most // 2) for v in (0, 1)]
    keys = {r.key: r.mark for c in chosen for r in c.collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in keys], "key long")
    own = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("body")).where("body is not null")
    one = own.join(F.broadcast(ids), "key").groupBy("key").agg(F.min("body").alias("body"))  # no more ids than `most`
    sized = written(one.withColumn("chars", F.length("body")).withColumn("place", F.xxhash64(F.col("key").cast("string"))), "fit")
    fits, left = set(), most_chars
    for r in sized.where(F.col("chars") <= most_chars // 16).select("key", "chars").orderBy("place", "key").collect():  # no more rows of numbers than `most`
        if r.chars <= left:
            fits.add(r.key)
            left -= r.chars
    rows = sorted(r for r in sized.where(F.col("key").isin(list(fits))).select("key", "body").toLocalIterator()) if fits else []
    return fit([r.body for r in rows], [keys[r.key] for r in rows])


def scored_rows(docs: DataFrame, model: Model, text_col: str = "text", span_least: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """row (a struct of `columns`; None: all of docs), score and spans; see score. No name of a column can clash."""
    ship(docs.sparkSession)
    own = docs.select(row_of(docs if columns is None else docs.select(*columns)), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kind = StructType([own.schema["row"], *StructType.fromDDL(f"score double, spans {_SPAN}").fields])
    return own.mapInArrow(_tag(model, span_least), kind)


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", span_least: float = 0.5) -> DataFrame:
    """The columns `carry` of docs, score (0 to 1, higher is likelier toxic) and spans: characters first to end
    and the largest probability of each run of probable words. A carried column called score or spans comes back
    as score_carried or spans_carried.

    A null text is an empty one; texts without words score by the model's intercept. Null and repeated ids pass
    through; an empty table gives no rows. Rows never meet: no shuffle.
    """
    return with_row(scored_rows(docs, model, text_col, span_least, carry), carry, ["score", "spans"])
