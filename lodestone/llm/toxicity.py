"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fitting, shared

#: The field is fitted on at most so many labelled documents of either class, and of each class at most so many
#: characters in all.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 4_000_000
#: Share of the sample that calibrates document scores instead.
CALIBRATE = 4
#: Hashed emission weights, and lengths of the word beginnings that have one besides the whole word.
BUCKETS, PREFIXES = 1 << 18, (3, 4, 5, 6)
#: A feature marks toxic words if toxic documents hold it surely (one and a half standard errors) so many times as often.
MARKED = 4.0
#: Steps of the optimiser, tokens of whole documents that it works on at a time, and length of the blocks in which chains are scanned.
STEPS, TOKENS, BLOCK = 60, 200_000, 128
#: Tokens of this marginal belong to a span.
SPAN = 0.5
#: Documents scored at a time, and bytes of their text; words a worker keeps, and the longest that it keeps.
SLICE, SLICE_BYTES, CACHE_WORDS, CACHE_CHARS = 1000, 1 << 20, 200_000, 64

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”„’‘…"


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in one row, coded, and how many each text has. Words are parted by ASCII white space."""
    parts = pc.split_pattern_regex(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), "")), r"[ \t\n\v\f\r]+")
    flat, n = parts.flatten(), pc.list_value_length(parts).to_numpy().copy()
    blank = pc.equal(flat, "")
    if pc.any(blank).as_py():  # texts without words
        n[(n == 1) & np.isin(np.cumsum(n) - 1, np.flatnonzero(blank.to_numpy(zero_copy_only=False)))] = 0
        flat = flat.filter(pc.invert(blank))
    return flat.dictionary_encode(), n


def features(word: str) -> list[int]:
    """Buckets of the word and its beginnings, in lower case without marks around it; a beginning that the word is too
    short for falls into the word's own bucket again."""
    w = word.lower().strip(_MARKS)
    whole = zlib.crc32(f"={w}".encode("utf-8", "surrogatepass")) % BUCKETS
    return [whole, *(zlib.crc32(w[:n].encode("utf-8", "surrogatepass"), n) % BUCKETS if len(w) >= n else whole for n in PREFIXES)]


def _normed(*rows: np.ndarray) -> list[np.ndarray]:
    top = np.maximum.reduce(rows)
    return [r / top for r in rows]


@dataclass
class Chain:
    """Potentials of a two-state field: of the steps from state to state, and of the first state."""

    step: np.ndarray
    first: np.ndarray

    def messages(self, emit: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward messages (each for states 0 and 1, scaled anyhow) of chains that lie one after the other.
        emit: potential of state 1 at each token, that of 0 being 1; begins: whether a chain begins there.

        Exact for chains of any length: all blocks of BLOCK tokens are scanned at once, first for the product of their
        step matrices, then, from the state at each block's edge, for every token. A beginning is a step whose matrix
        has equal rows, so nothing passes from one chain to the next.
        """
        n = len(emit)
        pad = -n % BLOCK
        e = np.concatenate([emit, np.ones(pad)]).reshape(-1, BLOCK).T.copy()
        b = np.concatenate([begins, np.ones(pad, bool)]).reshape(-1, BLOCK).T.copy()
        t, f = self.step, self.first
        m00, m10 = np.where(b, f[0], t[0, 0]), np.where(b, f[0], t[1, 0])
        m01, m11 = np.where(b, f[1], t[0, 1]) * e, np.where(b, f[1], t[1, 1]) * e
        blocks = e.shape[1]
        p = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
        for k in range(BLOCK):
            p = _normed(p[0] * m00[k] + p[1] * m10[k], p[0] * m01[k] + p[1] * m11[k], p[2] * m00[k] + p[3] * m10[k], p[2] * m01[k] + p[3] * m11[k])
        edge_f, edge_b = np.ones((2, blocks)), np.ones((2, blocks))
        a0 = a1 = c0 = c1 = 1.0
        q = [x.tolist() for x in p]
        for k in range(blocks - 1):
            a0, a1 = a0 * q[0][k] + a1 * q[2][k], a0 * q[1][k] + a1 * q[3][k]
            a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
            edge_f[:, k + 1] = a0, a1
            j = blocks - 1 - k
            c0, c1 = q[0][j] * c0 + q[1][j] * c1, q[2][j] * c0 + q[3][j] * c1
            c0, c1 = c0 / (c0 + c1), c1 / (c0 + c1)
            edge_b[:, j - 1] = c0, c1
        f0, f1, b0, b1 = (np.empty_like(e) for _ in range(4))
        x, y = edge_f
        for k in range(BLOCK):
            x, y = _normed(x * m00[k] + y * m10[k], x * m01[k] + y * m11[k])
            f0[k], f1[k] = x, y
        x, y = edge_b
        for k in range(BLOCK - 1, -1, -1):
            b0[k], b1[k] = x, y
            x, y = _normed(m00[k] * x + m01[k] * y, m10[k] * x + m11[k] * y)
        return tuple(m.T.ravel()[:n] for m in (f0, f1, b0, b1))

    def marginals(self, emit: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Probability of state 1 at each token."""
        f0, f1, b0, b1 = self.messages(emit, begins)
        return f1 * b1 / (f0 * b0 + f1 * b1)


def _emit(score: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(score, -30, 30))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    chain: Chain
    document: np.ndarray

    def word_scores(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        new = [w for w in words if w not in known]
        at = np.array([features(w) for w in new], np.int64).reshape(len(new), -1)
        fresh = dict(zip(new, self.weights[at].sum(axis=1).tolist(), strict=True))
        out = np.array([known[w] if w in known else fresh[w] for w in words])
        if len(known) < CACHE_WORDS:
            known.update((w, z) for w, z in fresh.items() if len(w) <= CACHE_CHARS)
        return out

    def tokens(self, texts: pa.Array, known: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of every word of the texts, and how many words each text has."""
        coded, n = split(texts)
        score = self.word_scores(coded.dictionary.to_pylist(), known)[coded.indices.to_numpy()] + self.bias
        return self.chain.marginals(_emit(score), _begins(n)), n

    def scores(self, marginals: np.ndarray, n: np.ndarray) -> np.ndarray:
        return fitting.sigmoid(np.column_stack([evidence(marginals, n), np.ones(len(n))]) @ self.document)


def _begins(n: np.ndarray) -> np.ndarray:
    begins = np.zeros(int(n.sum()), bool)
    begins[(np.cumsum(n) - n)[n > 0]] = True
    return begins


def evidence(marginals: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a document's score goes by: its highest marginal, the expected number of toxic words, their share."""
    full = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[full]
    top, total = np.zeros(len(n)), np.zeros(len(n))
    if len(full):
        top[full], total[full] = np.maximum.reduceat(marginals, starts), np.add.reduceat(marginals, starts)
    return np.column_stack([top, np.log1p(total), np.sqrt(total / np.maximum(n, 1)), np.minimum(total, 3)])


def _token_labels(at: np.ndarray, codes: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Token labels from document labels: in a toxic document, the words with a feature that toxic documents hold clearly
    more often than others do. at: the features of each word."""
    doc = np.repeat(np.arange(len(n)), n)
    pairs = np.unique(doc.astype(np.int64) * len(at) + codes)
    d, word = pairs // len(at), pairs % len(at)
    both = np.unique(np.repeat(d, at.shape[1]) * BUCKETS + at[word].ravel())
    d, feature = both // BUCKETS, both % BUCKETS
    k = np.bincount(feature[y[d] == 1], minlength=BUCKETS)
    z = np.bincount(feature[y[d] == 0], minlength=BUCKETS)
    odds = np.log((k + 0.5) / (y.sum() + 1)) - np.log((z + 0.5) / ((1 - y).sum() + 1)) - 1.5 * np.sqrt(1 / (k + 0.5) + 1 / (z + 0.5))
    marked = ((k >= 3) & (odds > np.log(MARKED)))[at].any(axis=1)
    return (marked[codes] & (y[doc] == 1)).astype(np.float64)


def fit(texts: list[str], y: np.ndarray, rates: tuple[float, float] = (1.0, 1.0)) -> Model:
    """The field and the document weights, from documents with labels; rates: what share of each class was sampled, so
    that scores are right for all documents and not for the sample."""
    model = Model(np.zeros(BUCKETS), 0.0, Chain(np.ones((2, 2)), np.ones(2)), np.zeros(5))
    held = np.arange(len(y)) % CALIBRATE == CALIBRATE - 1
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    known: dict[str, float] = {}
    if len(train) and 0 < y[~held].sum() < (~held).sum():
        coded, n = split(pa.array(train, pa.string()))
        codes = coded.indices.to_numpy()
        at = np.array([features(w) for w in coded.dictionary.to_pylist()], np.int64)
        label = _token_labels(at, codes, n, y[~held])
        _optimise(model, at, codes, _begins(n), label)
    rest = [t for t, h in zip(texts, held, strict=True) if h]
    if rest:
        marginals, n = model.tokens(pa.array(rest, pa.string()), known)
        model.document = fitting.rising(evidence(marginals, n), y[held], ridge=0.1)
    else:
        model.document = fitting.logistic(np.zeros((len(y), 4)), y)
    model.document[-1] += np.log(rates[0] / rates[1])
    return model


def _optimise(model: Model, at: np.ndarray, codes: np.ndarray, begins: np.ndarray, label: np.ndarray) -> None:
    """Maximises the likelihood of the token labels with a small quadratic penalty, by gradient steps that adapt to each
    weight."""
    rate = (label.sum() + 1) / (len(label) + 2)
    model.bias = float(np.log(rate / (1 - rate)))
    step, first = np.zeros((2, 2)), np.zeros(2)
    squares, step_squares = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    before = np.concatenate([[0], label[:-1]])
    inside = ~begins
    seen = np.array([[((before == i) & (label == j) & inside).sum() for j in (0, 1)] for i in (0, 1)], np.float64)
    size = np.bincount(codes, minlength=len(at)).astype(np.float64)
    starts = np.append(np.flatnonzero(begins), len(label))
    cuts = [0]
    for start in starts.tolist():
        if start - cuts[-1] >= TOKENS or start == len(label):
            cuts.append(start)
    for _ in range(STEPS):
        chain, score = Chain(np.exp(step), np.exp(first)), model.weights[at].sum(axis=1) + model.bias
        word, expected = np.zeros(len(at)), np.zeros((2, 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            emit = _emit(score[codes[lo:hi]])
            f0, f1, b0, b1 = chain.messages(emit, begins[lo:hi])
            p = f1 * b1 / (f0 * b0 + f1 * b1)
            word += np.bincount(codes[lo:hi], label[lo:hi] - p, minlength=len(at))
            g0, g1 = np.concatenate([[1.0], f0[:-1]]), np.concatenate([[1.0], f1[:-1]])
            joint = [[g0 * chain.step[0, 0] * b0, g0 * chain.step[0, 1] * emit * b1], [g1 * chain.step[1, 0] * b0, g1 * chain.step[1, 1] * emit * b1]]
            total = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
            expected += np.array([[(joint[i][j] / total)[inside[lo:hi]].sum() for j in (0, 1)] for i in (0, 1)])
        gradient = np.bincount(at.ravel(), np.repeat(word, at.shape[1]), minlength=BUCKETS) - 0.05 * model.weights
        squares += gradient * gradient
        model.weights += 0.7 * gradient / np.sqrt(squares)
        gradient = seen - expected - 0.1 * step
        step_squares += gradient * gradient
        step += 0.2 * gradient / np.sqrt(step_squares)
    model.chain = Chain(np.exp(step), np.exp(first))
    assert np.isfinite(model.weights).all() and size.sum() == len(codes)


def _fitting(chars: list[int], budget: int) -> list[int]:
    """Places of the documents that are taken in turn: each that still fits into the budget; if none does, the shortest."""
    taken, used = [], 0
    for k, n in enumerate(chars):
        if used + n <= budget:
            taken.append(k)
            used += n
    return taken or ([min(range(len(chars)), key=chars.__getitem__)] if chars else [])


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[str], np.ndarray, tuple[float, float]]:
    """The bounded sample of labelled documents, in an order that doesn't depend on the input's, and its share of either
    class. A document that would take its class beyond SAMPLE_CHARS is left out, and the next ones are tried."""
    tmp = shared.Scratch(docs.sparkSession, "toxicity-sample")
    rows = fitting.labelled(docs, labels, label, SAMPLE_ROWS).withColumn("at", F.xxhash64("doc_id", "text"))
    rows = tmp.cut(rows.withColumn("chars", F.coalesce(F.length("text"), F.lit(0))).distinct(), "labelled")
    heads = sorted(rows.select("at", "doc_id", "y", "chars").collect())
    taken = []
    for c in (0, 1):
        of = [r for r in heads if r["y"] == c]
        taken += [of[k] for k in _fitting([r["chars"] for r in of], SAMPLE_CHARS)]
    wanted = docs.sparkSession.createDataFrame([(r["at"], r["doc_id"], r["y"]) for r in taken], "at long, doc_id long, y int")
    rows = rows.join(F.broadcast(wanted), ["at", "doc_id", "y"], "left_semi").select("at", "doc_id", "text", "y").collect()  # at most 2 * SAMPLE_ROWS rows
    rows.sort(key=lambda r: (r["at"], r["doc_id"], r["text"] or "", r["y"]))
    y = np.array([r["y"] for r in rows], np.int64)
    all_ = {r[label]: r["n"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.countDistinct("doc_id").alias("n")).collect()}
    rates = tuple(min(1.0, max(int((y == c).sum()), 1) / max(all_.get(c, 0), 1)) for c in (0, 1))
    return [r["text"] or "" for r in rows], y, rates


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    with shared.worker("toxicity-fit"):  # lets go of what fitting took on the driver
        return fit(*sample(docs, labels, label))


def _offsets(text: str, marginals: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of the runs of toxic words, marks around them left out."""
    hot, out, last = marginals >= SPAN, [], -2
    if not hot.any():
        return out
    for k, m in enumerate(_TOKEN.finditer(text)):
        if hot[k]:
            word = m[0]
            start = m.start() + len(word) - len(word.lstrip(_MARKS))
            end = max(m.end() - len(word) + len(word.rstrip(_MARKS)), start)
            if k == last + 1:
                out[-1]["end"] = end
            else:
                out.append({"start": start, "end": end})
            last = k
    return out


def score(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", spans_col: str | None = "spans") -> DataFrame:
    """docs with score, the calibrated probability that the document is toxic, and spans, the character offsets of its
    toxic words in runs.

    Every row keeps its columns; ones of the new names are replaced. Whole texts are scored; nothing else of a row is
    looked at. A null text counts as an empty one, which gets the score of a document without toxic words and no spans.
    An empty table gives an empty result.
    """
    shared_model = spark.sparkContext.broadcast(model)
    new = {score_col: "double"} | ({spans_col: "array<struct<start:int,end:int>>"} if spans_col else {})
    kept = docs.drop(*new)
    kinds = [pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared_model.value, {}
        with shared.worker("toxicity"):
            for batch in batches:
                for part in shared.parts(batch, text_col, SLICE, SLICE_BYTES):
                    texts = part.column(text_col)
                    marginals, n = m.tokens(texts, known)
                    out = [pa.array(m.scores(marginals, n), kinds[0])]
                    if spans_col:
                        ends = np.cumsum(n).tolist()
                        some = (evidence(marginals, n)[:, 0] >= SPAN).tolist()
                        out.append(pa.array([_offsets(texts[i].as_py(), marginals[ends[i] - n[i] : ends[i]]) if hot else [] for i, hot in enumerate(some)], kinds[1]))
                    yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"`{c}` {t}" for c, t in new.items())])
    return kept.mapInArrow(run, schema)
