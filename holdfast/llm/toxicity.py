"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Tokens are runs of letters. The chain has two states, clean and toxic; a token's emission is the sum of the weights of its
features (the lower-cased word and its prefixes), the transitions are weights of their own. Forward-backward gives every
token's probability of being toxic. A document's score is a logistic function of how many toxic tokens it is expected to
hold, how many for its length, and how sure it is that there is one; tokens of probability one half or more that follow
each other are the reported spans.

Learning reads a bounded sample of labelled documents outside the held-out fifth: at most ``SAMPLE_ROWS`` whole texts of each
label, in the order of a hash of the id, texts of at most ``SAMPLE_CHARS`` code points first, and as many longer ones as fit
into ``SAMPLE_ROWS`` times ``SAMPLE_CHARS`` code points. Labels are given for documents, so tokens are labelled first: a token of a toxic document is toxic if its word or one of its prefixes is found in far more toxic than
clean documents. Copies and near copies count once for that. Everything else covers all rows and whole texts.

A null or empty text has no token and the score of none. Without usable texts of both labels nothing is learned: every score is
the share of toxic labels, or 0, and ``reject`` keeps all rows. Repeated rows are scored each; of contradicting labels of one document each counts. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import blocks, held_out, packed, prepare, quoted, unpacked

SAMPLE_ROWS, SAMPLE_CHARS = 1000, 8_000
TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
#: features of fewer sampled documents have no weight
FEATURE_DOCS = 5
#: log odds, log-likelihood ratio and share of the toxic sample from which a feature of so many letters marks toxic tokens
LEXICON_ODDS, LEXICON_RATIO, LEXICON_SHARE, LEXICON_LETTERS = 1.5, 15.0, 0.01, 4
LIMIT = 20.0
RIDGE = 0.5
#: distinct tokens whose emissions a task remembers
REMEMBER = 300_000
SCHEMA = "doc_id long, score double, n_tokens long, toxic_tokens double, span_starts array<long>, span_ends array<long>"


def token_features(token: str) -> list[str]:
    """The token's prefixes, then its word with a mark that no prefix has."""
    word = token.lower()
    return [*(word[:k] for k in PREFIXES if len(word) >= k), word + "$"]


# --- the chain --------------------------------------------------------------------------------------------------------


def steps(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The four entries (from-to: 00, 01, 10, 11) of every token's step, for sequences laid end to end. Rows of
    ``transition``: from clean, from toxic, from nowhere. At the first token of a sequence both states step alike, which
    cuts it off from what comes before."""
    t = np.exp(transition)
    toxic = np.exp(emission)
    return np.stack([np.where(first, t[2, 0], t[0, 0]), np.where(first, t[2, 1], t[0, 1]) * toxic,
                     np.where(first, t[2, 0], t[1, 0]), np.where(first, t[2, 1], t[1, 1]) * toxic])


def forward_backward(step: np.ndarray):
    """Probability of state toxic in the normalised forward and backward messages of every token.

    The batch is cut into lanes of equal length that are walked side by side: once for each lane's product of steps, then,
    from the messages that these give at the lanes' ends, once forward and once backward inside all lanes."""
    n = step.shape[1]
    length = max(1, int(np.sqrt(n)))
    lanes = -(-n // length)
    padded = np.ones((4, lanes * length))
    padded[:, :n] = step
    # [entry, position in lane, lane]
    m = np.ascontiguousarray(padded.reshape(4, lanes, length).transpose(0, 2, 1))
    p00, p01, p10, p11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for a, b, c, d in zip(*m):
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        scale = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
    ahead, behind = np.full(lanes, 0.5), np.full(lanes, 0.5)
    for k in range(1, lanes):
        r = ahead[k - 1]
        x, y = (1 - r) * p00[k - 1] + r * p10[k - 1], (1 - r) * p01[k - 1] + r * p11[k - 1]
        ahead[k] = y / (x + y)
    for k in range(lanes - 2, -1, -1):
        r = behind[k + 1]
        x, y = (1 - r) * p00[k + 1] + r * p01[k + 1], (1 - r) * p10[k + 1] + r * p11[k + 1]
        behind[k] = y / (x + y)
    alpha, beta = np.empty((length, lanes)), np.empty((length, lanes))
    for t, (a, b, c, d) in enumerate(zip(*m)):
        x, y = (1 - ahead) * a + ahead * c, (1 - ahead) * b + ahead * d
        alpha[t] = ahead = y / (x + y)
    for t in range(length - 1, -1, -1):
        beta[t] = behind
        a, b, c, d = m[:, t]
        x, y = (1 - behind) * a + behind * b, (1 - behind) * c + behind * d
        behind = y / (x + y)
    return alpha.T.ravel()[:n], beta.T.ravel()[:n]


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability that each token is toxic."""
    if not len(emission):
        return np.empty(0)
    alpha, beta = forward_backward(steps(emission, first, transition))
    toxic = alpha * beta
    return toxic / (toxic + (1 - alpha) * (1 - beta))


# --- the model --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    transition: np.ndarray = field(default_factory=lambda: np.zeros((3, 2)))
    bias: float = -LIMIT
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def emission(self, token: str) -> float:
        word, total = token.lower(), self.bias
        get = self.weights.get
        for k in PREFIXES:
            weight = get(word[:k]) if len(word) >= k else None
            # a prefix without a weight is too rare, and so are the longer ones
            if weight is None:
                break
            total += weight
        total += get(word + "$", 0.0)
        return min(LIMIT, max(-LIMIT, total))


def aggregates(p: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: 1, log of the expected toxic tokens, log of their share, log of how sure it is that there is one."""
    expected = np.bincount(owner, weights=p, minlength=n_docs)
    count = np.bincount(owner, minlength=n_docs)
    none = np.bincount(owner, weights=-np.log(np.maximum(1 - p, 1e-4)), minlength=n_docs)
    return np.stack([np.ones(n_docs), np.log1p(expected), np.log1p(1000 * expected / (count + 20)), np.log1p(none)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[DataFrame, float]:
    """The bounded training sample (text, label), and the share of toxic labels among all that may be used. Ids come to the
    driver, texts do not."""
    usable = labels.filter(~held_out(quoted(doc_id)) & quoted(label).isin(0, 1)).select(
        quoted(doc_id).cast("long").alias("doc_id"), quoted(label).cast("int").alias("label"))
    share = usable.agg(F.avg("label").alias("x")).first()["x"] or 0.0
    place = F.xxhash64(F.lit(1), "doc_id")
    body = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text")).withColumn("n", F.char_length("text"))
    whole = SAMPLE_ROWS * SAMPLE_CHARS
    sized = usable.join(body.select("doc_id", "n").filter(F.col("n").between(1, whole)).distinct(), "doc_id")
    picked = []
    for kind in (1, 0):
        found = sized.filter(F.col("label") == kind).orderBy(F.col("n") > SAMPLE_CHARS, place, "doc_id", "n").limit(SAMPLE_ROWS).collect()
        room = np.cumsum([r["n"] for r in found])
        picked += [tuple(r) for r, used in zip(found, room) if used <= whole]
    # twice SAMPLE_ROWS ids at most
    ids = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, label int, n int"))
    # ids may repeat in docs: the bound holds for rows
    texts = body.join(ids, ["doc_id", "n"]).select("doc_id", "text", "label").distinct()
    return texts.orderBy(place, "doc_id", "label", "text").limit(2 * SAMPLE_ROWS).select("text", "label"), share


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[list[tuple[str, int]], float]:
    """The sample's distinct rows in order, for those who want to look at them."""
    rows, share = sampled(docs, labels, doc_id, text, label)
    return sorted({(r["text"], r["label"]) for r in rows.collect()}), share


def distinct_documents(texts: list[list[str]]) -> list[int]:
    """Numbers of the documents that share none of four min-hashes of five-token shingles with an earlier one."""
    seen, kept = set(), []
    for i, tokens in enumerate(texts):
        grams = {zlib.crc32(" ".join(tokens[k:k + 5]).encode()) for k in range(max(1, len(tokens) - 4))}
        marks = {(j, min((g * m + 12345) % 4294967311 for g in grams)) for j, m in enumerate((2654435761, 40503, 97, 805459861))}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def lexicon(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Word and prefix features that are found in far more toxic than clean documents."""
    found = {0: Counter(), 1: Counter()}
    size = Counter()
    for i in distinct_documents(texts):
        kind = int(toxic[i])
        size[kind] += 1
        found[kind].update({f for w in set(texts[i]) for f in token_features(w) if len(f) >= LEXICON_LETTERS})
    share = size[1] / (size[0] + size[1])

    def marks(f: str, toxic_docs: int) -> bool:
        clean_docs = found[0][f]
        both = toxic_docs + clean_docs
        odds = np.log((toxic_docs + 0.5) / (size[1] + 1)) - np.log((clean_docs + 0.5) / (size[0] + 1))
        ratio = 2 * (toxic_docs * np.log(toxic_docs / (both * share)) + clean_docs * np.log(max(clean_docs, 1) / (both * (1 - share))))
        return odds >= LEXICON_ODDS and ratio >= LEXICON_RATIO

    return {f for f, n in found[1].items() if n >= LEXICON_SHARE * size[1] and marks(f, n)}


def fit(rows: list[tuple[str, int]], share: float, rounds: int = 50) -> Model:
    """Train on (text, label) rows: token labels, then the chain by gradient steps, then the document function."""
    model = Model()
    texts = [TOKEN.findall(x) for x, _ in rows]
    toxic = np.array([y for _, y in rows], int)
    model.document[0] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if not (toxic.any() and (toxic == 0).any()):
        return model
    words = sorted({w for x in texts for w in x})
    number = {w: k for k, w in enumerate(words)}
    features = [token_features(w) for w in words]
    documents = Counter(f for x in texts for f in {f for w in set(x) for f in features[number[w]]})
    names = sorted(f for f, k in documents.items() if k >= FEATURE_DOCS)
    index = {f: k for k, f in enumerate(names)}
    pairs = np.array([(k, index[f]) for k, fs in enumerate(features) for f in fs if f in index], np.int64).reshape(-1, 2)
    toxic_features = lexicon(texts, toxic)
    marked = np.array([not toxic_features.isdisjoint(fs) for fs in features])
    length = np.array([len(x) for x in texts])
    token = np.array([number[w] for x in texts for w in x], np.int64)
    owner = np.repeat(np.arange(len(texts)), length)
    first = np.zeros(len(token), bool)
    first[(np.cumsum(length) - length)[length > 0]] = True
    y = (marked[token] & (toxic[owner] == 1)).astype(int)
    before = np.where(first, 2, np.concatenate([[0], y[:-1]]))
    observed = np.bincount(before * 2 + y, minlength=6).reshape(3, 2)
    truth = np.bincount(token, weights=y, minlength=len(words))
    n = len(names)
    w = np.zeros(n + 7)
    w[-1] = -3.0
    mean, square = np.zeros(n + 7), np.zeros(n + 7)

    def emissions() -> np.ndarray:
        total = np.bincount(pairs[:, 0], weights=w[pairs[:, 1]], minlength=len(words)) + w[-1]
        return np.clip(total, -LIMIT, LIMIT)[token]

    for r in range(1, rounds + 1):
        step = steps(emissions(), first, w[n:-1].reshape(3, 2))
        alpha, beta = forward_backward(step)
        past = np.concatenate([[0.5], alpha[:-1]])
        pair = step * np.stack([(1 - past) * (1 - beta), (1 - past) * beta, past * (1 - beta), past * beta])
        pair /= pair.sum(axis=0)
        p = pair[1] + pair[3]
        start = pair[:, first].sum(axis=1)
        expected = np.array([pair.sum(axis=1) - start]).reshape(2, 2)
        slope = truth - np.bincount(token, weights=p, minlength=len(words))
        g = np.concatenate([
            np.bincount(pairs[:, 1], weights=slope[pairs[:, 0]], minlength=n),
            (observed - np.concatenate([expected, [[start[0] + start[2], start[1] + start[3]]]])).ravel(), [slope.sum()]])
        g[:-1] -= RIDGE * w[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w += 0.2 * (mean / (1 - 0.9 ** r)) / (np.sqrt(square / (1 - 0.99 ** r)) + 1e-6)
    model.weights = dict(zip(names, w[:n].tolist()))
    model.transition, model.bias = w[n:-1].reshape(3, 2), float(w[-1])
    x = aggregates(marginals(emissions(), first, model.transition), owner, len(texts))
    model.document = logistic(x, toxic)
    # the sample has more toxic rows than the labels
    base = toxic.mean()
    model.document[0] += np.log(max(share, 1e-9) / max(1 - share, 1e-9)) - np.log(base / (1 - base))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(30):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of the bounded sample, which one task learns; the driver gets the model only."""
    prepare(docs.sparkSession)
    rows, share = sampled(docs, labels, doc_id, text, label)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = {pair for batch in batches for pair in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())}
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(sorted(picked), share))]}, pa.schema([("model", pa.binary())]))

    # an empty sample may have no task
    found = rows.coalesce(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], share)


# --- scoring ----------------------------------------------------------------------------------------------------------


class Emissions(dict):
    """Emission of each token seen, forgotten when they become too many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBER:
            self.clear()
        value = self[token] = self.model.emission(token)
        return value


def spans(text: str, p: np.ndarray) -> tuple[list[int], list[int]]:
    """Code point offsets of runs of toxic tokens."""
    starts, ends, last = [], [], False
    for m, on in zip(TOKEN.finditer(text), p >= 0.5):
        if on and last:
            ends[-1] = m.end()
        elif on:
            starts.append(m.start())
            ends.append(m.end())
        last = on
    return starts, ends


def score_texts(texts: list[str], emissions: Emissions):
    """Scores, token counts, expected toxic tokens and spans of a block of texts."""
    values, length = [], np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        tokens = TOKEN.findall(x) if len(x) < 1 << 20 else (m.group() for m in TOKEN.finditer(x))
        one = np.fromiter(map(emissions.__getitem__, tokens), np.float64)
        values.append(one)
        length[i] = len(one)
    emission = np.concatenate(values)
    start = np.cumsum(length) - length
    first = np.zeros(len(emission), bool)
    first[start[length > 0]] = True
    p = marginals(emission, first, emissions.model.transition)
    owner = np.repeat(np.arange(len(texts)), length)
    x = aggregates(p, owner, len(texts))
    found = [([], [])] * len(texts)
    for i in set(owner[p >= 0.5].tolist()):
        found[i] = spans(texts[i], p[start[i]:start[i] + length[i]])
    return sigmoid(x @ emissions.model.document), length, np.expm1(x[:, 1]), found


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_tokens, toxic_tokens (expected) and the spans' code point offsets, for every row."""
    prepare(docs.sparkSession)
    # a sample's features: bounded like the sample
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        for batch in batches:
            for part, texts in blocks(batch, limit=2_000_000):
                values, length, expected, found = score_texts(texts, emissions)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(values), pa.array(length), pa.array(expected),
                    pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([b for _, b in found], pa.list_(pa.int64())),
                ], ["doc_id", "score", "n_tokens", "toxic_tokens", "span_starts", "span_ends"])

    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return source.mapInArrow(batches_of, SCHEMA)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; all of them if the model has learned nothing."""
    prepare(docs.sparkSession)
    if not model.weights:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        for batch in batches:
            for part, texts in blocks(batch, limit=2_000_000):
                values = score_texts(texts, emissions)[0]
                yield pa.RecordBatch.from_arrays([part.column("row").filter(pa.array(values < threshold))], ["row"])

    rows = docs.select(packed(docs).alias("row"), quoted(text).cast("string").alias("text"))
    return unpacked(rows.mapInArrow(keep, rows.select("row").schema), docs.columns, {})
