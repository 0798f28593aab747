"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (3 to 5,
with word ends, hashed to BUCKETS), so a misspelling never met shares most of
its n-grams with words that were. A window of WINDOW words is the mean over
its places; a word said again, like a place past the end of the text, adds
nothing. A linear softmax on it gives two classes. Embeddings and softmax are
trained together by Adam. A label says that a document is toxic somewhere: in
the first round every window bears its document's label, in later rounds a
toxic document is stood for by its highest window, a clean one by all of its
windows; as these are many more, toxic windows weigh `lift` times as much. A document scores as its highest window does, over its whole text.

Training takes at most `per_class` labelled documents of each class, those with
the smallest hashes of doc_id (whole texts); scoring takes every document. As
the model is linear, executors need one number a bucket: 512 KB are broadcast.

Defined cases: a null or empty text scores as the bias alone; a null doc_id is
scored and not held out; of labels that disagree on a document the larger
counts, null labels do not; without labelled rows of both classes every score
is the share of toxic rows (0 without any); repeated rows are scored each; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, words_of
from .tokenizing import WordEncoder

BUCKETS, WINDOW, DIMS = 1 << 17, 64, 4
_EDGES = ".,;:!?%&#$*()[]{}<>\"'|`~^=+_-/\\"


@dataclass
class Model:
    """The trained classifier reduced to what scoring needs."""

    by_bucket: np.ndarray
    bias: float
    slice_bytes: int = 2 << 20


def gram_ids(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the words, and for each the number of its word."""
    closed = ["<" + w + ">" for w in words.to_pylist()]
    codes = np.frombuffer("".join(closed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, closed), dtype=np.int64, count=len(closed))
    owner = np.repeat(np.arange(len(closed)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the word's end
    h, ids, owners = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, 6):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] if len(codes) >= n else h[:0]
        if n >= 3:
            at = np.flatnonzero(left[: len(h)] >= n)
            ids.append(((h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)).astype(np.int32))
            owners.append(owner[at])
    return np.concatenate(ids), np.concatenate(owners)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words without the marks around them, each word's code in order, and the texts' offsets."""
    flat = pc.utf8_lower(pc.replace_substring(texts, "\n", " "))
    words, codes, offsets = words_of(flat)
    trimmed = pc.utf8_trim(words, characters=_EDGES).dictionary_encode()
    codes = trimmed.indices.to_numpy(zero_copy_only=False)[codes]
    names = trimmed.dictionary
    keep = pc.greater(pc.utf8_length(names), 0).to_numpy(zero_copy_only=False)[codes]  # without empty words
    return names, codes[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def bags(codes: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each window of consecutive words: windows, words, and each text's offsets in the windows.

    A text without words has no window. A word said over and over fills its window no more than once.
    """
    n = np.diff(offsets)
    first = np.concatenate(([0], np.cumsum(-(-n // size))))
    window = np.repeat(first[:-1] - (offsets[:-1] // size), n)
    window += (np.arange(len(codes)) - np.repeat(offsets[:-1] % size, n)) // size
    pairs = np.unique(window.astype(np.int64) << 32 | codes.astype(np.int64))
    return pairs >> 32, pairs & 0xFFFFFFFF, first


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1 of each text."""
    names, codes, offsets = split_words(texts)
    ids, owner = gram_ids(names)
    counts = np.maximum(np.bincount(owner, minlength=len(names)), 1)
    by_word = np.bincount(owner, weights=model.by_bucket[ids], minlength=len(names)) / counts
    window, word, first = bags(codes, offsets)
    logits = np.bincount(window, weights=by_word[word], minlength=first[-1]) / WINDOW + model.bias
    out = np.full(len(texts), model.bias)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(logits, first[some])
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[str], labels: np.ndarray, rounds: int = 3, steps: int = 100, rate: float = 0.05, batch: int = 512, seed: int = 7, damp: float = 1e-6, lift: float = 3.0) -> Model:
    """Fit embeddings and softmax together on whole texts."""
    if not len(labels) or labels.min() == labels.max():
        share = float(np.mean(labels)) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-13)) - np.log(max(1 - share, 1e-13))))
    rng = np.random.default_rng(seed)
    names, codes, offsets = split_words(pa.array(texts, pa.large_string()))
    ids, owner = gram_ids(names)
    order = np.argsort(owner, kind="stable")
    ids, n_grams = ids[order], np.bincount(owner, minlength=len(names))
    word_first = np.concatenate(([0], np.cumsum(n_grams)))
    window, bag, first = bags(codes, offsets)
    starts = np.searchsorted(window, np.arange(first[-1]))
    ends = np.append(starts[1:], len(bag))
    of_text = np.repeat(np.arange(len(texts)), np.diff(first))
    target = labels[of_text].astype(np.float64)
    e = rng.uniform(-0.01, 0.01, (BUCKETS, DIMS)).astype(np.float32)
    w = np.vstack([np.linspace(-1, 1, DIMS), np.linspace(1, -1, DIMS)]).astype(np.float64) * 2
    b = np.zeros(2)
    params, state, step = [e, w, b], [[0.0, 0.0] for _ in range(3)], 0

    def flat(some):
        """n-gram ids of windows, each one's window, and its share of the window's mean."""
        n_words = ends[some] - starts[some]
        at = np.repeat(starts[some] - np.concatenate(([0], np.cumsum(n_words)[:-1])), n_words) + np.arange(n_words.sum())
        words, win = bag[at], np.repeat(np.arange(len(some)), n_words)
        n = n_grams[words]
        pos = np.repeat(word_first[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return ids[pos], np.repeat(win, n), np.repeat(1 / (WINDOW * np.maximum(n, 1)), n)

    def vectors(some):
        g, win, share = flat(some)
        return np.stack([np.bincount(win, weights=e[g, d] * share, minlength=len(some)) for d in range(DIMS)], axis=1), (g, win, share)

    use = np.arange(len(starts))
    for r in range(rounds):
        if r:
            top = np.concatenate([vectors(some)[0] @ (w[1] - w[0]) for some in np.array_split(np.arange(len(starts)), max(1, len(starts) // 4096))])
            best = np.lexsort((-top, of_text))
            best = best[np.unique(of_text[best], return_index=True)[1]]
            use = np.union1d(np.flatnonzero(target == 0), best[target[best] == 1])
        epochs = max(2, -(-steps * batch // len(use)))
        for _ in range(epochs):
            rng.shuffle(use)
            for a in range(0, len(use), batch):
                some = use[a : a + batch]
                x, (g, win, share) = vectors(some)
                z = x @ w.T + b
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = (p - np.stack([1 - target[some], target[some]], axis=1)) * np.where(target[some] == 1, lift, 1.0)[:, None] / len(some)
                back = d @ w
                grads = [np.stack([np.bincount(g, weights=back[win, k] * share, minlength=BUCKETS) for k in range(DIMS)], axis=1), d.T @ x, d.sum(axis=0)]
                step += 1
                for k, (param, grad) in enumerate(zip(params, grads, strict=True)):
                    m, v = state[k]
                    state[k] = [m, v] = [0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2]
                    param -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + damp)).astype(param.dtype)
    return Model((e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Column, per_class: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most per_class documents of each class among the labels that `use` admits."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & use).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*by_hash).limit(per_class).unionByName(known.where("label = 1").orderBy(*by_hash).limit(per_class))
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").collect()
    rows = sorted({r.doc_id: r for r in sorted(rows, key=lambda r: (r.doc_id, r.text))}.values(), key=lambda r: r.doc_id)
    return [r.text for r in rows], np.array([r.label for r in rows], dtype=np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for at, n in WordEncoder.slices(m, batch.column("text")):
                values = score_texts(batch.column("text").slice(at, n), m)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(values, pa.float64())], names=["doc_id", "score"])
        give_back()

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the crc32 of doc_id as text is divisible by folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """The model of the rows that are not held out."""
    return train(*labelled_sample(docs, labels, ~held_out(F.col("doc_id")), per_class))


def judge(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5)."""
    scored = score(docs, fit(docs, labels, per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """docs, all columns, without those predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            keep = [score_texts(texts.slice(at, n), model.value) < 0.5 for at, n in WordEncoder.slices(model.value, texts)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))
        give_back()

    return docs.mapInArrow(run, schema)
