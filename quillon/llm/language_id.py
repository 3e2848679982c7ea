"""Language ID: a linear-chain conditional random field labels each word of code-switched text.

Emission scores are sums of weights of hashed features of the word: prefixes and suffixes, character n-grams, membership in
the languages' lexicons. Transition weights between the labels of neighbouring words are learned with them, by
the likelihood's gradient from forward-backward, on sequences put together from stretches of different languages.
Prediction runs forward-backward over all words of a document, all documents of a batch side by side; the posteriors
averaged over its words are the document's language shares.

The model is fitted on a bounded sample: PER_LANGUAGE documents of each language at most and WINDOWS stretches of
STRETCH words of each, chosen by hash from the whole text. Everything else is done on whole texts of all documents.

Defined results: text that is null or has no letter is `und` with score 0. Words without a letter take part with no
emission. Without any labelled document everything is `und`. Repeated rows are labelled row by row. Ties go to the
language that sorts first. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, frugal, mixed, pieces, spans, stored, table, texts

PER_LANGUAGE = 400
WINDOWS = 4
STRETCH = 30
FEATURES = 1 << 16
LEXICON = 3000  # words of a language's lexicon at most
STEPS, BATCH, RATE, DECAY = 240, 128, 0.08, 1e-6
WORDS_KEPT = 400_000  # words whose emissions a process remembers
STEP = 4 << 20


# --- features ------------------------------------------------------------------------------------------------------


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, one after another, and where each word's begin. Letters only count in lower case."""
    marked = ["^" + w.lower() + "$" for w in words]
    n = np.array([len(m) for m in marked], np.int64)
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(U64)
    begin = np.cumsum(n) - n
    word = np.repeat(np.arange(len(words)), n)
    found, of = [], []

    def add(feature: np.ndarray, owner: np.ndarray, kind: int) -> None:
        found.append(mixed(feature * U64(64) + U64(kind)) % U64(FEATURES - 1) + U64(1))
        of.append(owner)

    gram = np.zeros(len(letters), U64)
    for size in range(1, 5):
        at = np.arange(len(letters) - size + 1) if len(letters) >= size else np.zeros(0, np.int64)
        gram = gram[: len(at)] * U64(1_000_003) + letters[size - 1 : size - 1 + len(at)]
        inside = word[at] == word[at + size - 1] if len(at) else np.zeros(0, bool)
        if size >= 2:
            add(gram[inside], word[at[inside]], size)
        long_enough = n >= size + 1
        if size >= 2:  # ^ and $ make these prefixes and suffixes of size - 1 letters
            add(gram[begin[long_enough]], np.flatnonzero(long_enough), 16 + size)
            add(gram[begin[long_enough] + n[long_enough] - size], np.flatnonzero(long_enough), 24 + size)
    known = np.array([lexicon.get(m, 0) for m in marked], np.int64)
    there = np.flatnonzero(known)
    add(known[there].astype(U64), there, 40)
    feature, owner = np.concatenate(found).astype(np.int64), np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def emissions(words: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    if not words:
        return np.zeros((0, weights.shape[1]))
    feature, begin = word_features(words, lexicon)
    return np.add.reduceat(weights[feature], begin[:-1], 0) / np.sqrt(np.diff(begin))[:, None]


# --- the chain -----------------------------------------------------------------------------------------------------


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of every position, expected transitions per pair of labels, and log Z of each chain.

    scores: chains one after another, lengths[i] rows each. Chains run side by side, the longest first.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    length = lengths[order]
    top = scores.max(1, keepdims=True) if len(scores) else scores[:, :1]
    e, t = np.exp(scores - top), np.exp(transitions)
    alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones(len(e))
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), "left")  # chains longer than each step
    for i in range(steps):
        at = start[: live[i]] + i
        a = e[at] if not i else (alpha[at - 1] @ t) * e[at]
        c = a.sum(1)
        alpha[at], scale[at] = a / c[:, None], c
    pairs = np.zeros_like(t)
    for i in range(steps - 2, -1, -1):
        at = start[: live[i + 1]] + i
        b = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = b @ t.T
        pairs += alpha[at].T @ b
    log_z = np.add.reduceat(np.append(np.log(scale) + top[:, 0], 0.0), np.append(np.cumsum(lengths) - lengths, len(e)))[:-1] * (lengths > 0)
    return alpha * beta, pairs * t, log_z


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: dict[str, int]):
        self.languages, self.weights, self.transitions, self.lexicon = languages, weights, transitions, lexicon
        self._known: dict[str, int] = {}
        self._scores = np.zeros((0, len(languages)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_scores": self._scores[:0]}

    def scores(self, words: list[str]) -> np.ndarray:
        """Emissions of words; those of a new word are worked out once."""
        if len(self._known) > WORDS_KEPT:
            self._known, self._scores = {}, self._scores[:0]
        known = self._known
        at = list(map(known.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None))
            lettered = np.array([has_letter(w) for w in new])
            s = np.zeros((len(new), len(self.languages)))
            s[lettered] = emissions([w for w, x in zip(new, lettered, strict=True) if x], self.weights, self.lexicon)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._scores = np.concatenate([self._scores, s])
            at = list(map(known.__getitem__, words))
        return self._scores[np.array(at, np.int64)] if words else self._scores[:0]

    def label(self, documents: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words of all documents, and the number of words of each document. Words are cut at white space."""
        words = [(t or "").split() for t in documents]
        lengths = np.array([len(w) for w in words], np.int64)
        scores = self.scores([w for x in words for w in x])
        return forward_backward(scores, lengths, self.transitions)[0], lengths

    def shares(self, documents: list[str | None]) -> np.ndarray:
        """A row of language shares per document; zeros where there is no letter."""
        posterior, lengths = self.label(documents)
        begin = np.cumsum(lengths) - lengths
        sums = np.add.reduceat(np.concatenate([posterior, np.zeros((1, posterior.shape[1]))]), np.append(begin, len(posterior)), 0)[:-1]
        some = np.array([n > 0 and has_letter(t) for n, t in zip(lengths, documents, strict=True)], bool)
        return sums * some[:, None] / np.maximum(lengths, 1)[:, None]


# --- learning ------------------------------------------------------------------------------------------------------


def loss_and_gradient(weights, transitions, words, gold, lengths, feature, begin) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the log likelihood of the gold labels of chains of words (numbers; -1 has no emission), and its gradient by weights and by
    transitions. The features of word w are feature[begin[w]:begin[w + 1]]."""
    size = np.diff(begin)
    some, at = np.unique(words[words >= 0], return_inverse=True)
    features = feature[spans(begin[some], size[some])]
    first = np.cumsum(size[some]) - size[some]
    norm = 1 / np.sqrt(size[some])
    scores = np.zeros((len(words), weights.shape[1]))
    if len(some):
        scores[words >= 0] = (np.add.reduceat(weights[features], first, 0) * norm[:, None])[at]
    posterior, pairs, log_z = forward_backward(scores, lengths, transitions)
    inner = np.ones(len(gold) - 1, bool)
    inner[np.cumsum(lengths)[:-1] - 1] = False
    before, after = gold[:-1][inner], gold[1:][inner]
    loss = log_z.sum() - scores[np.arange(len(gold)), gold].sum() - transitions[before, after].sum()
    error = posterior
    error[np.arange(len(gold)), gold] -= 1
    per_word = np.zeros((len(some), weights.shape[1]))
    np.add.at(per_word, at, error[words >= 0])
    grad = np.zeros_like(weights)
    np.add.at(grad, features, np.repeat(per_word * norm[:, None], size[some], 0))
    seen = np.zeros_like(transitions)
    np.add.at(seen, (before, after), 1)
    return float(loss), grad, pairs - seen


def fit(stretches: list[tuple[str, list[str]]], seed: int = 1) -> Model:
    """From (language, words): sequences of one to four stretches, cut at random, so that labels change within a sequence."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in stretches})
    k = len(languages)
    counts = {lang: Counter("^" + w.lower() + "$" for x, ws in stretches if x == lang for w in ws) for lang in languages}
    lexicon: dict[str, int] = {}
    for i, lang in enumerate(languages):  # words at least four times as frequent as in all other languages together
        others = Counter()
        for x in languages:
            if x != lang:
                others.update({w: n for w, n in counts[x].items() if w in counts[lang]})
        lexicon.update((w, i + 1) for w, n in counts[lang].most_common(LEXICON) if n >= 3 and n >= 4 * others[w])
    vocabulary = sorted({w for _, ws in stretches for w in ws})
    lettered = [w for w in vocabulary if has_letter(w)]
    number = {w: i for i, w in enumerate(lettered)}
    feature, begin = word_features(lettered, lexicon) if lettered else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    by_language = [[np.array([number.get(w, -1) for w in ws]) for x, ws in stretches if x == lang] for lang in languages]
    weights, transitions = np.zeros((FEATURES, k)), np.zeros((k, k))
    square_w, square_t = np.full((FEATURES, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(STEPS if k > 1 else 0):
        chain, gold, lengths = [], [], []
        for _ in range(BATCH):
            n = 0
            for lang in rng.permutation(k)[: rng.integers(1, min(k, 4) + 1)]:
                ws = by_language[lang][rng.integers(len(by_language[lang]))]
                a = rng.integers(len(ws))
                part = ws[a : a + rng.integers(1, len(ws) + 1)]
                chain.append(part)
                gold.append(np.full(len(part), lang))
                n += len(part)
            lengths.append(n)
        _, grad, grad_t = loss_and_gradient(weights, transitions, np.concatenate(chain), np.concatenate(gold), np.array(lengths), feature, begin)
        grad = grad / BATCH + DECAY * weights
        grad_t = grad_t / BATCH
        square_w += grad**2
        square_t += grad_t**2
        weights -= RATE * grad / np.sqrt(square_w)
        transitions -= RATE * grad_t / np.sqrt(square_t)
    return Model(languages, weights.astype(np.float32), transitions, lexicon)


def sample_stretches(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, stretch: int = STRETCH) -> list[tuple[str, list[str]]]:
    """Stretches of words from a bounded sample of docs(doc_id, text, lang); at most per_language * windows of a language, or so."""
    labelled = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null")
    # Stored, so that its size is known: a list of languages of usual length is broadcast, and no text is shuffled to meet it.
    counts = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "of"))
    dice = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    chosen = labelled.join(counts, F.col("lang") == F.col("of")).where(dice * F.col("n") < per_language * 1_000_000)
    # Rows that share an id are chosen together: of these, one text of each language will do.
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                words = text.split()
                n = len(words)
                for i in range(windows if n else 0):
                    at = int(mixed(np.array([(doc_id or 0) & (2**63 - 1)], U64) * U64(windows) + U64(i))[0] % U64(max(1, n - stretch + 1)))
                    out.append((lang, " ".join(words[at : at + stretch])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["lang", "words"])

    rows = chosen.select("doc_id", "lang", "text").mapInArrow(cut, "lang string, words string").toArrow()
    return sorted((lang, words.split()) for lang, words in zip(rows["lang"].to_pylist(), rows["words"].to_pylist(), strict=True))


def predict(docs: DataFrame, model: Model, spans_too: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with spans_too also spans: stretches of words of one language, (lang, first, last)."""
    more = ", spans array<struct<lang: string, first: long, last: long>>" if spans_too else ""
    if not model.languages:
        none = [F.lit(None).cast("array<struct<lang: string, first: long, last: long>>").alias("spans")] if spans_too else []
        return texts(docs).select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *none)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for big in batches:
            for batch in pieces(big, STEP):
                documents = batch.column("text").to_pylist()
                shares = m.shares(documents)
                best, score = shares.argmax(1), shares.max(1)
                out = [batch.column("doc_id"), pa.array([m.languages[b] if s > 0 else "und" for b, s in zip(best, score, strict=True)]), pa.array(np.minimum(score, 1.0))]
                if spans_too:
                    posterior, lengths = m.label(documents)
                    label, at, all_spans = posterior.argmax(1), 0, []
                    for n in lengths.tolist():
                        own = label[at : at + n]
                        edge = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if n else np.zeros(0, int)
                        all_spans.append([{"lang": m.languages[own[a]], "first": int(a), "last": int(b - 1)} for a, b in zip(edge[:-1], edge[1:], strict=True)])
                        at += n
                    out.append(pa.array(all_spans, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "spans"][: len(out)])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double" + more)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(sample_stretches(texts(documents, "lang").where(~held_out)))
    return predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": (op1_language_id, None)}
