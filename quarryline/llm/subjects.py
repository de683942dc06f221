"""The subjects of each document (p9): one-versus-rest linear classifiers over hashed word n-grams of sentences.

The words that form n-grams, and those that mend misspelt ones, are counted over all documents. Fitting takes a bounded sample
(``SAMPLE_LABELLED`` labelled documents, chosen by a hash of their id). The human judgments of a document are weak labels of
all its sentences; the classifiers' own judgments of whole documents, then of single sentences, replace them in further rounds.
Every document of the corpus is then scored once: a subject's score is that of the document's second best sentence, as a subject
holds if at least two sentences deal with it. Thresholds are calibrated over all labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.overlap import Speller
from quarryline.session import cut, first_delivery

WIDTH = 1 << 18
SAMPLE_LABELLED = 2000
GRID = (-1.0, -0.5, 0.0, 0.5, 1.0)  # thresholds tried
WORD_SHARE = 4e-5  # of all words; a word below it forms no n-gram, so at most 1 / WORD_SHARE words do
FALLBACK = "software"
LEAST_SENTENCES = 2
RARE, BREAK = -1, -2

_TAG = re.compile(r"<[^<>]{1,80}>")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(f"{_WORD.pattern}|{_SENTENCE.pattern}")  # words, and what parts sentences
_HUMP = re.compile(r"(?<=[a-zß-ÿ0-9])(?=[A-ZÀ-Þ])")
_MARKS = re.compile("[̀-ͯ]")


def _repaired(text: str) -> str:
    """Undoes UTF-8 that was read as Latin-1, word by word."""

    def fix(m: re.Match) -> str:
        try:
            return m.group().encode("cp1252").decode("utf-8")
        except UnicodeError:
            return m.group()

    return re.sub(r"[ÃÂ][\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]", fix, text) if "Ã" in text or "Â" in text else text


_word_memo: dict[str, str] = {}


def _plain(word: str) -> str:
    if word not in _word_memo:
        if len(_word_memo) > 300_000:
            _word_memo.clear()
        w = _MARKS.sub("", unicodedata.normalize("NFD", word.lower().replace("ß", "ss")))
        _word_memo[word] = w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w
    return _word_memo[word]


def _tidy(text: str) -> str:
    text = _repaired(text)
    return _TAG.sub(" ", text) if "<" in text else text


def _sentence_words(text: str | None) -> Iterator[list[str]]:
    """The words of each sentence as they are written."""
    for sentence in _SENTENCE.split(_tidy(text or "")):
        words = _WORD.findall(sentence)
        if words:
            yield words


def sentences(text: str | None) -> Iterator[list[str]]:
    """The words of each sentence: code identifiers apart, case, accents and a plural's s dropped."""
    for words in _sentence_words(text):
        yield [_plain(p) for w in words for p in _HUMP.split(w)]


def _index(gram: str) -> int:
    return xxhash.xxh32_intdigest(gram) % WIDTH


class Vocabulary(dict):
    """From a word as it is written to its number among the corpus's frequent words; rare words are mended to a frequent one or
    are ``RARE``, so they take part in no n-gram. What parts sentences is ``BREAK``; a word of several parts is ``BREAK - 1``
    less the place of their numbers in ``several``."""

    def __init__(self, frequent: dict[str, int]):
        self.speller, self.words = Speller(frequent), sorted(frequent)
        self.numbers = {w: i for i, w in enumerate(self.words)}
        self.several: dict[tuple[int, ...], int] = {}

    def __missing__(self, raw: str) -> int:
        if raw.isspace():
            found = BREAK
        else:
            parts = tuple(self.numbers.get(self.speller.mend(_plain(p)), RARE) for p in _HUMP.split(raw))
            found = parts[0] if len(parts) == 1 else BREAK - 1 - self.several.setdefault(parts, len(self.several))
        if len(self) < 500_000:
            self[raw] = found
        return found


def _numbered(texts, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each sentence, where it starts among the words, numbers of all words); empty sentences are left out."""
    codes, ends, get = [], [], vocabulary.__getitem__
    for text in texts:
        if text:
            codes.extend(map(get, _PIECE.findall(_tidy(text))))
        ends.append(len(codes))
    numbers, owner = np.array(codes, int), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    joint = numbers < BREAK
    if joint.any():
        every = list(vocabulary.several)
        parts = [every[BREAK - 1 - c] for c in numbers[joint].tolist()]
        lengths = np.ones(len(numbers), int)
        lengths[joint] = [len(p) for p in parts]
        numbers, owner = np.repeat(numbers, lengths), np.repeat(owner, lengths)
        numbers[np.repeat(joint, lengths)] = list(chain.from_iterable(parts))
    words = numbers != BREAK
    sentence = np.cumsum(~words)[words]
    numbers, owner = numbers[words], owner[words]
    starts = np.flatnonzero((np.diff(sentence, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    return owner[starts], starts, numbers


def _gram_columns(starts: np.ndarray, numbers: np.ndarray, vocabulary: Vocabulary, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, hashed column) of every n-gram of one and of two known words."""
    n = len(vocabulary.words)
    if not len(numbers) or not n:
        return np.zeros(0, int), np.zeros(0, int)
    sentence = np.searchsorted(starts, np.arange(len(numbers)), side="right") - 1
    if "unigram" not in memo:
        memo["unigram"] = np.array([_index(w) for w in vocabulary.words])
    known = numbers >= 0
    both = known[:-1] & known[1:] & (sentence[:-1] == sentence[1:])
    keys, where = np.unique(numbers[:-1][both] * n + numbers[1:][both], return_inverse=True)
    pairs = memo.setdefault("pairs", {})
    if len(pairs) > 2_000_000:
        pairs.clear()
    columns = np.empty(len(keys), int)
    for i, key in enumerate(keys.tolist()):
        column = pairs.get(key)
        if column is None:
            column = pairs[key] = _index(f"{vocabulary.words[key // n]} {vocabulary.words[key % n]}")
        columns[i] = column
    rows = np.concatenate([sentence[known], sentence[:-1][both]])
    grams = np.concatenate([memo["unigram"][numbers[known]], columns[where] if len(keys) else np.zeros(0, int)])
    return rows, grams


def tidy_subject(column: Column) -> Column:
    return F.lower(F.trim(column))


def judged(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """``doc_id, subjects``: the subjects that at least half of a document's annotators gave it."""
    once = first_delivery(labels, "label_id", ["labelled_at"]).select("doc_id", tidy_subject(F.col("subject")).alias("subject"), "labelled_by").where(F.col("subject").isin(*subjects) & F.col("doc_id").isNotNull())
    votes = once.groupBy("doc_id", "subject").agg(F.countDistinct("labelled_by").alias("n"))
    people = once.groupBy("doc_id").agg(F.countDistinct("labelled_by").alias("people"))
    kept = votes.join(people, "doc_id").where(F.col("n") * 2 >= F.col("people"))
    return kept.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))


def _fit(rows: np.ndarray, grams: np.ndarray, y: np.ndarray, ridge: float, steps: int = 40, rate: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L2-regularised logistic regressions by AdaGrad over the whole sample, a column of ``y`` each: (n-grams, weights,
    biases). N-grams that stand fewer than three times are left out; ``rows`` is sorted."""
    n, k = y.shape
    used, at = np.unique(grams, return_inverse=True)
    often = np.bincount(at) >= 3 if len(at) else np.zeros(0, bool)
    keep = often[at] if len(at) else np.zeros(0, bool)
    used, rows, at = used[often], rows[keep], (np.cumsum(often) - 1)[at[keep]]
    if not len(at):
        return used, np.zeros((0, k), np.float32), np.full(k, -20.0)
    weights, biases = np.zeros((len(used), k)), np.full(k, -20.0)
    for j in np.flatnonzero(y.any(axis=0)):
        w, bias, sums, bias_sum = np.zeros(len(used)), -2.0, np.full(len(used), 1e-12), 1e-12
        own = y[:, j].astype(float)
        for _ in range(steps):
            z = np.bincount(rows, w[at], minlength=n) + bias
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - own
            grad = (np.bincount(at, g[rows], minlength=len(used)) + ridge * w) / n
            sums += grad**2
            w -= rate * grad / np.sqrt(sums)
            total = g.mean()
            bias_sum += total**2
            bias -= rate * total / np.sqrt(bias_sum)
        weights[:, j], biases[j] = w, bias
    return used, weights, biases


# Rounds of training: where the labels come from, and how strongly weights are held back.
ROUNDS = (("document", 1.2), ("sentence", 0.5), ("sentence", 0.2))
TASKS = 4  # each trains a share of the subjects
_CHUNK = "docs array<long>, human array<int>, rows array<int>, grams array<int>"


def _unpacked(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: document and human labels (bits) of each sentence, sentence of each n-gram, n-grams."""
    return np.asarray(chunk.docs), np.asarray(chunk.human, int), np.asarray(chunk.rows, int), np.asarray(chunk.grams, int)


def _summed(rows: np.ndarray, grams: np.ndarray, n: int, weights: Weights) -> np.ndarray:
    """A row of scores per sentence."""
    out = np.repeat(weights.biases[None, :].astype(np.float32), n, axis=0)
    used = weights.used[grams]
    rows, grams = rows[used], grams[used]  # most n-grams weigh nothing
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(rows, weights.table[grams, k], minlength=n)
    return out


def _scored(chunk, weights: Weights) -> np.ndarray:
    docs, _, rows, grams = _unpacked(chunk)
    return _summed(rows, grams, len(docs), weights)


def _weak_labels(chunk, level: str, weights: Weights) -> np.ndarray:
    """The subjects for which each sentence counts as positive, as bits."""
    docs, human, _, _ = _unpacked(chunk)
    if level == "document":
        return human
    scores = _scored(chunk, weights)
    held = (scores > 0) & (scores >= scores.max(axis=1, keepdims=True))  # the subject it deals with most
    return held @ (1 << np.arange(held.shape[1]))


_LABELLED = "labels array<int>, rows array<int>, grams array<int>"


def _train(chunks: DataFrame, level: str, ridge: float, subjects: list[str], weights: Weights) -> Weights:
    """One-versus-rest classifiers over the bounded sample; labels are made once, then each task fits some of the subjects."""
    tasks = min(TASKS, len(subjects))
    before = chunks.sparkSession.sparkContext.broadcast(weights)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(_weak_labels(c, level, before.value), c.rows, c.grams) for c in batch.itertuples()], columns=["labels", "rows", "grams"])

    each = chunks.mapInPandas(label, _LABELLED).withColumn("part", F.explode(F.array(*map(F.lit, range(tasks)))))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = list(range(key[0], len(subjects), tasks))
        parts, n = [], 0
        for chunk in pdf.itertuples():
            labels = np.asarray(chunk.labels, int)
            parts.append((np.asarray(chunk.rows, int) + n, np.asarray(chunk.grams, int), (labels[:, None] >> np.array(own)) & 1 == 1))
            n += len(labels)
        rows, grams, y = map(np.concatenate, zip(*parts))
        used, found, bias = _fit(rows, grams, y, ridge)
        keep = [np.abs(found[:, i]) > 0.05 for i in range(len(own))]
        return pd.DataFrame({"subject": own, "bias": bias, "at": [used[m].astype(np.int32) for m in keep], "weight": [found[m, i].astype(np.float32) for i, m in enumerate(keep)]})

    made = each.groupBy("part").applyInPandas(fit, "subject int, bias double, at array<int>, weight array<float>")
    table, biases = np.zeros((WIDTH, len(subjects)), np.float32), np.full(len(subjects), -20.0)
    for r in made.collect():  # as many rows as subjects, each at most WIDTH numbers
        table[np.asarray(r["at"], int), r["subject"]] = r["weight"]
        biases[r["subject"]] = r["bias"]
    before.destroy()
    used = np.flatnonzero(table.any(axis=1))
    return Weights(used, table[used], biases)


class Weights:
    """Weights and biases by subject; it travels with the rows that aren't zero and unfolds where it is used."""

    def __init__(self, at: np.ndarray, values: np.ndarray, biases: np.ndarray):
        self.at, self.values, self.biases = at.astype(np.int32), values.astype(np.float32), biases
        self._table: np.ndarray | None = None
        self._used: np.ndarray | None = None

    @classmethod
    def none(cls, n: int) -> Weights:
        return cls(np.zeros(0, np.int32), np.zeros((0, n), np.float32), np.full(n, -20.0))

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros((WIDTH, len(self.biases)), np.float32)
            self._table[self.at] = self.values
        return self._table

    @property
    def used(self) -> np.ndarray:
        if self._used is None:
            self._used = np.zeros(WIDTH, bool)
            self._used[self.at] = True
        return self._used

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None, "_used": None}


class Model:
    """Weights by hashed n-gram, and the spelling of the corpus's frequent words."""

    def __init__(self, subjects: list[str], weights: Weights, frequent: dict[str, int]):
        self.subjects, self.weights, self.frequent = subjects, weights, frequent
        self._vocabulary: Vocabulary | None = None
        self._memo: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_vocabulary": None, "_memo": {}}

    def columns(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each sentence, sentence of each n-gram, n-grams)."""
        if self._vocabulary is None:
            self._vocabulary = Vocabulary(self.frequent)
        owner, starts, numbers = _numbered(texts, self._vocabulary)
        return (owner, *_gram_columns(starts, numbers, self._vocabulary, self._memo))

    def scores(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(whether a text has any word, a row per text with each subject's score of its second best sentence)."""
        owner, rows, grams = self.columns(texts)
        by_sentence = _summed(rows, grams, len(owner), self.weights)
        starts = np.searchsorted(owner, np.arange(len(texts)))
        ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
        out = np.full((len(texts), len(self.subjects)), -99.0, np.float32)
        several = np.flatnonzero(ends - starts >= LEAST_SENTENCES)
        for i in several.tolist():
            out[i] = np.partition(by_sentence[starts[i] : ends[i]], -LEAST_SENTENCES, axis=0)[-LEAST_SENTENCES]
        return ends > starts, out


def frequent_words(documents: DataFrame) -> dict[str, int]:
    """How often each word stands in the corpus, of those that make up at least ``WORD_SHARE`` of all its words."""
    raw = documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(_plain(p), n) for w, n in zip(batch.w, batch.n) for p in _HUMP.split(w)]
            yield pd.DataFrame(rows, columns=["w", "n"])

    counts = cut(raw.mapInPandas(plain, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["w"]: r["n"] for r in counts.where(F.col("n") >= max(3, WORD_SHARE * total)).collect()}


def train(documents: DataFrame, human: DataFrame, others: list[str]) -> Model:
    """Fits the classifiers of the subjects ``others`` on the sample of the documents in ``human`` (``doc_id, subjects``)."""
    frequent = frequent_words(documents)
    ids = documents.select("doc_id").where("doc_id is not null").distinct()
    # the sampled ids are as few as the bound, whatever the corpus holds
    chosen = cut(human.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(7), "doc_id")).limit(SAMPLE_LABELLED))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(12, "doc_id")
    bits = {s: 1 << i for i, s in enumerate(others)}
    model = Model(others, Weights.none(len(others)), frequent)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, found, grams = model.columns(batch.text.tolist())
            labels = np.array([sum(bits.get(x, 0) for x in s) for s in batch.subjects], int)
            yield pd.DataFrame({"docs": [batch.doc_id.to_numpy()[owner]], "human": [labels[owner]], "rows": [found], "grams": [grams]})

    chunks = cut(rows.mapInPandas(pack, _CHUNK))
    weights = model.weights
    if not chunks.where("size(docs) > 0").isEmpty():
        for level, ridge in ROUNDS:
            weights = _train(chunks, level, ridge, others, weights)
    return Model(others, weights, frequent)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, some, scores`` of every document: whether it has a word, and each subject's score. Texts stay where they are
    read: nothing but the model (a table of fixed width) moves."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, scores = shared.value.scores(batch.text.tolist())
            yield pd.DataFrame({"doc_id": batch.doc_id, "some": some, "scores": list(scores)})

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(judge, "doc_id long, some boolean, scores array<float>")


def thresholds(scores: DataFrame, human: DataFrame, others: list[str]) -> dict[str, float]:
    """Each subject's threshold with the best F1 against the human labels of all labelled documents; 0 unless another is
    clearly better."""
    each = scores.join(human, "doc_id").select("subjects", F.posexplode("scores").alias("k", "score"))
    truth = F.array_contains("subjects", F.element_at(F.array(*map(F.lit, others)), F.col("k") + 1))
    sums = [F.count_if(F.col("score") > t).alias(f"said_{i}") for i, t in enumerate(GRID)] + [F.count_if((F.col("score") > t) & truth).alias(f"both_{i}") for i, t in enumerate(GRID)]
    found = {}
    for r in each.groupBy("k").agg(F.count_if(truth).alias("truth"), *sums).collect():  # one row a subject
        f1 = {t: 2 * r[f"both_{i}"] / max(r[f"said_{i}"] + r["truth"], 1) for i, t in enumerate(GRID)}
        best = max(f1, key=lambda t: (round(f1[t], 2), -abs(t)))
        found[others[r["k"]]] = best if f1[best] > f1[0.0] + 0.02 else 0.0
    return {s: found.get(s, 0.0) for s in others}


def assigned(documents: DataFrame, labels: DataFrame, subject_table: DataFrame) -> DataFrame:
    """``doc_id, subject`` for every document with text, ``FALLBACK`` where no other subject holds; null and blank texts have
    none. Without labels every document with text gets ``FALLBACK``; null subjects and labels of unknown ones are left aside."""
    subjects = sorted({r[0] for r in subject_table.where("subject is not null").select(tidy_subject(F.col("subject"))).collect()})  # fixed, one row a subject
    others = [s for s in subjects if s != FALLBACK]
    if not others:
        return documents.where("doc_id is not null").where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("doc_id", F.lit(FALLBACK).alias("subject"))
    human = cut(judged(labels, subjects))
    scores = cut(scored(documents, train(documents, human, others)))
    limits = thresholds(scores, human, others)
    held = F.array_compact(F.array(*[F.when(F.col("scores")[i] > F.lit(limits[s]), F.lit(s)) for i, s in enumerate(others)]))
    final = F.when(F.size(held) > 0, held).otherwise(F.array(F.lit(FALLBACK)))
    return scores.where("some").select("doc_id", F.explode(final).alias("subject"))
