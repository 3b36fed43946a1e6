"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A sentence is the mean of its word and word-pair vectors, a word's vector the mean of its own and
its character-gram vectors, all hashed into a table of fixed size. Every sentence of a labelled
document is trained with the document's labels: sentences of procedure stand under all labels alike
and stay below one half, those that deal with a subject rise above it. Every step sums the gradients of all
partitions and moves one model on the driver, so the result does not depend on how documents are spread. As the outputs are linear in the mean, a word has one
vector of scores, and whole corpora are scored by sums of those.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.scale import scratch

#: Rows of the embedding table, length of a vector.
BUCKETS, DIM = 1 << 16, 16
#: A word or pair of words counts in training if it stands in so many labelled documents.
LEAST_DOCS = 3
#: Labelled documents of a training task, and most tasks (so many gradients reach the driver in a step).
TASK_DOCUMENTS, MAX_TASKS = 1_000, 32

_WORD = re.compile(r"[^\W\d_]{2,}")
_DROP = re.compile(r"[​-‏⁠­﻿]")
#: Ends of sentences besides a full stop and a blank; all are turned into that.
_ENDS = ("\n", "\r", "! ", "? ", "。")


def sentences(text: str) -> list[list[str]]:
    """Words in lower case of each sentence of at least two words."""
    text = _DROP.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().replace("\t", " ")
    for end in _ENDS:
        text = text.replace(end, ". ")
    found = map(_WORD.findall, text.split(". "))
    return [s for s in found if len(s) > 1]


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a word and its character grams of 4 and 5; a pair of words (with a blank) has only its own."""
    if " " in word:
        return [_h(word)]
    w = f"<{word}>"
    return [_h(word), *(_h("#" + w[i : i + n]) for n in (4, 5) for i in range(len(w) - n + 1))]


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


class Shard:
    """The labelled sentences of a partition as index arrays; ``row`` gives each bucket's place among those that training moves."""

    def __init__(self, documents: list[list[str]], labels: np.ndarray, row: dict[int, int]):
        ids: dict[str, int] = {}
        tok = [ids.setdefault(w, len(ids)) for d in documents for w in d]
        self.rows, self.n, self.y = len(row), np.array([len(d) for d in documents]), labels.astype(np.float32)
        self.tok = np.array(tok, np.int64)
        self.doc = np.repeat(np.arange(len(documents)), self.n)
        self.start = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self.doc_by_word = self.doc[np.argsort(self.tok, kind="stable")]
        counts = np.bincount(self.tok, minlength=len(ids))
        self.word_start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        feats = [[row[f] for f in word_features(w)] for w in ids]
        self.k = np.array([len(f) for f in feats])
        self.feat = np.array([x for f in feats for x in f], np.int64)
        self.feat_start = np.concatenate([[0], np.cumsum(self.k)[:-1]])
        self.word = np.repeat(np.arange(len(ids)), self.k)
        self.used, inverse = np.unique(self.feat, return_inverse=True)
        self.word_by_feat = self.word[np.argsort(inverse, kind="stable")]
        fc = np.bincount(inverse)
        self.used_start = np.concatenate([[0], np.cumsum(fc)[:-1]])

    def gradient(self, e: np.ndarray, w: np.ndarray, b: np.ndarray):
        """Sums over the shard's sentences, not means, so that shards add up."""
        k, n = self.k.astype(e.dtype)[:, None], self.n.astype(e.dtype)[:, None]
        v = np.add.reduceat(e[self.feat], self.feat_start) / k
        h = np.add.reduceat(v[self.tok], self.start) / n
        d = 1 / (1 + np.exp(-np.clip(h @ w + b, -30, 30))) - self.y
        dh = (d @ w.T) / n
        dv = np.add.reduceat(dh[self.doc_by_word], self.word_start) / k
        de = np.zeros((self.rows, e.shape[1]), e.dtype)
        de[self.used] = np.add.reduceat(dv[self.word_by_feat], self.used_start)
        return de, h.T @ d, d.sum(0)


def start_model(n_subjects: int, seed: int = 11):
    r = np.random.default_rng(seed)
    return [r.normal(0, 0.03, (BUCKETS, DIM)).astype(np.float32), r.normal(0, 1, (DIM, n_subjects)).astype(np.float32), np.full(n_subjects, -2.0, np.float32)]


class Adam:
    """Steps of a model from gradients."""

    def __init__(self, model: list[np.ndarray], rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.s = ([np.zeros_like(x) for x in model] for _ in range(2))

    def step(self, gradient: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, s in zip(self.model, gradient, self.m, self.s):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-8)


class Scorer:
    """Scores of words for every subject; sums of them score any text. Pairs of words that training did not see count for nothing."""

    def __init__(self, model: list[np.ndarray], seen: np.ndarray, most: int = 400_000):
        e, w, self.b = model
        self.ew, self.seen, self.most = e @ w, seen, most
        self._forget()

    def _forget(self) -> None:
        words: list[str] = []

        class Ids(dict):
            def __missing__(self, word: str) -> int:
                k = self[word] = len(words)
                words.append(word)
                return k

        self.ids, self.words = Ids(), words
        self.table = np.zeros((0, len(self.b)), np.float32)
        self.pairs: dict[int, int] = {}

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """Of texts that have words."""
        if len(self.ids) > self.most or len(self.pairs) > 4 * self.most:
            self._forget()
        words = self.words
        tok = list(map(self.ids.__getitem__, chain.from_iterable(texts)))
        if len(words) > len(self.table):
            fresh = [self.ew[word_features(w)].mean(0) for w in words[len(self.table) :]]
            self.table = np.concatenate([self.table, np.array(fresh, np.float32)])
        tok, n = np.array(tok, np.int64), np.array([len(t) for t in texts])
        of = np.repeat(np.arange(len(texts)), n)
        total = np.add.reduceat(self.table[tok], np.concatenate([[0], np.cumsum(n)[:-1]]))
        inner = np.flatnonzero(of[1:] == of[:-1])
        keys, inverse = np.unique((tok[inner] << 32) | tok[inner + 1], return_inverse=True)
        bucket = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            x = self.pairs.get(key)
            if x is None:
                x = _h(f"{words[key >> 32]} {words[key & 0xFFFFFFFF]}")
                x = self.pairs[key] = x if self.seen[x] else -1
            bucket[i] = x
        bucket, at = bucket[inverse], of[inner]
        bucket, at = bucket[bucket >= 0], at[bucket >= 0]
        for j in range(total.shape[1]):
            total[:, j] += np.bincount(at, self.ew[bucket, j], len(texts))
        return total / (n + np.bincount(at, minlength=len(texts)))[:, None] + self.b


def deals(scorer: Scorer, texts: list[str | None], cut: float = 0.0) -> list[tuple[int, np.ndarray] | None]:
    """For each text the number of sentences that deal with any subject, and with each; none if no sentence does."""
    split = [sentences(t) if t else [] for t in texts]
    flat = [s for ss in split for s in ss]
    if not flat:
        return [None] * len(texts)
    yes = scorer.logits(flat) > cut
    any_ = yes.any(1)
    out, at = [], 0
    for ss in split:
        n = int(any_[at : at + len(ss)].sum())
        out.append((n, yes[at : at + len(ss)].sum(0)) if n else None)
        at += len(ss)
    return out


#: Shards that a worker has built, by fit and partition; only those of the latest fit are kept.
_SHARDS: dict[tuple[str, int], Shard] = {}


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], key: str, text: str, steps: int = 36, rate: float = 0.06, cycle: int = 12, keep: float = 0.74, max_labelled: int = 3_000):
    """The model and the buckets of word pairs it has seen.

    Fitted on at most ``max_labelled`` labelled documents, the first by a hash of their id. Every step is a pass over them: each task
    sums its gradient, of fixed size, and the driver steps once for all. After every ``cycle`` of steps ``keep`` shrinks the embeddings, and the steps start anew.
    """
    spark = documents.sparkSession
    known = labels.filter(F.col("subject").isin(subjects) & F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    first = known.orderBy(F.xxhash64(key), key).limit(max_labelled)
    mine = scratch(documents.select(key, F.col(text).alias("text")).filter(F.length("text") > 0).join(F.broadcast(first), key).select(key, "subjects", "text"))
    tasks = min(MAX_TASKS, -(-mine.count() // TASK_DOCUMENTS))
    if not tasks:
        return None, None
    mine = scratch(mine.repartition(tasks, F.pmod(F.xxhash64(F.lit(3), key), F.lit(tasks))))
    number = {s: j for j, s in enumerate(subjects)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for g in {g for s in sentences(t) for g in grams(s)}:
                    df[g] = df.get(g, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["gram", "n"])

    # Of the bounded sample only.
    often = mine.select("text").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    words = frozenset(r.gram for r in often.collect())
    if not words:
        return None, None
    used = np.unique([f for g in words for f in word_features(g)])
    told = spark.sparkContext.broadcast((words, {int(f): k for k, f in enumerate(used)}))
    run_id = uuid.uuid4().hex

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (vocab, row), docs, ys = told.value, [], []
        for batch in batches:
            for subs, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y = np.zeros(len(subjects), np.float32)
                y[[number[s] for s in subs]] = 1
                for s in sentences(t):
                    g = [w for w in grams(s) if w in vocab]
                    if g:
                        docs.append(g), ys.append(y)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(Shard(docs, np.array(ys), row))], pa.binary())], ["part", "shard"])

    # Texts are read once; the steps read index arrays.
    built = scratch(mine.select("subjects", "text").mapInArrow(build, "part int, shard binary"))
    whole = start_model(len(subjects))
    # Only the rows of words that occur are trained, and travel.
    adam = Adam([whole[0][used], whole[1], whole[2]], rate)

    for t in range(1, steps + 1):
        now = spark.sparkContext.broadcast(adam.model)

        def train(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for old in [k for k in _SHARDS if k[0] != run_id]:
                del _SHARDS[old]
            for batch in batches:
                for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                    at = (run_id, part)
                    if at not in _SHARDS:
                        _SHARDS[at] = pickle.loads(packed.as_buffer())
                    out = _SHARDS[at].gradient(*now.value)
                    yield pa.RecordBatch.from_arrays([pa.array([len(_SHARDS[at].n)], pa.int64()), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in out)], ["n", "e", "w", "b"])

        got = built.mapInArrow(train, "n bigint, e binary, w binary, b binary").collect()  # at most MAX_TASKS gradients
        if not got:
            return None, None
        n = np.float32(sum(r.n for r in got))
        adam.step([sum(np.frombuffer(bytes(r[c]), np.float32) for r in got).reshape(x.shape) / n for c, x in zip("ewb", adam.model)])
        now.unpersist()
        if t % cycle == 0:
            adam.model[0] *= np.float32(keep)
            adam = Adam(adam.model, rate)
    whole[0][used] = adam.model[0]
    seen = np.zeros(BUCKETS, bool)
    seen[[_h(g) for g in words if " " in g]] = True
    return [whole[0], adam.model[1], adam.model[2]], seen


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", cut: float = 0.0, least: float = 0.25) -> DataFrame:
    """``key, subject, n_sentences, share``: the subjects of every document.

    A subject is given where at least ``least`` of the sentences that deal with any subject deal with
    it. Null and empty texts, and texts of mere procedure, have none; without labelled documents
    there is no row. ``labels`` is ``key, subject`` with rows of other subjects ignored; ``subjects`` is a small list.
    """
    spark = documents.sparkSession
    names = sorted(r.subject for r in subjects.select("subject").filter("subject is not null").distinct().limit(1000).collect())
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, subject string, n_sentences int, share double"
    model, seen = fit(documents, labels, names, key, text) if names else (None, None)
    if model is None:
        return spark.createDataFrame([], schema)
    now = spark.sparkContext.broadcast((model, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*now.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for k, found in zip(part.column(0).to_pylist(), deals(scorer, part.column(1).to_pylist(), cut)):
                    if found:
                        n, each = found
                        rows += [(k, names[j], int(each[j]), float(each[j] / n)) for j in np.flatnonzero(each >= least * n - 1e-9).tolist()]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.string(), pa.int32(), pa.float64()))], [key, "subject", "n_sentences", "share"])

    return documents.select(key, text).filter(F.length(text) > 0).mapInArrow(run, schema)
