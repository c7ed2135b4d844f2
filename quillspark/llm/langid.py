"""Language of whole texts by a linear-chain conditional random field over their words.

Each word's features are its affixes, character n-grams and whether learned lexicons of
frequent words hold it; transitions between the languages of neighbouring words are
learned with them, on labelled texts and on texts spliced from pieces of several of them.
Forward-backward gives each word's posterior, exactly and over whole texts: texts are cut
into blocks, the blocks' transfer matrices are multiplied up, and then all blocks run
forward and backward at once from the right boundary vectors. A text's language is the
one with the largest posterior mass over its words, its score that share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import LETTERS, released, rows, with_columns
from quillspark.llm.words import WordTable, groups_of, hashed

BUCKETS, BLOCK = 1 << 16, 96


class Buckets(dict):
    """Bucket of each feature, kept for each worker."""

    def __missing__(self, feature: str) -> int:
        self[feature] = at = hashed((feature,), BUCKETS)[0]
        return at


KNOWN = Buckets()


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, K)
    moves: np.ndarray  # (K, K): from, to
    start: np.ndarray  # (K)
    lexicon: dict[str, list[int]]

    def features(self, word: str) -> list[str]:
        """N-grams of the word between marks of its ends, its longer affixes, and the lexicons that hold it."""
        w = f"<{word}>"
        out = [w[:5], w[-5:], w[:4], w[-4:]]
        out += [w[i : i + 3] for i in range(len(w) - 2)]
        out += [w[i : i + 2] for i in range(len(w) - 1)]
        return out + [f" {k}" for k in self.lexicon[word]] if word in self.lexicon else out

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature buckets of all words one after another, and each word's number of them."""
        found = [self.features(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        if len(KNOWN) > 200_000:
            KNOWN.clear()
        at = map(KNOWN.__getitem__, chain.from_iterable(found))
        return np.fromiter(at, np.int32, int(counts.sum())), counts

    def emissions(self, words: list[str]) -> list[np.ndarray]:
        """exp of each word's score by language, the largest 1."""
        if not words or not self.langs:
            return [np.zeros((len(words), len(self.langs)))]
        ids, n = self.flat(words)
        x = np.add.reduceat(self.weights[ids], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
        return [np.exp(x - x.max(1, keepdims=True))]


def posteriors(m: Model, e: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior of each word by language; e: emissions of all texts' words one after another."""
    if not len(e):
        return np.zeros((0, len(m.langs)))
    k, moves = e.shape[1], np.exp(m.moves - m.moves.max())
    start = np.exp(m.start - m.start.max())
    blocks = -(-counts // block)
    first = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    size = np.minimum(block, np.repeat(counts, blocks) - nth * block)
    place = np.repeat(np.cumsum(counts) - counts, blocks) + nth * block
    steps = int(size.max())
    real = np.arange(steps) < size[:, None]
    x = np.ones((len(size), steps, k))
    x[real] = e
    at_first = nth == 0
    # transfer matrix of each block; a text's first block forgets what comes before it
    matrix = np.broadcast_to(np.eye(k), (len(size), k, k)).copy()
    for t in range(steps):
        then = (matrix.reshape(-1, k) @ moves).reshape(matrix.shape)
        if t == 0:
            then[at_first] = start
        then *= x[:, t, None, :]
        if t % 8 == 7:
            then /= then.max((1, 2), keepdims=True)
        on = real[:, t]
        matrix[on] = then[on]
    enter, leave = np.full((len(size), k), 1.0 / k), np.full((len(size), k), 1.0 / k)
    last = first + blocks - 1
    for j in range(1, int(blocks.max())):
        b = first[blocks > j] + j
        v = np.einsum("bi,bij->bj", enter[b - 1], matrix[b - 1])
        enter[b] = v / v.sum(1, keepdims=True)
        b = last[blocks > j] - j
        v = np.einsum("bij,bj->bi", matrix[b + 1], leave[b + 1])
        leave[b] = v / v.sum(1, keepdims=True)
    alpha, a = np.empty_like(x), enter
    for t in range(steps):
        then = a @ moves
        if t == 0:
            then[at_first] = start
        then *= x[:, t]
        then /= then.sum(1, keepdims=True)
        a = np.where(real[:, t, None], then, a)
        alpha[:, t] = a
    b, back = leave, moves.T.copy()
    for t in range(steps - 1, -1, -1):
        alpha[:, t] *= b
        then = (b * x[:, t]) @ back
        then /= then.sum(1, keepdims=True)
        b = np.where(real[:, t, None], then, b)
    out = alpha[real]
    assert len(out) == len(e) and int(place[-1] + size[-1]) == len(e)
    return out / out.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 4, batch: int = 32, rate: float = 0.2, seed: int = 3, lexicon: int = 150) -> Model:
    """A model of texts and their languages: likelihood ascent with adaptive steps, in numpy.

    lexicon: words of a language's lexicon, at most: its most frequent ones that mostly occur in it.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    k = len(names)
    m = Model(names, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k), {})
    table = WordTable(lambda words: [np.zeros((len(words), 1))], most=1 << 40)
    ids, counts = table.rows(texts)
    docs = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
    gold = [names.index(x) for x in langs]
    words = list(table)
    seen = [Counter() for _ in names]
    for d, g in zip(docs, gold, strict=True):
        seen[g].update(np.unique(d).tolist())
    total = sum(seen, Counter())
    for g, c in enumerate(seen):
        for w, n in c.most_common(lexicon):
            if n > 2 and n >= 0.6 * total[w]:
                m.lexicon.setdefault(words[w], []).append(g)
    if not words or k < 2:
        return m
    flat, n = m.flat(words)
    offset = np.cumsum(n) - n
    runs: list[tuple[np.ndarray, np.ndarray]] = []
    whole = [(d, np.full(len(d), g)) for d, g in zip(docs, gold, strict=True) if len(d)]
    for _ in range(len(whole) // 2):  # spliced: pieces of 4 to 60 words of a few texts
        parts = []
        for i in rng.integers(len(whole), size=int(rng.integers(2, 6))):
            d, g = whole[i]
            a, size = int(rng.integers(len(d))), int(rng.integers(4, 61))
            parts.append((d[a : a + size], g[a : a + size]))
        runs.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
    runs += whole
    sums = {"w": np.full((BUCKETS, k), 1e-2), "m": np.full((k, k), 1e-2), "s": np.full(k, 1e-2)}
    for _ in range(epochs):
        deal = rng.permutation(len(runs))
        for at in range(0, len(deal), batch):
            pick = sorted((runs[i] for i in deal[at : at + batch]), key=lambda r: -len(r[0]))
            size = np.array([len(r[0]) for r in pick])
            distinct, local = np.unique(np.concatenate([r[0] for r in pick]), return_inverse=True)
            inner = np.concatenate([np.arange(offset[w], offset[w] + n[w]) for w in distinct])
            own, scale = n[distinct], 1 / np.sqrt(n[distinct])
            feats = flat[inner]
            score = np.add.reduceat(m.weights[feats], np.cumsum(own) - own, axis=0) * scale[:, None]
            e = np.exp(score - score.max(1, keepdims=True))[local]
            post, pairs = _pairs(m, e, size)
            y = np.concatenate([r[1] for r in pick])
            miss = -post
            miss[np.arange(len(y)), y] += 1
            by_word = np.stack([np.bincount(local, miss[:, j], len(distinct)) for j in range(k)], 1) * scale[:, None]
            where, back = np.unique(feats, return_inverse=True)
            spread = np.repeat(by_word, own, axis=0)
            grad = np.stack([np.bincount(back, spread[:, j], len(where)) for j in range(k)], 1) / len(pick) - 1e-4 * m.weights[where]
            starts = np.cumsum(size) - size
            inside = np.ones(len(y), bool)
            inside[starts] = False
            pos = np.flatnonzero(inside)
            moved = np.zeros((k, k))
            np.add.at(moved, (y[pos - 1], y[pos]), 1)
            for name, param, g, i in (("w", m.weights, grad, where), ("m", m.moves, (moved - pairs) / len(pick) - 1e-3 * m.moves, slice(None)), ("s", m.start, miss[starts].sum(0) / len(pick), slice(None))):
                sums[name][i] += g**2
                param[i] += rate * g / np.sqrt(sums[name][i])
    return m


def _pairs(m: Model, e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of words, and the expected number of each move; counts fall."""
    k, moves, start = e.shape[1], np.exp(m.moves - m.moves.max()), np.exp(m.start - m.start.max())
    at, steps = np.cumsum(counts) - counts, int(counts[0])
    live = [int((counts > t).sum()) for t in range(steps)]
    alpha, beta, pairs = np.empty_like(e), np.empty_like(e), np.zeros((k, k))
    a = start * e[at]
    for t in range(steps):
        i = at[: live[t]] + t
        if t:
            a = (a[: live[t]] @ moves) * e[i]
        a /= a.sum(1, keepdims=True)
        alpha[i] = a
    b = np.ones((len(counts), k))
    for t in range(steps - 1, -1, -1):
        i = at[: live[t]] + t
        beta[i] = b[: live[t]]
        if t:
            into = b[: live[t]] * e[i]
            p = alpha[i - 1][:, :, None] * moves * into[:, None, :]
            pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
            back = into @ moves.T
            b[: live[t]] = back / back.sum(1, keepdims=True)
    post = alpha * beta
    return post / post.sum(1, keepdims=True), pairs


def sample(docs: DataFrame, most: int, longest: int) -> tuple[list[str], list[str]]:
    """About `most` labelled texts of each language, by lowest hash; of a longer text `longest` characters at a hashed place.

    The bound makes this the one collected set; it does not grow with the rows.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    mark = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (mark < min(1.0, most / n)))
    room = F.greatest(F.lit(1), F.char_length("text") - longest)
    part = F.substring("text", F.when(F.char_length("text") > longest, F.pmod(F.xxhash64("doc_id"), room) + 1).otherwise(1).cast("int"), F.lit(longest))
    found = known.where(keep).select("doc_id", part.alias("t"), "lang").collect()
    found.sort(key=lambda r: (r[0], r[1], r[2]))
    return [r[1] for r in found], [r[2] for r in found]


def train(docs: DataFrame, most: int = 300, longest: int = 3000) -> Model:
    """A model from text and lang of documents whose crc32(doc_id) mod 3 is not 1."""
    model = fit(*sample(docs, most, longest))
    KNOWN.clear()
    released()
    return model


def label(m: Model, text: str | None) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of a text."""
    words = LETTERS.findall((text or "").lower())
    if not words or not m.langs:
        return []
    p = posteriors(m, m.emissions(words)[0], np.array([len(words)]))
    return [(w, m.langs[i], float(q[i])) for w, q, i in zip(words, p, p.argmax(1), strict=True)]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text and any other columns) with held_out, lang_pred, score and sure, by whole texts.

    sure is the mean over words of the largest posterior. Null texts and texts without a
    letter are `und`, score and sure 0, as is all text for a model without languages. A tie
    goes to the language that sorts first. Very long texts are taken whole. Repeated rows are
    told each, rows without doc_id too (not held out); an empty table gives no row; existing
    columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size but for the number of languages
    docs = docs.drop("lang_pred", "score", "sure", "held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = WordTable(m.emissions, most=150_000)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            sure: list[float] = []
            for (texts,) in rows(iter([batch]), "text", step=128):
                ids, counts = table.rows(texts)
                starts = np.concatenate(([0], np.cumsum(counts)))
                for a, b in groups_of(counts, 50_000):
                    share, own = np.zeros((b - a, max(1, len(m.langs)))), np.zeros(b - a)
                    some = np.flatnonzero(counts[a:b])
                    if len(some) and m.langs:
                        n = counts[a:b][some]
                        p = posteriors(m, table.values[0][ids[starts[a] : starts[b]]], n)
                        share[some] = np.add.reduceat(p, np.cumsum(n) - n, axis=0) / n[:, None]
                        own[some] = np.add.reduceat(p.max(1), np.cumsum(n) - n) / n
                    best = share.argmax(1)
                    langs += [m.langs[i] if s[i] > 0 else "und" for s, i in zip(share, best, strict=True)]
                    scores += np.minimum(1.0, share.max(1)).tolist()
                    sure += np.minimum(1.0, own).tolist()
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "sure"])
        del m, table
        KNOWN.clear()
        released()

    made = docs.mapInArrow(run, with_columns(docs.schema, "lang_pred string", "score double", "sure double"))
    return made.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
