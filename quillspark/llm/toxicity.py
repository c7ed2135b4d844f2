"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the vectors of its hashed features: itself and its
prefixes and suffixes. Filters of several widths slide over a text's words; the largest
response of each filter goes through a logistic output. Filters are linear before the
pooling, so a word's share of every filter is worked out once per distinct word. The
thresholds are calibrated by language on training rows that the training did not see; the score
is moved on the logit scale so that 0.5 is the threshold of the text's language. A text's
language is told from its words alone, by the frequent words of each language that the
training texts show (a naive Bayes of them, learned from `lang` where documents have it).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import LETTERS, released, rows, with_columns
from quillspark.llm.words import WordTable, groups_of, hashed
from quillspark.shared import dropped, written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8


def features(word: str) -> list[str]:
    out = [f"w:{word}"]
    out += [f"p{k}:{word[:k]}" for k in (3, 4, 5) if len(word) >= k]
    return out + [f"s{k}:{word[-k:]}" for k in (3, 4) if len(word) >= k]


PER_WORD = 6


def telling(texts: list[list[str]], langs: list[str | None], most: int = 200) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages, and for the most frequent words of each how much likelier than on average a text of each language has them, in logs."""
    names = sorted({x for x in langs if x is not None})
    seen: dict[str, np.ndarray] = {}
    size = np.zeros(len(names))
    for words, lang in zip(texts, langs, strict=True):
        if lang is not None:
            k = names.index(lang)
            size[k] += 1
            for w in set(words):
                seen.setdefault(w, np.zeros(len(names)))[k] += 1
    chosen = {w for k in range(len(names)) for w, _ in sorted(seen.items(), key=lambda x: (-x[1][k], x[0]))[:most]}
    rates = {w: np.log((seen[w] + 0.5) / (size + 1)) for w in chosen}
    return names, {w: (r - r.mean()).astype(np.float32) for w, r in rates.items()}


def buckets(words: list[str]) -> np.ndarray:
    """Feature buckets of each word; BUCKETS where it has fewer features."""
    out = np.full((len(words), PER_WORD), BUCKETS, dtype=np.int32)
    for i, w in enumerate(words):
        f = hashed(features(w), BUCKETS)
        out[i, : len(f)] = f
    return out


@dataclass
class Model:
    embed: np.ndarray  # (BUCKETS + 1, DIM), the last row zero
    filters: list[np.ndarray]  # one for each width: (width, DIM, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS)
    out: np.ndarray  # the same, and
    last: float
    langs: list[str]
    tells: dict[str, np.ndarray]  # of frequent words, by language
    shift: np.ndarray  # the threshold's logit by language, last for texts of none
    moved: dict[str, np.ndarray] | None = None  # of its training

    def word_values(self, words: list[str]) -> list[np.ndarray]:
        """Every filter's share at each of its places, for each word; then its tells of language."""
        e = self.embed[buckets(words)].sum(1)
        shares = [(e @ f[k]).astype(np.float32) for f in self.filters for k in range(len(f))]
        none = np.zeros(len(self.langs), np.float32)
        tells = np.array([self.tells.get(w, none) for w in words], dtype=np.float32)
        return [*shares, tells.reshape(len(words), len(self.langs))]

    def logits(self, values: list[np.ndarray], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output of each text, and its language."""
        starts = np.cumsum(counts) - counts
        some = np.flatnonzero(counts)
        pooled = np.full((len(counts), len(self.bias)), -1e30, dtype=np.float32)
        tells = np.zeros((len(counts), len(self.langs)))
        if len(some):
            at, ends, col = starts[some], (starts + counts)[some], 0
            for w, f in enumerate(self.filters):
                total = np.take(values[col], ids, axis=0)
                for k in range(1, len(f)):
                    crossing = [(e := ends - j)[e >= at] for j in range(1, k + 1)]  # places whose k-th next word is another text's
                    saved = [total[e] for e in crossing]
                    total[:-k] += np.take(values[col + k], ids[k:], axis=0)
                    for e, v in zip(crossing, saved, strict=True):
                        total[e] = v
                pooled[some, w * FILTERS : (w + 1) * FILTERS] = np.maximum.reduceat(np.ascontiguousarray(total.T), at, axis=1).T
                col += len(f)
            if self.langs:
                tells[some] = np.add.reduceat(np.take(values[col], ids, axis=0).T, at, axis=1).T
        hidden = np.maximum(pooled + self.bias, 0)
        lang = np.where(tells.any(1), tells.argmax(1), len(self.langs)) if self.langs else np.zeros(len(counts), int)
        return hidden @ self.out + self.last, lang


def squashed(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Training:
    """A model's parameters as they move: steps by the sums of their squared gradients (AdaGrad), and how often each feature has moved."""

    def __init__(self, model: Model, moved: dict[str, np.ndarray] | None = None):
        m = self.model = model
        self.params = {"e": m.embed, "b": m.bias, "o": m.out} | {f"f{i}": f for i, f in enumerate(m.filters)}
        self.moved = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.params.items()} if moved is None else {k: v.copy() for k, v in moved.items()}
        self.times = np.zeros(BUCKETS, np.float32)

    def _step(self, k: str, grad: np.ndarray, rate: float, at=slice(None)) -> None:
        self.moved[k][at] += grad**2
        self.params[k][at] -= rate * grad / np.sqrt(self.moved[k][at])
        if k == "e":
            self.times[at] += 1

    def update(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, values: np.ndarray, rate: float) -> None:
        """One update by documents with words, given as rows of `values`, the buckets of each word."""
        m, nf = self.model, FILTERS
        n = np.array([len(d) for d in docs])
        w = np.concatenate(docs)
        at = np.cumsum(n) - n
        distinct, local = np.unique(w, return_inverse=True)
        own_buckets = values[distinct]
        e = m.embed[own_buckets].sum(1)
        left = np.repeat(at + n, n) - np.arange(len(w))
        hidden, best = [], []
        for f in m.filters:
            total = (e @ f[0])[local]
            for k in range(1, len(f)):
                total[:-k] += (e @ f[k])[local[k:]] * (left[:-k] > k)[:, None]
            top = np.maximum.reduceat(total, at, axis=0)
            same = np.flatnonzero(total == np.repeat(top, n, axis=0))  # first place of each maximum
            place = np.full(top.shape, -1, np.int64)
            r, c = np.divmod(same[::-1], nf)
            place[np.repeat(np.arange(len(docs)), n)[r], c] = r
            hidden.append(top)
            best.append(place)
        h = np.concatenate(hidden, 1) + m.bias
        act = np.maximum(h, 0)
        miss = (squashed(act @ m.out + m.last) - y) * weight / len(docs)
        gh = miss[:, None] * m.out * np.where(h > 0, 1.0, 0.05)
        ge = np.zeros_like(e)
        for i, f in enumerate(m.filters):
            g, gf = gh[:, i * nf : (i + 1) * nf], np.zeros_like(f)
            for k in range(len(f)):
                place = best[i] + k
                inside = place < (at + n)[:, None]
                word = local[np.minimum(place, len(w) - 1)]
                gk = np.where(inside, g, 0)
                for c in range(nf):
                    gf[k, :, c] = gk[:, c] @ e[word[:, c]]
                    np.add.at(ge, word[:, c], gk[:, c, None] * f[k, :, c])
            self._step(f"f{i}", gf, rate)
        touched = np.flatnonzero(np.abs(ge).sum(1))
        where = own_buckets[touched].ravel()
        flat = np.repeat(ge[touched], PER_WORD, axis=0)
        slots, back = np.unique(where, return_inverse=True)
        total = np.zeros((len(slots), DIM), np.float32)
        np.add.at(total, back, flat)
        real = slots < BUCKETS
        self._step("e", total[real], rate, slots[real])
        self._step("b", gh.sum(0), rate)
        self._step("o", miss @ act, rate)
        m.last -= rate * float(miss.sum())


def fit(texts: list[str], labels: list[int], langs: list[str | None] | None = None, epochs: int = 9, steps: int = 700, batch: int = 64, rate: float = 0.05, seed: int = 5) -> Model:
    """A model of labelled texts by `epochs` rounds, or as many as make `steps` updates; a sixth of them sets the thresholds. Without both labels: the share of ones, whatever the text."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float64)
    m = Model(
        np.concatenate([rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
        -1.0,
        *telling([LETTERS.findall(t.lower()) for t in texts], langs or [None] * len(texts)),
        np.zeros(1),
    )
    m.shift = np.zeros(len(m.langs) + 1)
    if not len(y) or y.min() == y.max():
        m.out[:] = 0
        m.last = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return m
    table = WordTable(lambda words: [buckets(words)], most=1 << 40)
    ids, counts = table.rows(texts)
    starts = np.cumsum(counts) - counts
    docs = [ids[a : a + n] for a, n in zip(starts, counts, strict=True)]
    deal = rng.permutation(len(docs))
    held, own = deal[: len(docs) // 6], deal[len(docs) // 6 :]
    own = np.array([i for i in own if len(docs[i])])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    training, values = Training(m), table.values[0]
    for _ in range(max(epochs, -(-steps * batch // max(1, len(own))))):
        rng.shuffle(own)
        for b in range(0, len(own), batch):
            pick = own[b : b + batch]
            training.update([docs[i] for i in pick], y[pick], weight[pick], values, rate)
    m.moved = training.moved
    own_values = WordTable(m.word_values, most=1 << 40)
    x, lang = m.logits(*_values(own_values, [texts[i] for i in held]))
    for k in range(len(m.shift)):
        m.shift[k] = threshold(x[lang == k], y[held][lang == k])
    return m


def _values(table: WordTable, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    ids, counts = table.rows(texts)
    return table.values, ids, counts


def threshold(x: np.ndarray, y: np.ndarray, prior: float = 15.0, n: np.ndarray | None = None) -> float:
    """The logit that best tells labels apart: most F1, halfway between neighbours, pulled to 0 as by `prior` ones. With n: x stands for n rows, y of them ones."""
    n = np.ones(len(x)) if n is None else n
    if n.sum() < 20 or y.sum() in (0, n.sum()):
        return 0.0
    order = np.argsort(-x, kind="stable")
    x, y, n = x[order], y[order], n[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.cumsum(n) + y.sum())
    gaps = np.append((x[:-1] + x[1:]) / 2, x[-1] - 1)
    best = f1.max()
    near = np.flatnonzero(f1 >= best - 1e-12)
    cut = gaps[near[np.argmin(np.abs(gaps[near]))]]
    return float(cut * y.sum() / (y.sum() + prior))


def sample(docs: DataFrame, labels: DataFrame, most: int, longest: int) -> tuple[list[str], list[int], list[str | None]]:
    """Texts, labels and languages of at most `most` labelled rows of each class, by lowest hash; of a text over `longest` characters a part at a hashed place.

    What training starts from; the bound makes this the one collected set, which does not grow with the input.
    """
    known = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_y")).where("_y in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    mark = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("_y") == y) & (mark < min(1.0, most / n)))
    known = F.broadcast(known.where(keep))  # about `most` ids of each class, whatever the input
    room = F.greatest(F.lit(1), F.char_length("text") - longest)
    part = F.substring("text", F.when(F.char_length("text") > longest, F.pmod(F.xxhash64("doc_id"), room) + 1).otherwise(1).cast("int"), F.lit(longest))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    own = docs.select("doc_id", "text", lang.cast("string").alias("_lang")).where("text is not null")
    found = own.join(known, "doc_id").select("doc_id", part.alias("t"), "_y", "_lang").collect()
    found.sort(key=lambda r: (r[0], r[1], r[3] or ""))
    return [r[1] for r in found], [int(r[2]) for r in found], [r[3] for r in found]


def held_back() -> Column:
    """Whether a row is held for the thresholds: by id, so that repeated rows are on one side."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(31)), F.lit(6)) == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, y, lang, held of all labelled rows: whole texts; a sixth of the ids (held) sets the thresholds."""
    known = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where("y in (0, 1)")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    own = docs.select("doc_id", "text", lang.cast("string").alias("lang")).where("text is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    return own.join(known.hint("merge"), "doc_id").select("doc_id", "text", "y", "lang", held_back().alias("held"))


def tells_of(table: DataFrame, most: int = 200, held: int = 200_000) -> tuple[list[str], dict[str, np.ndarray]]:
    """telling() of all rows with a language, by sums over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def made() -> pa.RecordBatch:
            langs = [x for x, c in seen.items() for _ in c]
            return pa.record_batch([pa.array(langs, pa.string()), pa.array([w for c in seen.values() for w in c], pa.string()), pa.array([n for c in seen.values() for n in c.values()], pa.int64())], names=["lang", "word", "n"])

        for texts, langs in rows(batches, "text", "lang", step=64):
            for text, lang in zip(texts, langs, strict=True):
                seen.setdefault(lang, Counter()).update(set(LETTERS.findall(text.lower())))
            if sum(map(len, seen.values())) >= held:
                yield made()
                seen.clear()
        if seen:
            yield made()

    own = table.where("lang is not null").select("text", "lang")
    size = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(size)
    found = written(own.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "tells")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    chosen = found.withColumn("_r", rank).where(F.col("_r") <= most).select("word").distinct()
    counts: dict[str, np.ndarray] = {}
    for r in found.join(F.broadcast(chosen), "word").collect():  # `most` words of each language
        counts.setdefault(r["word"], np.zeros(len(names)))[names.index(r["lang"])] = r["n"]
    dropped(found)
    rates = {w: np.log((c + 0.5) / (np.array([size[x] for x in names]) + 1)) for w, c in counts.items()}
    return names, {w: (r - r.mean()).astype(np.float32) for w, r in rates.items()}


#: Buckets of a row of a task's changes.
PART = 1 << 12


def trained_round(table: DataFrame, model: Model, weights: tuple[float, float], batch: int = 64, rate: float = 0.05) -> Model:
    """The model after a pass over all rows that set no thresholds: every task updates its own copy by its rows, and the changes are averaged.

    A feature's change is averaged over the tasks by how often they have moved it, all else by their updates.
    """
    sent = table.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sent.value
        own = replace(base, embed=base.embed.copy(), filters=[f.copy() for f in base.filters], bias=base.bias.copy(), out=base.out.copy())
        training, words, updates = Training(own, base.moved), WordTable(lambda w: [buckets(w)], most=100_000), 0
        for texts, ys in rows(batches, "text", "y", step=batch):
            ids, counts = words.rows(texts)
            ends = np.cumsum(counts)
            some = np.flatnonzero(counts)
            if len(some):
                y = np.array(ys, dtype=np.float64)[some]
                training.update([ids[ends[i] - counts[i] : ends[i]] for i in some], y, np.where(y == 1, *weights), words.values[0], rate)
                updates += 1
        if updates:
            names, times, parts = [], [], []
            for at in range(0, BUCKETS, PART):
                t = training.times[at : at + PART]
                if t.any():
                    change = (own.embed - base.embed)[at : at + PART] * t[:, None]
                    names.append(at // PART)
                    parts.append(np.concatenate([t[:, None], change], 1).astype(np.float32).tobytes())
            dense = np.concatenate([[1.0], *[(x - y).ravel() for x, y in zip(_dense(own), _dense(base), strict=True)]])
            names.append(-1)
            parts.append((dense * updates).astype(np.float32).tobytes())
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])
        del own, training, words
        released()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for names, sums in rows(batches, "part", "sums", step=16):
            for k, x in zip(names, sums, strict=True):
                x = np.frombuffer(x, np.float32).astype(np.float64)
                total[k] = total[k] + x if k in total else x
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])

    made = table.where("not held").select("text", "y").mapInArrow(run, "part int, sums binary")
    m = replace(model, embed=model.embed.copy(), filters=[f.copy() for f in model.filters], bias=model.bias.copy(), out=model.out.copy())
    for r in made.repartition("part").mapInArrow(added, "part int, sums binary").collect():  # a row for each part of the model
        x = np.frombuffer(r["sums"], np.float64)
        if r["part"] >= 0:
            x = x.reshape(-1, DIM + 1)
            m.embed[r["part"] * PART : r["part"] * PART + len(x)] += x[:, 1:] / np.maximum(x[:, :1], 1)
        else:
            x, at = x[1:] / x[0], 0
            for p in _dense(m)[:-1]:
                p += x[at : at + p.size].reshape(p.shape)
                at += p.size
            m.last = model.last + float(x[at])
    sent.unpersist()
    return m


def _dense(m: Model) -> list[np.ndarray]:
    return [*m.filters, m.bias, m.out, np.array([m.last])]


def thresholds(table: DataFrame, model: Model) -> np.ndarray:
    """threshold() by language of all rows held for it, whose logits are told to the hundredth."""
    sent = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words = WordTable(m.word_values, most=100_000)
        for texts, ys in rows(batches, "text", "y", step=64):
            x, lang = m.logits(*_values(words, texts))
            x = np.round(np.clip(x, -30, 30) * 100).astype(np.int64)
            yield pa.record_batch([pa.array(lang.astype(np.int64)), pa.array(x), pa.array(np.array(ys, np.int64))], names=["k", "x", "y"])
        del m, words
        released()

    made = table.where("held").select("text", "y").mapInArrow(run, "k long, x long, y long")
    found = made.groupBy("k", "x").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()  # at most 6,001 a language
    k, x, y, n = (np.array([r[c] for r in found], dtype=np.float64) for c in ("k", "x", "y", "n"))
    sent.unpersist()
    return np.array([threshold(x[k == i] / 100, y[k == i], n=n[k == i]) for i in range(len(model.langs) + 1)])


def train(docs: DataFrame, labels: DataFrame, most: int = 2000, longest: int = 20_000, rounds: int = 1, small: int = 40_000_000) -> Model:
    """A model from labels (doc_id, toxic) of documents (doc_id, text, and lang if there is one) whose crc32(doc_id) mod 5 is not 0.

    It learns from all labelled rows, by whole texts. Where they are few (twice `most`, and
    `small` characters) they are fitted together. Else the fit of about `most` rows of each
    label, of `longest` characters each, is only where training starts: `rounds` passes over
    all rows follow, by tasks, and languages and thresholds are counted over all rows. Of an
    id with both labels the larger counts; null ids and labels are left out.
    """
    table = written(labelled(docs, labels), "labelled")
    told = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("letters")).first()
    if told["n"] <= 2 * most and told["letters"] <= small:
        found = sorted(table.select("doc_id", "text", "y", "lang").collect(), key=lambda r: (r[0], r[1], r[3] or ""))
        model = fit([r[1] for r in found], [r[2] for r in found], [r[3] for r in found])
    else:
        model = fit(*sample(docs, labels.where(~held_back()), most, longest))
        model.langs, model.tells = tells_of(table)
        if 0 < told["ones"] < told["n"]:
            share = told["ones"] / told["n"]
            for _ in range(rounds):
                model = trained_round(table, model, (0.5 / share, 0.5 / (1 - share)))
            model.shift = thresholds(table, model)
        else:
            model.last, model.shift = float(np.log((told["ones"] + 0.5) / (told["n"] - told["ones"] + 0.5))), np.zeros(len(model.langs) + 1)
    model.moved = None
    dropped(table)
    released()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text and any other columns) with held_out, score and predicted, by whole texts.

    A null text counts as empty; a text without words has the score of its absent words.
    Very long texts are scored whole. A score at its threshold is 0.5, which predicts 1.
    Repeated rows, and rows without doc_id (not held out), are scored each; an empty table
    gives no row; existing columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = WordTable(m.word_values, most=100_000)
        for batch in batches:
            out = []
            for (texts,) in rows(iter([batch]), "text", step=64):
                ids, counts = table.rows(texts)
                starts = np.concatenate(([0], np.cumsum(counts)))
                for a, b in groups_of(counts, 50_000):
                    x, lang = m.logits(table.values, ids[starts[a] : starts[b]], counts[a:b])
                    out.append(squashed(np.round(x - m.shift[lang], 4)))  # sums in single precision depend on the batch
            made = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch([*kept, made], names=[*batch.schema.names, "score"])
        del m, table
        released()

    docs = docs.drop("score", "held_out", "predicted")
    made = docs.mapInArrow(run, with_columns(docs.schema, "score double"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return made.withColumns({"held_out": F.coalesce(held, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})
