"""Toxicity by a factorization machine over hashed terms, trained here on a bounded sample of labelled rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.joins import bound_batches, masked
from palimpsest.storage import discard, stage

LETTERS = re.compile(r"[^\W\d_]+")
#: Beside whole words their beginnings are terms, so that inflected and compound words share evidence.
PREFIXES = (4, 5, 6)
#: Every term has a place in a table of 2**TERM_BITS rows; terms of equal hash share it.
TERM_BITS = 20
#: Words (of up to CACHED_LENGTH letters) whose terms a worker keeps, and rows it holds terms of at a time.
CACHE, CACHED_LENGTH, SLICE = 80_000, 64, 128
#: The words of texts of more characters are not listed with their repeats.
LONG = 1 << 18
#: Terms of the sample that the driver holds at a time; a larger sample is read again in parts in each epoch.
HELD_TERMS = 16_000_000
#: Rows of a step of the fit, passes over the sample, and steps at least: small samples are passed more often.
BATCH, EPOCHS, LEAST_STEPS = 256, 8, 100
#: One labelled row in so many sets the cut and is not fitted on, if each label occurs so often among them.
CUT_FOLD, CUT_LEAST = 8, 20


def terms(word: str) -> tuple[int, ...]:
    """Places of the terms of one lower-cased word: itself and its beginnings."""
    every = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 7) & ((1 << TERM_BITS) - 1) for t in every)


def word_set(text: str | None) -> set[str]:
    return {m[0] for m in LETTERS.finditer((text or "").lower())} if text and len(text) > LONG else set(LETTERS.findall((text or "").lower()))


class TextTerms(dict):
    """Terms of words, and the distinct terms of a text; words met before cost a lookup.

    With ``slots``, terms without a slot are left out and the others become their slots.
    """

    def __init__(self, slots: np.ndarray | None = None) -> None:
        super().__init__()
        self.slots = slots

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = terms(word)
        if self.slots is not None:
            got = tuple(s for s in self.slots[list(got)].tolist() if s >= 0)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, word_set(text))), np.int32))


@dataclass
class FactorizationMachine:
    """``bias + sum w_i + sum_{i<j} <v_i, v_j>`` over the distinct terms of a text, through the logistic function."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """flat: the texts' distinct terms, one text after another."""
        out = np.full(len(lengths), self.bias)
        full = np.flatnonzero(lengths)
        if len(full):
            at = (np.cumsum(lengths) - lengths)[full]
            v = self.v[flat]
            s = np.add.reduceat(v, at, axis=0)
            out[full] += np.add.reduceat(self.w[flat], at) + 0.5 * (s * s - np.add.reduceat(v * v, at, axis=0)).sum(axis=1)
        return out


    def live(self) -> tuple[np.ndarray, FactorizationMachine]:
        """The terms that add to a margin, and the machine of these alone: others have neither weight nor factors."""
        at = np.flatnonzero((self.w != 0) | (self.v != 0).any(axis=1))
        return at, FactorizationMachine(self.bias, self.w[at], self.v[at])


class Sample(NamedTuple):
    flat: np.ndarray
    lengths: np.ndarray
    y: np.ndarray

    def take(self, pick: np.ndarray) -> Sample:
        size, starts = self.lengths[pick], (np.cumsum(self.lengths) - self.lengths)[pick]
        return Sample(self.flat[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())], size, self.y[pick])


def fit(parts: Sequence[Callable[[], Sample]], share: float, *, factors: int = 6, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 3.0, shrink: float = 0.4, factor_rate: float = 0.03, seed: int = 11) -> FactorizationMachine:
    """AdaGrad on the logistic loss over the parts of the sample; one machine, one thread, the same result in each run.

    After each step weights shrink by ``shrink`` rows' full gradient, so that a term met in a single row of a batch keeps none:
    invented words are in one text each and would be learnt by heart. Pairs count between terms that have a weight.
    ``share``: the share of label 1, from which the bias starts.
    """
    rng = np.random.default_rng(seed)
    d = 1 << TERM_BITS
    w, v = np.zeros(d, np.float32), rng.normal(0, 0.05, (d, factors)).astype(np.float32)
    gw, gv, gb = np.ones(d, np.float32), np.ones((d, factors), np.float32), 1e-2
    bias = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        for part in parts:
            sample = part()
            order = rng.permutation(len(sample.y))
            for at in range(0, len(order), batch):
                idx, size, y = sample.take(order[at : at + batch])
                own = np.repeat(np.arange(len(y)), size)
                live = np.flatnonzero(w[idx])
                vi, its = v[idx[live]], own[live]
                summed = lambda x: np.stack([np.bincount(its, x[:, f], len(y)) for f in range(factors)], axis=1)  # noqa: B023, E731
                s = summed(vi)
                z = bias + np.bincount(its, w[idx[live]], len(y)) + 0.5 * (s * s - summed(vi * vi)).sum(axis=1)
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
                used, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, g[own], len(used)).astype(np.float32)
                gw[used] += dw * dw / batch
                step = rate / batch / np.sqrt(gw[used])
                moved = w[used] - step * dw
                w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
                if len(live):
                    inner = g[its, None] * (s[its] - vi)
                    dv = np.stack([np.bincount(back[live], inner[:, f], len(used)) for f in range(factors)], axis=1).astype(np.float32)
                    gv[used] += dv * dv / batch
                    v[used] -= factor_rate * rate / batch * dv / np.sqrt(gv[used])
                gb += float(g.mean()) ** 2
                bias -= 0.1 * float(g.mean()) / gb**0.5
    v[w == 0] = 0
    return FactorizationMachine(bias, w, v)


def calibrate(model: FactorizationMachine, z: np.ndarray, y: np.ndarray) -> FactorizationMachine:
    """Shift the bias so that a score of 0.5 lies midway at the cut with the best F0.5 on rows that the fit didn't see: a clean text lost costs more than a toxic one kept."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    best = int(np.argmax(1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())))
    below = z[order[best + 1]] if best + 1 < len(y) else z[order[best]] - 1
    model.bias -= float(z[order[best]] + below) / 2
    return model


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cached = TextTerms()
    for b in batches:
        for low in range(0, b.num_rows, SLICE):
            part = b.slice(low, SLICE)
            out = [cached.of(t.as_py()) for t in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), part.column(1), part.column(2)], names=["terms", "label", "place"])


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text (remainder 0)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def _part(rows: DataFrame) -> Sample:
    got = rows.toArrow()
    order = np.argsort(got.column("place").to_numpy(), kind="stable")  # free of the order in which rows came
    lists = got.column("terms").combine_chunks().take(pa.array(order))
    return Sample(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), got.column("label").to_numpy()[order])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 20_000, folds: int = 5, **options) -> FactorizationMachine | None:
    """Fit on at most ``rows`` labelled documents whose fold is not 0; None if both labels do not occur.

    The bound: the ``rows`` labelled ids first by hash are taken, with all terms of their whole texts. The driver holds
    HELD_TERMS of these at a time; a larger sample stays in a written table and its parts are read in turn in each epoch.
    One row in CUT_FOLD is not fitted on and sets the cut instead (where each label occurs CUT_LEAST times there; else all rows do both). Labels
    other than 0 and 1 and null ids are left out; an id that repeats counts once, with its smallest label and text.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != 0)).groupBy(F.col(id_col).alias("l_id")).agg(F.min(label_col).cast("double").alias("label"))
    bound = known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    own = docs.select(F.col(f"`{id_col}`").alias("d_id"), F.col(f"`{text_col}`").alias("t"))
    texts = own.join(F.broadcast(bound), F.col("d_id") == F.col("l_id")).groupBy("l_id", "label").agg(F.min("t").alias("t"))
    sample = stage(texts.select("t", "label", F.xxhash64("l_id").alias("place")).mapInArrow(_distinct_terms, "terms array<int>, label double, place long"), "toxicity-sample")
    n, n1, total = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    if not 0 < n1 < n:
        return None
    shards = int(-(-total // HELD_TERMS)) or 1
    cut, shard = F.pmod("place", F.lit(CUT_FOLD)) == 0, F.pmod(F.shiftright("place", 8), F.lit(shards))
    parts = [sample.where(shard == i) for i in range(shards)]
    sides = {r["cut"]: (r["n"], r["n1"]) for r in sample.groupBy(cut.alias("cut")).agg(F.count("*").alias("n"), F.sum("label").alias("n1")).collect()}
    apart = all(CUT_LEAST <= n1_ <= n_ - CUT_LEAST for n_, n1_ in (sides.get(side, (0, 0)) for side in (True, False)))
    fitted = [p.where(~cut) if apart else p for p in parts]
    held = _part(fitted[0]) if shards == 1 else None
    options.setdefault("epochs", max(EPOCHS, -(-LEAST_STEPS // -(-int(n) // BATCH))))
    model = fit([(lambda: held) if held else (lambda p=p: _part(p)) for p in fitted], (n1 + 1) / (n + 2), **options)
    judged = [(model.margin(s.flat, s.lengths), s.y) for p in parts for s in [_part(p.where(cut) if apart else p)]]
    discard(sample)
    return calibrate(model, *(np.concatenate(x) for x in zip(*judged, strict=True)))


def score_toxicity(docs: DataFrame, model: FactorizationMachine | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5), from whole texts alone.

    Columns of these names are replaced. Null text counts as empty and gets the score of a text without terms, equal texts get
    equal scores; without a model (no labels of both kinds) every score is 0. Empty in, empty out. The model has 2**TERM_BITS
    rows whatever the vocabulary, and every term of a text counts; only those with a weight are sent to the tasks.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model and model.live())
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fm = held.value or (None, None)
        slots = np.full(1 << TERM_BITS, -1, np.int32)
        if fm:
            slots[at] = np.arange(len(at))
        cached = TextTerms(slots)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            scores = np.zeros(b.num_rows)
            for low in range(0, b.num_rows if fm else 0, SLICE):
                rows = [cached.of(t.as_py()) for t in texts.slice(low, SLICE)]
                flat = np.concatenate(rows)
                z = fm.margin(flat, np.fromiter(map(len, rows), np.int64, len(rows)))
                scores[low : low + SLICE] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    rows, names = masked(docs)
    read = rows.select(*[names[c] for c in kept], F.col(names[text_col]).alias("t"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]), "score double", "predicted int"])
    return read.mapInArrow(scored, schema).toDF(*kept, "score", "predicted")
