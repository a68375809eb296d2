"""Language identification by interpolated Kneser-Ney character models, one per language.

Training takes a bounded sample of labelled rows (``max_docs`` whole texts and ``max_chars`` characters a language,
by hash order) to the driver. The grams of all languages share sorted arrays of 64-bit keys; each key has one row of
fully interpolated log probabilities, a column per language, so a text's characters are looked up once for all
languages. A gram that no language has falls back to the context's interpolation weight and the next lower order.
The text's language is the one of lowest cross-entropy per character; a text whose cross-entropy lies above what the
calibration texts of that language show is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from leafwise.llm.common import mapped

ORDER = 4
PAD = 3
#: Characters a model tells apart; rarer ones share a code.
ALPHABET = 510
UNDETERMINED = "und"
SLICE = 1_000_000


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codepoints(text: str) -> np.ndarray:
    """Lower-case letters with one space before each run and ``PAD`` in front; empty without letters."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[cps]
    if not alpha.any():
        return np.zeros(0, np.uint32)
    keep = alpha.copy()
    keep[:-1] |= alpha[1:]
    out = np.where(alpha, cps, 32)[keep]
    return np.concatenate([np.full(PAD, 32, np.uint32), out])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not keys.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # code point -> code, by its sorted array
    points: np.ndarray
    p2: np.ndarray  # [previous * A + code, language]
    keys3: np.ndarray
    p3: np.ndarray
    g3: np.ndarray  # weight of order 2 behind each pair, [pair, language]
    keys4: np.ndarray
    p4: np.ndarray
    ctx4: np.ndarray
    g4: np.ndarray
    limits: np.ndarray

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def encode(self, cps: np.ndarray) -> np.ndarray:
        at, hit = _find(self.points, cps)
        return np.where(hit, self.codes[at] if self.codes.size else 1, 1).astype(np.uint64)

    def log_probs(self, c: np.ndarray) -> np.ndarray:
        """Log probability of each code after the first ``PAD``, a column per language."""
        a = np.uint64(ALPHABET + 2)
        c1, c2, c3, c4 = c[:-3], c[1:-2], c[2:-1], c[3:]
        ctx3 = (c1 * a + c2) * a + c3
        at, hit = _find(self.keys4, ctx3 * a + c4)
        out = np.empty((c4.size, len(self.languages)), np.float32)
        out[hit] = self.p4[at[hit]]
        if not (miss := np.flatnonzero(~hit)).size:
            return out
        pair, last = c2[miss] * a + c3[miss], c4[miss]
        low = self.g3[pair] + self.p2[c3[miss] * a + last]
        at, hit = _find(self.keys3, pair * a + last)
        low[hit] = self.p3[at[hit]]
        at, hit = _find(self.ctx4, ctx3[miss])
        low[hit] += self.g4[at[hit]]
        out[miss] = low
        return out

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, confidence, cross-entropy, rejected) of each text."""
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts), np.int64)
        held, owner, room = [], [], 0

        def flush() -> None:
            nonlocal held, owner, room
            if held:
                sizes = np.array([h.size for h in held])
                logs = self.log_probs(np.concatenate(held))
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                for i in range(1, PAD + 1):  # those that follow another text's end predict only padding
                    logs[(starts[1:] - i)[starts[1:] - i < len(logs)]] = 0
                sums = np.add.reduceat(logs, np.minimum(starts, len(logs) - 1), axis=0, dtype=np.float64)
                np.add.at(total, owner, sums)
                np.add.at(count, owner, sizes - PAD)
            held, owner, room = [], [], 0

        for i, text in enumerate(texts):
            for at in range(0, len(text or ""), SLICE):
                c = codepoints(text[at : at + SLICE])
                if c.size:
                    held.append(self.encode(c))
                    owner.append(i)
                    room += c.size
                    if room > SLICE:
                        flush()
        flush()
        out = []
        for logs, n in zip(total, count.tolist(), strict=True):
            if not n or not self.languages:
                out.append((UNDETERMINED, 0.0, None, True))
                continue
            entropy = -logs / n
            best = int(np.argmin(entropy))
            share = np.exp(-(entropy - entropy[best]) * min(n, 40))
            out.append((self.languages[best], float(1 / share.sum()), float(entropy[best]), bool(entropy[best] > self.limits[best] + 4 / n**0.5)))
        return out


def _counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs (or the sum of its weights)."""
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights, found.size).astype(float)


def fit(samples: dict[str, list[str]], calibrate: float = 0.2) -> Model:
    """A model of the sampled texts; every fifth text of a language only serves to set its rejection limit."""
    langs = sorted(samples)
    size = ALPHABET + 2
    a = np.uint64(size)
    split = max(2, round(1 / calibrate))
    learn = {k: [c for i, t in enumerate(v) if len(v) < split or i % split for c in [codepoints(t)] if c.size] for k, v in samples.items()}
    every = np.concatenate([c for v in learn.values() for c in v] or [np.zeros(0, np.uint32)])
    points, seen = np.unique(every[every != 32], return_counts=True)
    points = np.sort(points[np.argsort(-seen, kind="stable")[:ALPHABET]])
    points = np.concatenate([[32], points]).astype(np.uint32)
    points, codes = np.sort(points), np.zeros(points.size, np.uint64)
    codes[points != 32] = np.arange(2, points.size + 1)
    model = Model(langs, codes, points, *[np.zeros(0)] * 7, np.zeros(0), np.zeros(0))
    tables = {}
    for lang in langs:
        grams = [(((c[:-3] * a + c[1:-2]) * a + c[2:-1]) * a + c[3:]) for x in learn[lang] if (c := model.encode(x)).size > PAD]
        k4, n4 = _counts(np.concatenate(grams or [np.zeros(0, np.uint64)]))
        k3, n3 = _counts(k4 % a**np.uint64(3))  # continuation counts: distinct preceding characters
        k2, n2 = _counts(k3 % (a * a))
        k1, n1 = _counts(k2 % a)
        tables[lang] = (k4, n4, k3, n3, k2, n2, k1, n1)

    def discount(n: np.ndarray) -> float:
        ones, twos = (n == 1).sum(), (n == 2).sum()
        return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9))

    keys4 = np.unique(np.concatenate([t[0] for t in tables.values()] or [np.zeros(0, np.uint64)]))
    keys3 = np.unique(np.concatenate([t[2] for t in tables.values()] or [np.zeros(0, np.uint64)]))
    ctx4 = np.unique(keys4 // a)
    n = len(langs)
    p2, g3 = np.zeros((size * size, n), np.float32), np.zeros((size * size, n), np.float32)
    p3, p4, g4 = (np.zeros((x, n), np.float32) for x in (keys3.size, keys4.size, ctx4.size))
    for j, lang in enumerate(langs):
        k4, n4, k3, n3, k2, n2, k1, n1 = tables[lang]
        one = np.full(size, 0.0)
        one[k1.astype(int)] = n1
        one = (one + 0.5) / (one.sum() + 0.5 * size)
        d, sums, kinds = discount(n2), np.zeros(size), np.zeros(size)
        np.add.at(sums, (k2 // a).astype(int), n2)
        np.add.at(kinds, (k2 // a).astype(int), 1)
        two = np.where(sums > 0, d * kinds / np.maximum(sums, 1), 1.0)[:, None] * one[None, :]
        two.ravel()[k2.astype(int)] += (n2 - d) / sums[(k2 // a).astype(int)]
        d, (c3, s3), kinds3 = discount(n3), _counts(k3 // a, n3), _counts(k3 // a)[1]
        weight = np.ones(size * size)
        weight[c3.astype(int)] = d * kinds3 / s3
        three = weight[(keys3 // a).astype(int)] * two.ravel()[(keys3 % (a * a)).astype(int)]
        at, hit = _find(k3, keys3)
        ctx = np.searchsorted(c3, k3 // a)
        three[hit] += ((n3 - d) / s3[ctx])[at[hit]]
        d, (c4, s4), kinds4 = discount(n4), _counts(k4 // a, n4), _counts(k4 // a)[1]
        four_weight = np.ones(ctx4.size)
        at, hit = _find(c4, ctx4)
        four_weight[hit] = (d * kinds4 / s4)[at[hit]]
        low_at, low_hit = _find(keys3, keys4 % a**np.uint64(3))
        four = four_weight[np.searchsorted(ctx4, keys4 // a)] * np.where(low_hit, three[low_at] if three.size else 0, 1e-9)
        at, hit = _find(k4, keys4)
        four[hit] += ((n4 - d) / s4[np.searchsorted(c4, k4 // a)])[at[hit]]
        with np.errstate(divide="ignore"):
            p2[:, j], g3[:, j], p3[:, j], p4[:, j], g4[:, j] = (np.log(x) for x in (two.ravel(), weight, three, four, four_weight))
    model.p2, model.g3, model.keys3, model.p3, model.keys4, model.p4, model.ctx4, model.g4 = p2, g3, keys3, p3, keys4, p4, ctx4, g4
    model.limits = np.full(n, np.inf)
    limits = []
    for lang in langs:
        texts = [t for i, t in enumerate(samples[lang]) if len(samples[lang]) >= split and not i % split] or samples[lang]
        own = [s[2] for s in model.score(texts) if s[2] is not None]
        limits.append(float(np.quantile(own, 0.99)) * 1.4 + 0.3 if own else np.inf)
    model.limits = np.array(limits)
    return model


def training_sample(df: DataFrame, lang_col: str, text_col: str, key_col: str, max_docs: int, max_chars: int) -> dict[str, list[str]]:
    """At most ``max_docs`` texts of ``max_chars`` characters in all, for each label, in order of a hash of the key."""
    base = df.select(df[lang_col].alias("lang"), df[text_col].alias("text"), F.xxhash64(df[key_col].cast("string"), F.lit("sample")).alias("h"))
    base = base.where("lang is not null and text is not null and length(text) <= " + str(max_chars))
    sizes = {r[0]: r[1] for r in base.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2.0 * max_docs / n))])
    near = base.where((F.shiftrightunsigned("h", 11) / float(1 << 53)) < share[F.col("lang")])  # about 2 max_docs a label
    order = W.partitionBy("lang").orderBy("h", "text")
    taken = near.withColumn("k", F.row_number().over(order)).withColumn("c", F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out: dict[str, list[str]] = {}
    for r in taken.where((F.col("k") <= max_docs) & (F.col("c") <= max_chars)).orderBy("lang", "k").select("lang", "text").collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", max_docs: int = 300, max_chars: int = 1_000_000, max_total: int = 100_000_000) -> Model:
    """Fits the models on a bounded sample: ``max_docs`` rows and ``max_chars`` characters of each label at most, and fewer
    characters of each where the labels would have more than ``max_total`` together.
    Null labels and texts are left out; with no labelled rows the model knows no language and calls all texts und."""
    n = df.where(df[lang_col].isNotNull()).select(lang_col).distinct().count()
    return fit(training_sample(df, lang_col, text_col, key_col, max_docs, min(max_chars, max_total // max(1, n))))


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``, in one narrow pass; ``prefix``
    comes before the new names, for tables that have such columns.

    A null text, or one without letters, is ``und`` with score 0 and rejected. Equal scores go to the first language
    in code point order. The broadcast model is bounded by the training sample."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(chunk: pa.RecordBatch) -> dict:
        got = shared.value.score(chunk.column(text_col).to_pylist())
        kinds = (("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_()))
        return {prefix + name: pa.array([g[k] for g in got], kind) for k, (name, kind) in enumerate(kinds)}

    source = df.select(*dict.fromkeys([*keep, text_col]))
    schema = "".join(f"`{k}` {source.schema[k].dataType.simpleString()}, " for k in keep)
    return mapped(source, kernel, text_col, schema + f"{prefix}lang_pred string, {prefix}score double, {prefix}cross_entropy double, {prefix}rejected boolean", keep)
