"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Pass one computes each text's figures and the rules' votes and stores them (a few numbers a row). The counts of
distinct vote patterns, at most 3 to the power of the number of rules and so bounded whatever the input, go to the
driver, where expectation-maximisation estimates each rule's accuracy in either class. The posterior of each pattern
is then a lookup joined back by the pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafwise.llm.common import binary, mapped, stored

SPACE = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, MARKS = bytes(range(65, 91)), bytes(range(97, 123)), b"!?"
WINDOW = 8
#: Words over which the share of distinct ones is taken: it falls as a text grows, so long texts count window by window.
VARIETY_WORDS = 1000
#: Frequent function words of several languages; texts of none of them get no vote against them.
STOPWORDS = frozenset(w.encode() for w in "the of and to in is that for was with der die und das ist von mit zu den nicht de la le et les des en un une que el los por con del se las y".split())
#: Prior of the share of good texts that a rule votes against, and its weight as a part of all texts: it keeps the classes
#: from changing sides and is the same for every rule. What a rule is worth is estimated.
FALSE_ALARM, FALSE_ALARM_WEIGHT = 0.02, 0.2
#: Rules whose abstention says nothing: they vote either way where they can judge.
SILENT = ("length", "word_size", "variety")
RULES = ("length", "symbols", "lines", "repeats", "word_size", "capitals", "marks", "stopwords", "variety")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[at]  # equal keys are checked word by word
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[inverse.ravel()] > 1]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def figures(data: bytes | None) -> dict:
    data = data or b""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    solid = data.translate(None, SPACE)
    n = len(words)
    upper, lower = (len(data) - len(data.translate(None, x)) for x in (UPPER, LOWER))
    return {
        "n_words": n,
        "word_chars": len(solid.translate(None, CONTINUATION)),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "upper": upper / max(1, upper + lower),
        "marks": (len(data) - len(data.translate(None, MARKS))) / max(1, n),
        "stop": sum(w in STOPWORDS for w in data.lower().split()) / max(1, n),
        "variety": sum(len(set(words[k : k + VARIETY_WORDS])) for k in range(0, n, VARIETY_WORDS)) / max(1, n),
    }


def votes(f: dict) -> list[int]:
    """Of each rule: 1 good, -1 bad, 0 abstains."""
    n = max(1, f["n_words"])

    flag = lambda x, bad: -1 if x > bad else 0  # noqa: E731  signs of junk vote against a text or abstain
    size = f["word_chars"] / n
    return [
        1 if f["n_words"] >= 60 else -1 if f["n_words"] < 20 else 0,
        flag(f["n_symbols"] / n, 0.2),
        flag(f["n_dup_lines"] / max(1, f["n_lines"]), 0.3),
        flag(f["n_repeat_words"] / n, 0.2),
        1 if 3 <= size <= 9 else -1 if size < 2 or size > 14 else 0,
        flag(f["upper"], 0.6),
        flag(f["marks"], 0.3),
        1 if f["stop"] >= 0.05 else 0,
        0 if f["n_words"] < 40 else -1 if f["variety"] < 0.12 else 1 if f["variety"] > 0.3 else 0,
    ]


def fit_votes(patterns: dict[str, int], rounds: int = 100, prior: float = 0.85) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation over two classes.

    A pattern is one character a rule: + good, - bad, 0 abstains. It starts from the sign of the votes; each rule's table
    of outcomes by class is estimated with a Dirichlet prior, the rate of false alarms with ``FALSE_ALARM``."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    v = np.array([[{"+": 2, "-": 0, "0": 1}[c] for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    good, bad = (v == 2).sum(1), (v == 0).sum(1)
    post = np.where(bad > 0, 0.1, 0.5 + 0.45 * (good > 0))  # a sign of junk outweighs the votes for, which come cheap
    for _ in range(rounds):
        weights = np.stack([n * (1 - post), n * post])
        pi = (weights.sum(1) + [2 * (1 - prior), 2 * prior]) / (n.sum() + 2)
        log = np.tile(np.log(pi)[:, None], (1, len(keys)))
        for j in range(v.shape[1]):
            table = np.stack([np.bincount(v[:, j], w, 3) for w in weights]) + np.array([[1.0, 1.0, 0.5], [0.2, 1.0, 1.5]])
            weight = FALSE_ALARM_WEIGHT * n.sum()
            alarms = (np.bincount(v[:, j], weights[1], 3)[0] + FALSE_ALARM * weight) / (weights[1].sum() + weight)
            table[1] = [alarms, *(table[1, 1:] / table[1, 1:].sum() * (1 - alarms))]
            table[0] /= table[0].sum()
            told = np.log(table)[:, v[:, j]]
            if RULES[j] in SILENT:
                told = np.where(v[:, j] == 1, 0.0, told - np.log(1 - table[:, 1:2]))
            log += told
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(keys, map(float, post), strict=True))


FIELDS = [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, the figures, ``base_failed``, ``votes``, ``quality`` (posterior) and ``kept``.

    A null text counts as empty: no words, so it fails the base rules. Repeated rows and null ids pass as they are;
    an empty table gives an empty result; other columns are not read. One pass over the texts; nothing larger than
    the table of patterns reaches the driver."""

    def kernel(chunk: pa.RecordBatch) -> dict:
        rows = [figures(t) for t in binary(chunk.column("text")).to_pylist()]
        marks = ["".join("-0+"[x + 1] for x in votes(r)) for r in rows]
        return {k: pa.array([r[k] for r in rows], kind) for k, kind in FIELDS} | {"votes": pa.array(marks, pa.string())}

    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} bigint" for k, _ in FIELDS) + ", votes string"
    counted = stored(mapped(source, kernel, "text", schema, ("doc_id",)))
    patterns = {r[0]: r[1] for r in counted.groupBy("votes").count().collect()}
    fitted = fit_votes(patterns)
    lookup = df.sparkSession.createDataFrame(list(fitted.items()), "votes string, quality double")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (
        counted.join(F.broadcast(lookup), "votes", "left")  # at most 3 ** len(RULES) rows
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.coalesce("quality", F.lit(0.0)) >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")
    )
