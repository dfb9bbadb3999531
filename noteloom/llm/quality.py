"""Operator 9: quality rules and an isolation forest over their statistics.

Rules count words, symbols, repeated lines and repeated 3-word windows of each whole text. An isolation forest, fitted on
a bounded sample (the `SAMPLE` labelled documents with the smallest hashed ids), gives each document a path length over
random splits of those statistics; the threshold is the one that separates the sample's quality labels best, among those
that keep at least `KEEP` of its good documents. Every document is scored. The query's least number of words is the
contract's 50; the corpus stage takes the largest one, up to that, that keeps `KEEP` of the good documents by itself, as
many short documents are labelled good.

Nulls: a null text has no words, so it fails the base rules. Labels that are null, or of ids that are absent, are not
used; of several labels of an id the lowest quality counts, of several texts the least features. With no labels at all the
forest is not used and the base rules decide. Repeated rows are judged each by itself. A very long text is read whole.
Labelled rows tie by hashed id, then id. An empty table gives an empty table. Extra columns are kept by `judged`.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

SAMPLE = 20_000
KEEP = 0.995
TREES, SUBSAMPLE, SEED = 150, 256, 9
#: Share of rows labelled bad in a tree's subsample: few, so that they stay rare and few splits isolate them.
RARE = 0.03
SYMBOLS = "#*$%&|<>"
FEATURES = ["chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "marks_per_word", "distinct_share", "letterless_share"]
#: Least number of words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
WHITE = b" \t\n\x0b\x0c\r"
#: Letters and bytes over ASCII become a, other signs a stop; white space stays.
SHAPE = bytes(x if x in WHITE else 97 if x > 127 or bytes([x]).isalpha() else 46 for x in range(256))
#: Words without a letter in a text of shapes.
LETTERLESS = re.compile(rb"(?<![a.])\.++(?!a)")
#: The most words whose triples are numbers under 2**63.
MOST_CUBED = (1 << 21) - 1


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(words)}
    if len(number) == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * n + ids[1:]
    if n > MOST_CUBED:  # renumbered, so that keys of triples stay under 2**63
        _, pairs = np.unique(pairs, return_inverse=True)
    triples = pairs[:-1] * n + ids[2:]
    order = np.argsort(triples)
    t = triples[order]
    same = t[1:] == t[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The five rule counts of a text and the forest's features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    many = max(n, 1)
    upper = sum(1 for w in words if w.isupper())
    marks = raw.count(b"!") + raw.count(b"?")
    letterless = len(LETTERLESS.findall(raw.translate(SHAPE)))
    features = [chars / many, symbols / many, dup / max(len(lines), 1), repeat / many, upper / many, marks / many, len(set(words)) / many, letterless / many]
    return (n, chars, symbols, dup, repeat), features


class Forest:
    """Isolation trees as arrays: a node's feature (-1: leaf), split value, left child (right is next), and path length."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        usual, odd = np.flatnonzero(good), np.flatnonzero(~good)
        few = min(len(odd), round(subsample * RARE))
        many = min(len(usual), subsample - few)
        self.size = few + many
        self.trees = [self._tree(rows[np.concatenate([rng.choice(usual, many, replace=False), rng.choice(odd, few, replace=False)])], rng) for _ in range(trees)]

    @staticmethod
    def mean_path(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _tree(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, left, length = [-1], [0.0], [0], [0.0]
        todo, limit = [(0, rows, 0)], int(np.ceil(np.log2(max(self.size, 2))))
        while todo:
            node, x, depth = todo.pop()
            low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
            able = np.flatnonzero(high > low)
            if depth >= limit or len(x) < 2 or not len(able):
                length[node] = depth + self.mean_path(len(x))
                continue
            f = int(rng.choice(able))
            v = float(rng.uniform(low[f], high[f]))
            feature[node], value[node], left[node] = f, v, len(feature)
            for part in (x[x[:, f] < v], x[x[:, f] >= v]):
                todo.append((len(feature), part, depth + 1))
                for a, z in ((feature, -1), (value, 0.0), (left, 0), (length, 0.0)):
                    a.append(z)
        return np.array(feature), np.array(value), np.array(left), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for documents that few splits isolate."""
        total, index = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, left, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[index, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, left[node] + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(self.mean_path(self.size), 1e-9))


def best_threshold(scores: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The cut (scores above it go) with the best balanced accuracy that keeps at least `keep` of the good rows."""
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    lost, caught = np.cumsum(g), np.cumsum(~g)
    gain = caught / max(caught[-1], 1) - lost / max(lost[-1], 1)
    gain[(lost > (1 - keep) * max(lost[-1], 1)) | np.append(s[1:] == s[:-1], False)] = -1
    at = int(np.argmax(gain))
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else s[at])) / 2) if gain[at] > 0 else float("inf")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = SEED) -> tuple[Forest, float, int] | None:
    """Forest, threshold and calibrated least number of words from a bounded sample of labelled documents."""
    chosen = labels.select(F.col("doc_id"), F.col("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    chosen = chosen.select(F.col("doc_id").alias("label_id"), "quality")
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id")

    def features(frames):
        for f in frames:
            got = [statistics(t) for t in f.text]
            yield pd.DataFrame({"label_id": f.label_id, "quality": f.quality, "x": [g[1] for g in got], "n_words": [g[0][0] for g in got]})

    kind = rows.schema["label_id"].dataType.simpleString()
    each = rows.mapInPandas(features, f"label_id {kind}, quality int, x array<double>, n_words long")
    got = each.groupBy("label_id").agg(F.min(F.struct("quality", "x", "n_words")).alias("r")).select("label_id", "r.*").orderBy("label_id").toPandas()  # at most `sample` rows
    if got.empty or got.quality.nunique() < 2:
        return None
    x = np.array(got.x.tolist())
    good = got.quality.to_numpy() == 1
    forest = Forest(x, good, seed=seed)
    words = np.sort(got.n_words.to_numpy()[good])
    return forest, best_threshold(forest.score(x), good), int(min(LEAST_WORDS, words[int((1 - KEEP) * len(words))]))


def verdict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", calibrated: bool = False) -> Column:
    """A struct column of `RESULT` for the texts of `docs`; with `calibrated`, by the least number of words that labels give."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        least = model[2] if calibrated and model else LEAST_WORDS
        got = [statistics(t) for t in texts]
        out = pd.DataFrame([g[0] for g in got], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
        out["base_failed"] = (out.n_words < least) | (100 * out.n_repeat_words > MOST_REPEATED * out.n_words)
        if model is None or not got:
            out["score"], out["kept"] = 0.0, ~out.base_failed
        else:
            forest, threshold, _ = model
            out["score"] = forest.score(np.array([g[1] for g in got]))
            out["kept"] = ~out.base_failed & (out.score <= threshold)
        return out

    return judge(F.col(text_col))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the rule counts, base_failed, score and kept of each row."""
    v = free_name(docs, "verdict")
    return docs.select(F.col(id_col).alias("doc_id"), verdict(docs, labels, id_col, text_col).alias(v)).select("doc_id", f"{v}.*")


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept by the calibrated rules, with their columns."""
    v = free_name(docs, "verdict")
    return docs.withColumn(v, verdict(docs, labels, id_col, text_col, calibrated=True)).filter(F.col(f"{v}.kept")).select(*docs.columns)
