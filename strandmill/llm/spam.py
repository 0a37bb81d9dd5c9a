"""Pages that are spam: repeated keywords, runs of links or product tags instead of sentences.

Method: of each text, the gaps after which its terms recur and its positional autocorrelation (how often the term `lag` places before is the same), taken with
lag windows over term positions; unnaturally regular repetition, and long stretches of many distinct nouns without function words, mark spam. These signals alone decide:
a fixed prior over four of them, corrected by small gradient-boosted trees that are fitted to the labelled rows there are - none, a handful or SAMPLE -
in the same way. Links are one term, and so are tags, whatever they name; words that marks break into bits of one or two letters are mended first.

Signals are taken where the texts are; the driver gets those of the labelled rows only, SAMPLE rows of numbers at most.

Defined cases: null texts and those without any word are no spam; labels that are null, neither 0 nor 1, or of unknown documents don't count; of several labels
of a document one counts; without labels the prior decides.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.runs import strings

SAMPLE = 4_000  # labelled rows that are fitted at most
LAGS = 24
WINDOW = 25  # terms of a stretch
ROWS = 250  # texts handled at once

TERM = re.compile(r"https?://\S+|#[^\W_]\w+|[^\W\d_]+(?:\d+[^\W_]*)?|\d[\w]*")
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
MARK = re.compile("[*._]")
BIT = re.compile(r"[*._][^\W\d_]{1,2}[*._]")
BROKEN = re.compile(r"(?<![^\W\d_])[^\W\d_]{0,2}(?:[*._][^\W\d_]{1,2}){2,}(?![^\W\d_])[*._]?")
# Function words of several languages.
FUNCTION = frozenset(
    """a an and are as at be been but by for from had has have he her his if in into is it its may not of on or she so than that the their them then there these they this to was
    were when where which while who will with der die das den dem des ein eine einen einem und oder nicht ist war wird sind am an auf aus bei bis durch im in mit nach seit sich um von vom vor zu zum zur
    le la les un une des du de et ou est sont dans par pour sur que qui ne pas se au aux fut il elle el los las uno una y o en con del al por para es no lo su sus fue son como
    и в во не на он она оно с со как а то все но да к у же за по из от о об для это его ее при был было были до ни что и η ο το οι τα των του της και σε με για από στο στη την τον είναι δεν
    في من على إلى عن أن هو هي كان التي الذي ولا ما لا و""".split()
)
SIGNALS = [
    "log_terms", "function", "distinct", "top1", "top3", "top10", "recur_near", "recur_any", "gap_cv", "gap_steady", "gap_mean", "auto_max", "auto_mean", "auto_lag",
    "listlike", "nounlike",
]
# The prior: (signal, middle, reach, weight). A signal adds from -weight at middle - reach to +weight at middle + reach.
PRIOR = (("recur_near", 0.25, 0.15, 1.0), ("function", 0.15, 0.1, -1.0), ("auto_mean", 0.03, 0.02, 0.5), ("listlike", 0.3, 0.3, 0.5))
PRIOR_BASE = -0.5


def _terms(text: str) -> list[str]:
    plain = HIDDEN.sub("", text)
    if BIT.search(plain):
        plain = BROKEN.sub(lambda m: MARK.sub("", m[0]), plain)
    return ["<url>" if w[:4] == "http" and "://" in w else "<tag>" if w[0] == "#" else w for w in TERM.findall(plain.lower())]


@functools.lru_cache(200_000)
def _marks(w: str) -> int:
    """Whether a term is a function word, a link or tag or number: a bit for each."""
    return (w in FUNCTION) | (w[0] == "<" or w.isdigit()) << 1


def signals(texts: list[str]) -> np.ndarray:
    """One row of SIGNALS for each text."""
    lists = list(map(_terms, texts))
    n = np.array([len(x) for x in lists], np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    flat = [w for x in lists for w in x]
    code, vocabulary = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
    code = code.astype(np.int64)
    per = np.maximum(n, 1)
    share = lambda mask: np.bincount(doc, mask, len(texts)) / per
    marks = np.fromiter(map(_marks, vocabulary), np.uint8, len(vocabulary))[code] if flat else np.zeros(0, np.uint8)
    function, other = marks & 1 > 0, marks & 2 > 0
    f: dict[str, np.ndarray] = {"log_terms": np.log1p(n), "function": share(function)}

    # Recurrence: positions in the order of (text, term, position); a lag over it gives the gap to the term's last occurrence, a second one the gap before.
    order = np.lexsort((np.arange(len(code)), code, doc))
    same = np.zeros(len(code), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (code[order][1:] == code[order][:-1])
    gap = np.zeros(len(code))
    gap[1:] = np.where(same[1:], np.diff(order), 0)
    again = same.copy()
    again[1:] &= same[:-1]
    steady = again.copy()
    steady[1:] &= np.abs(gap[1:] - gap[:-1]) <= 1
    at = doc[order]
    f["recur_any"], f["recur_near"] = np.bincount(at, same, len(texts)) / per, np.bincount(at, same & (gap <= 12), len(texts)) / per
    gaps = np.maximum(np.bincount(at, same, len(texts)), 1)
    mean = np.bincount(at, gap, len(texts)) / gaps
    f["gap_mean"] = np.log1p(mean)
    f["gap_cv"] = np.sqrt(np.maximum(np.bincount(at, gap**2, len(texts)) / gaps - mean**2, 0)) / np.maximum(mean, 1)
    f["gap_steady"] = np.bincount(at, steady, len(texts)) / np.maximum(np.bincount(at, again, len(texts)), 1)
    first = np.flatnonzero(~same)
    counts = np.diff(np.append(first, len(code)))
    rank = np.lexsort((-counts, at[first])) if len(first) else np.zeros(0, np.int64)
    d, c = at[first][rank], counts[rank]
    f["distinct"] = np.bincount(d, minlength=len(texts)) / per
    place = np.arange(len(d)) - np.searchsorted(d, d)
    for k in (1, 3, 10):
        f[f"top{k}"] = np.bincount(d, np.where(place < k, c, 0), len(texts)) / per

    # Positional autocorrelation by lag.
    auto = np.zeros((len(texts), LAGS))
    for lag in range(1, LAGS + 1):
        hit = (code[lag:] == code[:-lag]) & (doc[lag:] == doc[:-lag])
        auto[:, lag - 1] = np.bincount(doc[lag:], hit, len(texts)) / np.maximum(n - lag, 1)
    f["auto_max"], f["auto_mean"], f["auto_lag"] = auto.max(1), auto.mean(1), auto.argmax(1).astype(float)

    # Stretches of WINDOW terms within a text: without function words, and most of them words.
    stretch = (np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)) // WINDOW
    key = np.cumsum(np.append(0, np.maximum(-(-n // WINDOW), 1)))
    cell = key[doc] + stretch
    size = np.maximum(np.bincount(cell, minlength=key[-1]), 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(key))
    words = np.bincount(cell, ~other, key[-1])
    bare = np.bincount(cell, function, key[-1]) <= 0.04 * size
    cells = np.maximum(np.bincount(owner, size, len(texts)), 1)
    f["listlike"] = np.bincount(owner, bare * size, len(texts)) / cells
    f["nounlike"] = np.bincount(owner, (bare & (words > 0.6 * size)) * size, len(texts)) / cells
    return np.column_stack([f[x] for x in SIGNALS])


def prior(x: np.ndarray) -> np.ndarray:
    """The score before any label: terms that recur soon and at regular lags, and stretches with hardly a function word."""
    out = np.full(len(x), PRIOR_BASE)
    for name, middle, reach, weight in PRIOR:
        out += weight * np.clip((x[:, SIGNALS.index(name)] - middle) / reach, -1, 1)
    return out


class Boosted:
    """Gradient boosting of shallow trees on binned features, for two classes, from a given score of each row. Each tree sees a share of the rows and
    of the features, so that a few dozen labels are not fitted by a single lucky feature."""

    def __init__(self, rounds: int = 200, depth: int = 2, rate: float = 0.15, bins: int = 32, least: float = 0.3, rows: float = 0.7, columns: float = 0.3, seed: int = 0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.rows, self.columns, self.seed = rows, columns, seed
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, score: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        if not len(x):
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            picked = np.sort(rng.choice(x.shape[1], max(1, int(self.columns * x.shape[1])), replace=False))
            tree = self._tree(x, binned, edges, g, h, np.flatnonzero(rng.random(len(y)) < self.rows), picked)
            self.trees.append(tree)
            score = score + tree[2][self._leaf(tree, x)]
        return self

    def _tree(self, x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature and cut of each inner node, value of each leaf); a node without a useful cut sends all rows to its left."""
        width, across, inner = self.bins + 1, np.arange(len(picked)), 2**self.depth - 1
        feature, cut = np.full(inner, picked[0]), np.full(inner, np.inf)
        node = np.zeros(len(rows), int)
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            here = rows[mine]
            if len(here) >= 4:
                flat = (binned[np.ix_(here, picked)] + across * width).ravel()
                gs, hs = (np.bincount(flat, np.repeat(v[here], len(picked)), width * len(picked)).reshape(-1, width).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best, at = divmod(int(gain.argmax()), width)
                if gain.max() > 1e-6 and at < len(edges[picked[best]]):
                    feature[i], cut[i] = picked[best], edges[picked[best]][at]
            node[mine] = 2 * i + 1 + (x[here, feature[i]] > cut[i])
        node -= inner
        value = np.bincount(node, g[rows], inner + 1) / (np.bincount(node, h[rows], inner + 1) + 1)
        return feature, cut, value * self.rate

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, _ = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return node - len(feature)

    def score(self, x: np.ndarray) -> np.ndarray:
        """What the trees add to the given score."""
        out = np.zeros(len(x))
        for tree in self.trees:
            out += tree[2][self._leaf(tree, x)]
        return out


class Model:
    """The prior and the trees fitted to labelled rows of SIGNALS."""

    def __init__(self, x: np.ndarray, labels: np.ndarray) -> None:
        self.trees = Boosted().fit(x, labels, prior(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Above 0 for spam; texts without a term get -inf."""
        return np.where(x[:, SIGNALS.index("log_terms")] > 0, prior(x) + self.trees.score(x), -np.inf)


def _by_rows(df: DataFrame, key: str, text: str, of, name: str, kind: str) -> DataFrame:
    """(key, name), with of(signals of some texts) as the values of the new column; rows with null texts are left out."""
    key_kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), of(signals(strings(part.column(1))))], names=["k", name])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(run, f"k {key_kind}, {name} {kind}").withColumnRenamed("k", key)


def spam_signals(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, signals ARRAY<DOUBLE>, in the order of SIGNALS) of every row with a text."""
    return _by_rows(df, key, text, lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(SIGNALS)).cast(pa.list_(pa.float64())), "signals", "array<double>")


def fit(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, sample: int = SAMPLE) -> Model:
    """labels: rows (label_key, label 0 or 1). At most `sample` of them, picked by a hash, are looked up and fitted; others don't matter."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(picked), "k")  # at most `sample` labels
    found = spam_signals(rows.select(F.struct("k", "y").alias("row"), "t"), "row", "t").select("row.k", "row.y", "signals").orderBy(F.xxhash64("k"), "k", "signals").limit(sample).collect()
    return Model(np.array([r.signals for r in found], float).reshape(-1, len(SIGNALS)), np.array([r.y for r in found], np.int64))


def spam_scores(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, score) of every row with a text; spam is what has a score above 0."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # 200 small trees
    return _by_rows(df, key, text, lambda x: pa.array(sent.value.score(x)), "score", "double")
