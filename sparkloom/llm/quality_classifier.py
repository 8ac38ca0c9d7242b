"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal.

The statistics come from the whole text alone: lengths, shares of kinds of characters, how words and lines repeat. Spark ML grows the
trees (features in MAX_BINS bins, node histograms summed over tasks; each tree sees a part of the rows, each node a third of the
features) on a sample of TRAIN_ROWS labelled documents at most, the first by
hash of the doc_id, none of them held out. Their nodes are laid out as arrays of feature, threshold, children and value; a task walks
all trees for a run of documents at once. Documents aren't shuffled: one pass for the sample's texts, one for the scores.

Held out are the rows whose crc32(doc_id as text) mod 3 is 1; labels of these are never read.

Cases: a null text is the empty text, which is scored like any other; a null doc_id isn't held out and has no label; a doc_id with
several labels counts once, by their mean (a half counts as 1); null labels are left out; of rows that repeat a labelled doc_id the one
with the least statistics is learnt from, and each is scored; labels without a document are left out; with labels of one kind only
every score is that kind, without any 0.5; very long texts are taken whole; empty table, empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _hashes as H
from sparkloom.llm._base import documents, dropped, stored

TRAIN_ROWS = 20_000
TREES, DEPTH, MAX_BINS, STEP, SEED = 40, 4, 64, 0.2, 7
#: Bytes of text that a task works on at once (or one longer text).
RUN_BYTES = 1 << 20


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


KINDS = {
    "upper": _table(bytes(range(65, 91))),
    "digit": _table(b"0123456789"),
    "symbol": _table(b"#*$%&|<>"),
    "shout": _table(b"!?"),
    "stop": _table(b".,;:"),
    "space": H.SPACE,
    "line": _table(b"\n"),
    "wide": _table(bytes(range(192, 256))),
    "other": _table(b"\"'()[]{}/\\@_=+-~^`"),
}
FEATURES = (*KINDS, "chars", "words", "word_length", "word_spread", "distinct", "top_word", "again", "windows", "line_length", "distinct_lines")


def _groups(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (document, hash) pairs: each document's number of different hashes, of the most frequent one, and of those that stand alone."""
    key, first, count = np.unique(H.mix(h + doc.astype(np.uint64) * np.uint64(H.BASE)), return_index=True, return_counts=True)
    of, most = doc[first], np.zeros(n, np.int64)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=n), most, np.bincount(of[count == 1], minlength=n)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(size) - size
    total = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    n_bytes = np.maximum(size - 1, 1)
    out = [total(table[data]) / n_bytes for table in KINDS.values()]
    h, at = H.word_hashes(texts)
    inside = ~H.SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    length = edge[1::2] - edge[::2]
    words = np.diff(at)
    doc = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, n) / some - mean**2, 0))
    distinct, most, _ = _groups(doc, h, n)
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    three = H.mix(h[:-2] + H.mix(h[1:-1] + H.mix(h[2:])))
    inner = doc[2:] == doc[:-2]
    _, _, alone = _groups(doc[:-2][inner], three[inner], n)
    # a line's hash: all its bytes' polynomial, moved to one place
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    p = H.prefix(data)
    line = (p[ends] - p[begins]) * H.powers(len(data) + 1)[1][begins]
    line_doc = np.searchsorted(starts, begins, "right") - 1
    full = ends > begins
    lines = np.maximum(np.bincount(line_doc[full], minlength=n), 1)
    different, _, _ = _groups(line_doc[full], line[full], n)
    out += [np.log1p(size - 1), np.log1p(words), mean, spread, distinct / some, most / some, again / some, np.maximum(words - 2 - alone, 0) / np.maximum(words - 2, 1), words / lines, different / lines]
    return np.stack(out, axis=1)


def _with_statistics(keep: list[str], column: str, of):
    """A mapInArrow function: the columns `keep`, and `column`, made by `of` from the texts' statistics."""

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            found = [of(statistics(part)) for _, part in H.chunks(texts, RUN_BYTES)]
            if found:
                yield pa.record_batch([*(b.column(c) for c in keep), pa.concat_arrays(found)], names=[*keep, column])

    return run


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Trees:
    """Boosted trees as arrays, one row a tree: feature (-1: a leaf), threshold, left, right, value."""

    def __init__(self, trees: list[list[tuple]], weights: list[float]):
        wide = max(len(t) for t in trees)
        laid = np.array([t + [(-1, 0.0, 0, 0, 0.0)] * (wide - len(t)) for t in trees], dtype=float)
        self.feature, self.left, self.right = (laid[:, :, k].astype(np.int64) for k in (0, 2, 3))
        self.threshold, self.value, self.weights = laid[:, :, 1], laid[:, :, 4], np.array(weights)

    @classmethod
    def of_model(cls, model) -> Trees:
        """The nodes of a fitted Spark ML model, each tree's in depth-first order."""

        def lay(node, out: list) -> int:
            at = len(out)
            out.append(None)
            if node.subtreeDepth() == 0:
                out[at] = (-1, 0.0, at, at, node.prediction())
            else:
                split = node.split()
                out[at] = (split.featureIndex(), split.threshold(), lay(node.leftChild(), out), lay(node.rightChild(), out), 0.0)
            return at

        trees = []
        for tree in model.trees:
            lay(tree._call_java("rootNode"), nodes := [])
            trees.append(nodes)
        return cls(trees, model.treeWeights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row: all rows go down a tree together, a level a step."""
        margin, row = np.zeros(len(x)), np.arange(len(x))
        for k, weight in enumerate(self.weights):
            at = np.zeros(len(x), np.int64)
            while (inner := self.feature[k, at] >= 0).any():
                goes_left = x[row, self.feature[k, at]] <= self.threshold[k, at]
                at = np.where(inner, np.where(goes_left, self.left[k, at], self.right[k, at]), at)
            margin += weight * self.value[k, at]
        return 1 / (1 + np.exp(-2 * margin))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, label, x (statistics) of at most train_rows labelled documents that aren't held out, stored."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
    one = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # at most train_rows rows are sent
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    seen = texts.mapInArrow(_with_statistics(["doc_id", "label"], "x", lists), "doc_id long, label double, x array<double>")
    return stored(seen.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id"))


def fit(train: DataFrame) -> Trees | float:
    """Trees, or the score of all where there is nothing to tell apart."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    kinds = sorted(r["label"] for r in train.select("label").distinct().collect())
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.5
    grower = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=MAX_BINS, stepSize=STEP, subsamplingRate=0.6, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED)
    return Trees.of_model(grower.fit(train.coalesce(2).select("label", array_to_vector("x").alias("features"))))


def scored(docs: DataFrame, model: Trees | float) -> DataFrame:
    """doc_id, score of every document."""
    of = lambda x: pa.array(model.scores(x) if isinstance(model, Trees) else np.full(len(x), model))
    return docs.select("doc_id", "text").mapInArrow(_with_statistics(["doc_id"], "score", of), "doc_id long, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels: doc_id and the column named by `label` (0 or 1)."""
    train = training_rows(docs, labels, label, train_rows)
    model = fit(train)
    dropped(train)
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
