"""Quality rules: document statistics, fixed base rules, and boosted trees over the statistics.

Statistics are taken over whole texts in Arrow batches. The trees are fitted in numpy on
a bounded sample of labelled documents (``max_labelled``, those of the smallest id hash),
are monotonic in the features that only ever make a text worse, and score every document
from flat node arrays.

Defined cases: a null text has no words and fails the base rules; a null doc_id is passed
through; repeated rows are judged alike; labels that are null, unmatched or all of one
class leave the base rules alone to decide; an empty table gives no rows; other columns
are ignored, or passed on by ``apply``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .boosting import Forest, fit

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_LABELLED = 20_000
#: A document goes if its probability of being good is below this.
THRESHOLD = 0.5

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?"

#: name, sign of the constraint on the probability of being good
FEATURES = (("log_words", 0), ("word_length", 0), ("symbols_per_word", -1), ("duplicate_lines", -1), ("repeated_words", -1), ("upper_share", -1), ("digit_share", -1), ("marks_per_word", -1), ("distinct_share", 0), ("words_per_line", 0))

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    size = len(ids)
    if size < 2_000_000:
        windows = (w[:-2] * size + w[1:-1]) * size + w[2:]
    else:
        pairs = np.unique(w[:-1] * size + w[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + w[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    hit = np.zeros(len(words), bool)
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    for k in range(3):
        hit[k : k + n] |= again
    return int(hit.sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """STATS and FEATURES of a text."""
    words = text.split()
    n = len(words)
    solid = text.translate(None, C.WHITESPACE)
    chars = len(solid) if solid.isascii() else C.utf8_length(solid)
    less = lambda drop: len(solid) - len(solid.translate(None, drop))
    symbols = less(SYMBOLS)
    seen: set[bytes] = set()
    duplicates = n_lines = 0
    for line in text.split(b"\n"):
        if line.strip(C.WHITESPACE):
            n_lines += 1
            duplicates += line in seen
            seen.add(line)
    repeated = repeated_words(words)
    per, share = max(n, 1), max(chars, 1)
    x = (float(np.log1p(n)), chars / per, symbols / per, duplicates / max(n_lines, 1), repeated / per, less(_UPPER) / share, less(_DIGITS) / share, less(_MARKS) / per, len(set(words)) / per, n / max(n_lines, 1))
    return (n, chars, symbols, duplicates, repeated), x


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most max_labelled labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ys in C.rows_of(batches, "text", "y"):
            yield pa.RecordBatch.from_arrays([pa.array([list(statistics(t)[1]) for t in texts], pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["x", "y"])

    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.min(label).cast("int").alias("y")).orderBy(F.xxhash64("did"), "did").limit(max_labelled)
    plain = docs.select(F.col("doc_id").cast("long").alias("did"), C.text_col().alias("text"))
    rows = plain.join(F.broadcast(ids), "did").select("text", "y").mapInArrow(run, "x array<double>, y int").toPandas()  # broadcast: max_labelled rows
    return (np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float)) if len(rows) else (np.zeros((0, len(FEATURES))), np.zeros(0))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Forest:
    """A forest for the log-odds of label = 1. Rows are put in a fixed order, so equal samples give equal forests."""
    C.small_batches(docs.sparkSession)
    x, y = labelled_sample(docs, labels, label, max_labelled)
    order = np.lexsort((y, *x.T)) if len(y) else np.zeros(0, int)
    return fit(x[order], y[order], np.array([sign for _, sign in FEATURES]))


def judge(texts: list[bytes], forest: Forest, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """STATS (a row for each text), base_failed, kept."""
    got = [statistics(t) for t in texts]
    stats = np.array([s for s, _ in got], np.int64).reshape(-1, len(STATS))
    failed = np.array([base_failed(s[0], s[4]) for s, _ in got], bool)
    x = np.array([f for _, f in got], float).reshape(-1, len(FEATURES))
    good = forest.score(x) >= np.log(threshold / (1 - threshold)) if len(forest.roots) else np.ones(len(texts), bool)
    return stats, failed, ~failed & good


def verdicts(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, STATS, base_failed, kept for every row of docs. The forest's size is fixed by its parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, failed, kept = judge(C.binary(b.column("text")), forest, threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(stats[:, i]) for i in range(len(STATS))), pa.array(failed), pa.array(kept)], names=["doc_id", *STATS, "base_failed", "kept"])

    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), C.text_col().alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, kept boolean")


def apply(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(judge([t or b"" for t in C.binary(b.column(at))], forest, threshold)[2]))

    C.small_batches(docs.sparkSession)
    return C.mapped(docs, run)
