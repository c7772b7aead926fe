"""Quality classification by co-training on two views of a document.

The content view knows the text: which words occur (hashed) and how it is
written (repetition, capitals, symbols). The metadata view knows what a
crawler records beside the text, source, language and size, and never sees the
text. Both are logistic classifiers over log-ratios of class shares. They
start from the same labelled documents; in each round every view labels all
unlabelled documents of the corpus of which it is confident (``SURE`` by its
calibrated probability), and the *other* view takes these pseudo-labels into
its class shares. A round is one narrow pass whose tasks add up counts; only
sums for each bucket are gathered. A class's pseudo-labels weigh at most as
much as its labels. Each view's logit is calibrated on labelled documents kept
out of training, a small logistic model combines the two, and the threshold is
set on labelled documents kept out of both, so that at least ``KEEP`` of the
good ones stay.

A document is good if its quality is 1 and it isn't marked toxic; one marked
toxic is bad even if its quality is null. At most about ``LABELLED`` labelled
documents are used, chosen by the hash of doc_id; all documents take part in
the exchange and all are scored.

Edge cases: null and empty texts are scored on their metadata with an empty
content view; null source, language or size are values of their own; a
document labelled several times is good only if all its labels agree; without
labels of both kinds every document scores 0.5 and is kept; repeated rows each
get a row; documents whose doc_id is null are unlabelled; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import Shared, hashed_share, utf8

LABELLED = 12_000
KEEP = 0.995
ROUNDS = 2
#: Calibrated probability of a class from which a view hands a document to the other.
SURE = 0.95
#: Documents that a bucket needs to count, and the pull of weights to zero.
LEAST = 5
PENALTY = 1e-3
BUCKETS = 1 << 18
NAMES = 4096
DENSE_CONTENT, DENSE_META = 11, 3
_ENDS = b".,;:!?\"'()"


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = zlib.crc32(word) % BUCKETS
        return found


def content_view(text: bytes | None, buckets: Buckets) -> tuple[list[int], list[float]]:
    """Buckets of the distinct words, and numbers on how the text is written."""
    text = text or b""
    words = text.lower().translate(None, _ENDS).split()
    n, size = max(1, len(words)), max(1, len(text))
    kinds = set(words)
    lines = text.split(b"\n")
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(text.translate(None, b"0123456789")) if text else 0
    marks = size - len(text.translate(None, b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")) if text else 0
    stops = size - len(text.translate(None, b".,")) if text else 0
    shape = [
        len(kinds) / n,
        math.sqrt(len(kinds) / n),
        again / n,
        upper / size * 4,
        digits / size * 8,
        min(1.0, marks / size * 8),
        min(1.0, stops / n * 2),
        min(1.0, text.count(b"|") / n * 2),
        min(3.0, sum(map(len, kinds)) / max(1, len(kinds)) / 6),
        1 - len(set(lines)) / len(lines),
        1.0,
    ]
    return [buckets[w] for w in kinds], shape


def meta_view(source, lang, n_chars) -> tuple[list[int], list[float]]:
    level = math.log1p(max(0, n_chars or 0))
    values = {"source": source, "lang": lang, "size": None if n_chars is None else int(level * 2)}
    pairs = [*values.items(), ("source and lang", (source, lang)), ("source and size", (source, values["size"]))]
    return [zlib.crc32(f"{k}={v}".encode()) % NAMES for k, v in pairs], [level / 10, (level / 10) ** 2, 1.0]


def _features(batch, buckets):
    """For each row of (doc_id, text, source, lang, n_chars): content and metadata views."""
    texts = utf8(batch.column(1))
    others = [batch.column(k).to_pylist() for k in (2, 3, 4)]
    for text, *beside in zip(texts, *others):
        yield content_view(text, buckets), meta_view(*beside)


def _feature_pass(batches):
    buckets = Buckets()
    for batch in batches:
        rows = list(_features(batch, buckets))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([c[0] for c, _ in rows], pa.list_(pa.int32())),
                pa.array([c[1] for c, _ in rows], pa.list_(pa.float64())),
                pa.array([m[0] for _, m in rows], pa.list_(pa.int32())),
                pa.array([m[1] for _, m in rows], pa.list_(pa.float64())),
            ],
            ["doc_id", "words", "shape", "named", "layout"],
        )


class View:
    """Logistic regression on buckets (present or not) and a few numbers.

    A bucket counts by the log-ratio of its shares in both classes, so that
    words that occur alike in both have little say; buckets of fewer than
    ``LEAST`` documents have none.
    """

    def __init__(self, buckets: int, numbers: int):
        self.sparse, self.dense = np.zeros(buckets), np.zeros(numbers)

    def fit(self, index: np.ndarray, edge: np.ndarray, numbers: np.ndarray, target: np.ndarray, given: np.ndarray, turns: int = 120) -> "View":
        """Full-batch gradient steps with Adagrad rates; classes weigh the same.

        ``given`` has the buckets' counts among pseudo-labelled documents of both classes, and their numbers at last.
        """
        size = len(self.sparse)
        row = np.repeat(np.arange(len(target)), np.diff(edge))
        seen, shares = np.zeros(size), []
        for k in (0, 1):
            own, n = np.bincount(index, weights=(target == k)[row], minlength=size), (target == k).sum()
            trust = min(1.0, n / given[k, -1]) if given[k, -1] else 0.0
            shares.append((own + trust * given[k, :-1] + 1) / (n + trust * given[k, -1] + 2))
            seen += own + given[k, :-1]
        ratio = np.where(seen >= LEAST, np.log(shares[1] / shares[0]), 0.0)
        known = np.flatnonzero(ratio[index])
        index, row = index[known], row[known]
        place = np.unique(index)  # only what has a say is trained
        at, scale = np.searchsorted(place, index), ratio[place]
        weight = np.where(target > 0, 0.5 / max(1, (target > 0).sum()), 0.5 / max(1, (target == 0).sum()))
        say, seen_sparse, seen_dense = np.zeros(len(place)), np.full(len(place), 1e-8), np.full(len(self.dense), 1e-8)
        for _ in range(turns):
            raw = np.bincount(row, weights=(say * scale)[at], minlength=len(target)) + numbers @ self.dense
            slope = (_sigmoid(raw) - target) * weight
            sparse = np.bincount(at, weights=slope[row], minlength=len(place)) * scale + PENALTY * say
            dense = slope @ numbers + PENALTY * self.dense
            seen_sparse += sparse**2
            seen_dense += dense**2
            say -= 0.1 * sparse / np.sqrt(seen_sparse)
            self.dense -= 0.3 * dense / np.sqrt(seen_dense)
        self.sparse[place] = say * scale
        return self

    def logit(self, index, row, numbers, n: int) -> np.ndarray:
        return np.bincount(row, weights=self.sparse[index], minlength=n) + numbers @ self.dense


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _platt(logits: np.ndarray, target: np.ndarray, turns: int = 300) -> np.ndarray:
    """Weights of a small logistic model over columns of logits and a constant."""
    x = np.column_stack([logits / 4, np.ones(len(target))])
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(turns):
        slope = (_sigmoid(x @ w) - target) @ x / len(target) + 1e-4 * w
        seen += slope**2
        w -= 0.3 * slope / np.sqrt(seen)
    w[:-1] /= 4
    return w


class Model:
    def __init__(self, views, calibrated, combined, threshold):
        self.views, self.calibrated, self.combined, self.threshold = views, calibrated, combined, threshold


class _Table:
    """Features of sampled documents, each view's lists in one array."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("doc_id").to_pylist()
        self.parts = []
        for lists, numbers in (("words", "shape"), ("named", "layout")):
            column = table.column(lists).combine_chunks()
            edge = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            flat = table.column(numbers).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            self.parts.append((column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), edge, flat.reshape(len(column), -1)))

    def rows(self, view: int, rows: np.ndarray):
        index, edge, numbers = self.parts[view]
        size = edge[rows + 1] - edge[rows]
        start = np.append(0, np.cumsum(size))
        take = np.repeat(edge[rows] - start[:-1], size) + np.arange(start[-1])
        return index[take], start, numbers[rows]


def _logits_of(model, batch, buckets: Buckets) -> tuple[np.ndarray, list]:
    """Calibrated logits of both views for each row of a batch, and the rows' features."""
    logits, rows = np.zeros((batch.num_rows, 2)), []
    for k, views in enumerate(_features(batch, buckets)):
        for v, (index, numbers) in enumerate(views):
            view = model.views[v]
            raw = view.sparse[index].sum() + np.dot(view.dense, numbers)
            logits[k, v] = raw * model.calibrated[v][0] + model.calibrated[v][1]
        rows.append(views)
    return logits, rows


def _exchange_pass(held, labelled):
    """Rows (view, bucket, bad, good): documents that the other view is sure of, by bucket; bucket -1 counts documents."""

    def run(batches):
        model, known, buckets = held.value, labelled.value, Buckets()
        counts = [np.zeros((2, size + 1), dtype=np.int64) for size in (BUCKETS, NAMES)]
        for batch in batches:
            logits, rows = _logits_of(model, batch, buckets)
            p = _sigmoid(logits)
            taken = np.array([i in known for i in batch.column(0).to_pylist()], dtype=bool)
            for v in (0, 1):
                for k, sure in ((0, p[:, v] <= 1 - SURE), (1, p[:, v] >= SURE)):
                    chosen = np.flatnonzero(sure & ~taken)
                    found = [b for i in chosen.tolist() for b in rows[i][1 - v][0]]
                    counts[1 - v][k] += np.bincount(np.array(found, dtype=np.int64), minlength=counts[1 - v].shape[1])
                    counts[1 - v][k, -1] += len(chosen)
        for v, (bad, good) in enumerate(counts):
            at = np.flatnonzero(bad + good)
            bucket = np.where(at == len(bad) - 1, -1, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), v, dtype=np.int32)), pa.array(bucket), pa.array(bad[at]), pa.array(good[at])], ["view", "bucket", "bad", "good"]
            )

    return run


def _fields(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", "source", "lang", "n_chars")


def truth_of(labels: DataFrame, labelled: int) -> dict:
    """doc_id -> 1 or 0 of about so many labelled documents at most."""
    toxic = F.coalesce("toxic", F.lit(0)) != 0
    marks = (
        labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | toxic))
        .groupBy("doc_id")
        .agg(F.min(F.when((F.coalesce("quality", F.lit(0)) == 1) & ~toxic, 1).otherwise(0)).alias("good"))
    )
    return {r[0]: r[1] for r in marks.where(hashed_share("doc_id", labelled, marks.count())).collect()}


def train(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    spark = documents.sparkSession
    truth = truth_of(labels, labelled)
    if len(set(truth.values())) < 2:
        return None
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in truth], "chosen long"))
    fields = _fields(documents)
    sample = fields.join(chosen, F.col("doc_id") == F.col("chosen"), "left_semi")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, words array<int>, shape array<double>, named array<int>, layout array<double>"
    table = _Table(sample.mapInArrow(_feature_pass, schema).orderBy("doc_id").toArrow())
    known = np.array([truth[i] for i in table.ids], dtype=np.int64)
    turn = np.array([zlib.crc32(str(i).encode()) % 8 for i in table.ids], dtype=np.int64)
    learn, check, last = np.flatnonzero(turn % 4 > 0), np.flatnonzero(turn == 0), np.flatnonzero(turn == 4)
    if len(set(known[learn].tolist())) < 2 or len(set(known[check].tolist())) < 2 or not known[last].any():
        return None
    target, truth_check = known[learn].astype(np.float64), known[check].astype(np.float64)
    given = [np.zeros((2, size + 1)) for size in (BUCKETS, NAMES)]
    ids = Shared(spark, set(truth))
    for turn_no in range(rounds + 1):
        views = [
            View(size, numbers).fit(*table.rows(v, learn), target, given[v], 120 if turn_no == rounds else 40)
            for v, (size, numbers) in enumerate(((BUCKETS, DENSE_CONTENT), (NAMES, DENSE_META)))
        ]
        calibrated = [_platt(_logits(table, views, v, check)[:, None], truth_check) for v in (0, 1)]
        if turn_no == rounds:
            break
        held = Shared(spark, Model(views, calibrated, None, None))
        handed = fields.mapInArrow(_exchange_pass(held, ids), "view int, bucket long, bad long, good long")
        sums = handed.groupBy("view", "bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
        view, bucket, *both = (sums.column(k).to_numpy() for k in range(4))
        given = [np.zeros((2, size + 1)) for size in (BUCKETS, NAMES)]
        for v in (0, 1):
            for k in (0, 1):
                given[v][k, bucket[view == v]] = both[k][view == v]  # bucket -1 is the last place
    both = np.column_stack([_logits(table, views, v, check) * c[0] + c[1] for v, c in enumerate(calibrated)])
    combined = _platt(both, truth_check)
    rest = np.column_stack([_logits(table, views, v, last) * c[0] + c[1] for v, c in enumerate(calibrated)])
    p = _sigmoid(rest @ combined[:-1] + combined[-1])
    threshold = min(0.5, float(np.quantile(p[known[last] == 1], 1 - KEEP)))
    return Model(views, calibrated, combined, threshold)


def _logits(table: _Table, views, v: int, rows: np.ndarray) -> np.ndarray:
    index, edge, numbers = table.rows(v, rows)
    return views[v].logit(index, np.repeat(np.arange(len(rows)), np.diff(edge)), numbers, len(rows))


def _score_pass(held):
    def run(batches):
        model, buckets = held.value, Buckets()
        for batch in batches:
            if model is None:
                half = np.full(batch.num_rows, 0.5)
                columns = [half, half, half, np.ones(batch.num_rows, dtype=bool)]
            else:
                logits, _ = _logits_of(model, batch, buckets)
                score = _sigmoid(logits @ model.combined[:-1] + model.combined[-1])
                columns = [_sigmoid(logits[:, 0]), _sigmoid(logits[:, 1]), score, score >= model.threshold]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in columns]], ["doc_id", "p_content", "p_meta", "score", "kept"]
            )

    return run


def classify(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, p_content, p_meta, score, kept) for every document."""
    model = train(documents, labels, labelled)
    held = Shared(documents.sparkSession, model)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return _fields(documents).mapInArrow(
        _score_pass(held), f"doc_id {kind}, p_content double, p_meta double, score double, kept boolean"
    )


def _filter_pass(held, columns: list[str]):
    scored = _score_pass(held)

    def run(batches):
        for batch in batches:
            five = pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in ("doc_id", "text", "source", "lang", "n_chars")], ["doc_id", "text", "source", "lang", "n_chars"])
            for out in scored([five]):
                yield batch.filter(out.column(4))

    return run


def keep_good(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, in one narrow pass."""
    held = Shared(documents.sparkSession, train(documents, labels, labelled))
    plain = documents.toDF(*[f"c{k}" for k in range(len(documents.columns))])
    return plain.mapInArrow(_filter_pass(held, documents.columns), plain.schema).toDF(*documents.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
