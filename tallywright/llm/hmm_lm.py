"""Language-model scores from a hidden Markov model.

Tokens are lowered words and one end per text. All distinct words of the
training texts are counted exactly, by 64-bit hash, in a table that stays
distributed and grows with the corpus. The model's symbols are the end, every
word that occurs ``LEAST`` times or more in training, so that the alphabet
grows with the vocabulary, and ``CLASSES`` classes of the rarer words (by word
ending). The emission table is broadcast; its size is checked against ``MOST``
symbols (64 MB in training passes, 128 MB in sums and scoring), beyond which the
least count rises to what fits. A word of a
class is emitted in two steps, the class by the state and the word by its
smoothed share of the class, so every text has an exact probability.

Training is Baum-Welch: each pass runs scaled forward-backward recursions over
all training texts where they lie, sums expected counts within each task, and
adds the sums of all tasks, until the likelihood gains less than ``GAIN`` of
itself or after ``PASSES`` passes. A few hundred texts, run on the driver, only
give the starting point. Scoring is the scaled forward recursion.

Texts meet the count table in one join of (text, rare word) rows; frequent
words never enter it, so no key of it is hot.

Edge cases: a null or empty text is a lone end; with no training text every
count is zero and each token has probability one half of one half, that is
base 0; a null doc_id is in training; repeated rows each get a row and each
count; a very long text is run in stretches, of which only the first values
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch, Shared, hashed_share, least_of_top, utf8

STATES = 8
LEAST = 32
MOST = 2_000_000
CLASSES = 2048
PASSES = 3
GAIN = 0.001
START_TEXTS = 400
START_PASSES = 15
#: Pseudo-counts that pull each state's emissions to the overall shares.
PULL = 50.0
_LANES = 150_000
_STRETCH = 200_000
#: Symbols whose expected counts travel together.
BLOCK = 4096
MODULUS = 5


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_key(word: bytes) -> int:
    """A signed 64-bit hash; zero is left to the end token."""
    h = xxhash.xxh64_intdigest(word, 7) or 1
    return h - (1 << 64) if h >> 63 else h


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-4:]) % CLASSES


def _count_pass(batches):
    for batch in batches:
        counts: Counter = Counter()
        texts = utf8(batch.column(0))
        for text in texts:
            counts.update(tokens(text))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([0, *map(word_key, counts)], pa.int64()),
                pa.array([-1, *map(word_class, counts)], pa.int32()),
                pa.array([len(texts), *counts.values()], pa.int64()),
            ],
            ["key", "class", "c"],
        )


class Alphabet:
    """Symbols: classes first, then the end, then frequent words in the order of their hashes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, kinds: int, ends: int):
        order = np.argsort(keys)
        self.keys = array("q", keys[order].tolist())
        self.count = np.concatenate([np.zeros(CLASSES), [ends], counts[order]]).astype(np.float64)
        self.size = len(self.count)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.base = np.log10((self.count + 0.5) / (total + 0.5 * (kinds + 1)))


def _coded(alphabet: Alphabet, texts: list[list[bytes]]):
    """word -> (symbol, hash, class) of all words of some texts, looked up together."""
    words = list(dict.fromkeys(w for text in texts for w in text))
    keys, classes = list(map(word_key, words)), list(map(word_class, words))
    symbols = np.array(classes, dtype=np.int64)
    if len(alphabet.keys) and words:
        table, sought = np.frombuffer(alphabet.keys, dtype=np.int64), np.array(keys, dtype=np.int64)
        at = np.minimum(np.searchsorted(table, sought), len(table) - 1)
        symbols = np.where(table[at] == sought, CLASSES + 1 + at, symbols)
    return dict(zip(words, symbols.tolist())), dict(zip(words, keys)), dict(zip(words, classes))


def _encode_pass(held):
    def run(batches):
        alphabet = held.value
        press = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            # slices keep the worker's memory small
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                n_tokens, known, base, packed, edge = [], [], [], [], [0]
                keys, classes, counts = array("q"), array("i"), array("q")
                texts = list(map(tokens, utf8(batch.column(2))))
                symbol_of, key_of, class_of = _coded(alphabet, texts)
                for words in texts:
                    symbols = np.array([*map(symbol_of.__getitem__, words), CLASSES], dtype=alphabet.kind)
                    sure = symbols[symbols >= CLASSES]
                    n_tokens.append(len(symbols))
                    known.append(int((alphabet.count[sure] > 0).sum()))
                    base.append(float(alphabet.base[sure].sum()))
                    packed.append(press.compress(symbols.tobytes()))
                    rare = Counter([words[i] for i in np.flatnonzero(symbols < CLASSES)])
                    keys.extend(map(key_of.__getitem__, rare))
                    classes.extend(map(class_of.__getitem__, rare))
                    counts.extend(rare.values())
                    edge.append(len(keys))
                rare_words = pa.StructArray.from_arrays(
                    [pa.array(np.array(x)) for x in (keys, classes, counts)], ["key", "class", "n"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(n_tokens, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(packed, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edge, pa.int32()), rare_words),
                    ],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "symbols", "rare"],
                )

    return run


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (symbols, K)

    @classmethod
    def first(cls, share: np.ndarray, states: int) -> "Hmm":
        rng = np.random.default_rng(11)
        emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def narrow(self) -> "Hmm":
        """The same in single precision, for training passes."""
        return Hmm(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))

    def updated(self, start, move, emit, share: np.ndarray) -> "Hmm":
        move = move + 0.5
        emit = emit + PULL * share[:, None]
        return Hmm((start + 0.5) / (start + 0.5).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def lanes(texts: list[np.ndarray]):
    """Groups of texts of like length, each a padded (length, lanes) array with the lengths; longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        rows = order[at : at + max(1, min(1024, _LANES // longest))]
        at += len(rows)
        grid = np.zeros((longest, len(rows)), dtype=np.int64)
        for k, i in enumerate(rows):
            grid[: len(texts[i]), k] = texts[i]
        yield rows, grid, np.array([len(texts[i]) for i in rows])


def _live(sizes: np.ndarray, length: int) -> np.ndarray:
    return np.searchsorted(-sizes, -np.arange(length), side="left")  # sizes fall, so live lanes come first


def stretch(model: Hmm, grid: np.ndarray, live: np.ndarray, alpha, begin: int, stop: int, keep: bool):
    """Runs times begin to stop from the alphas before them: last alphas, scales, and with ``keep`` all alphas."""
    width, kind = grid.shape[1], model.emit.dtype
    scales = np.ones((stop - begin, width), dtype=kind)
    alphas = np.zeros((stop - begin, width, len(model.start)), dtype=kind) if keep else None
    for t in range(begin, stop):
        n = int(live[t])
        raw = (model.start if t == 0 else alpha[:n] @ model.move) * model.emit[grid[t, :n]]
        c = raw.sum(axis=1)
        alpha = raw / c[:, None]
        scales[t - begin, :n] = c
        if keep:
            alphas[t - begin, :n] = alpha
    return alpha, scales, alphas


def forward(model: Hmm, grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each lane."""
    live, alpha, total = _live(sizes, len(grid)), None, np.zeros(grid.shape[1])
    for begin in range(0, len(grid), _STRETCH):
        alpha, scales, _ = stretch(model, grid, live, alpha, begin, min(begin + _STRETCH, len(grid)), False)
        total += np.log10(scales).sum(axis=0, dtype=np.float64)
    return total


def expected(model: Hmm, texts: list[np.ndarray]):
    """Expected starts, moves and emissions, and the total log10 likelihood."""
    k, symbols, kind = len(model.start), len(model.emit), model.emit.dtype
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k)), 0.0
    for _, grid, sizes in lanes(texts):
        live, begins = _live(sizes, len(grid)), range(0, len(grid), _STRETCH)
        # what stands before each stretch; the alphas inside are made again when the way back needs them
        before = [None]
        for begin in begins[:-1]:
            before.append(stretch(model, grid, live, before[-1], begin, begin + _STRETCH, False)[0])
        beta = np.ones((grid.shape[1], k), dtype=kind)
        for begin, alpha in zip(reversed(begins), reversed(before)):
            stop = min(begin + _STRETCH, len(grid))
            _, scales, alphas = stretch(model, grid, live, alpha, begin, stop, True)
            total += float(np.log10(scales).sum(dtype=np.float64))
            for t in range(stop - 1, begin - 1, -1):
                n = int(live[t])
                gamma = alphas[t - begin, :n] * beta[:n]
                if t:
                    ahead = beta[:n] * model.emit[grid[t, :n]] / scales[t - begin, :n, None]
                    last = alphas[t - 1 - begin, :n] if t > begin else alpha[:n]
                    move += last.T @ ahead
                    beta[:n] = ahead @ model.move.T
                else:
                    start += gamma.sum(axis=0)
                alphas[t - begin, :n] = gamma
            mask = np.arange(begin, stop)[:, None] < sizes
            flat, weight = grid[begin:stop][mask], alphas[mask]
            for s in range(k):
                emit[:, s] += np.bincount(flat, weights=weight[:, s], minlength=symbols)
    return start, move * model.move, emit, total


def _texts(column, kind) -> list[np.ndarray]:
    inflate = zstandard.ZstdDecompressor()
    return [np.frombuffer(inflate.decompress(p), kind) for p in column.to_pylist()]


def _squeezed(rows: np.ndarray, values: np.ndarray, press) -> bytes:
    """Rows of a block and their values in 24 bits, byte by byte, compressed."""
    bits = (np.ascontiguousarray(values, dtype=np.float32).view(np.uint32).astype(np.uint64) + 0x80).astype(np.uint32)
    planes = bits.view(np.uint8).reshape(-1, 4)[:, 1:].T
    return press.compress(np.uint32(len(rows)).tobytes() + rows.astype(np.uint16).tobytes() + planes.tobytes())


def _expanded(data: bytes, states: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    rows = np.frombuffer(raw, np.uint16, n, 4)
    planes = np.frombuffer(raw, np.uint8, offset=4 + 2 * n).reshape(3, -1)
    bits = np.zeros((planes.shape[1], 4), dtype=np.uint8)
    bits[:, 1:] = planes.T
    return rows, bits.view(np.float32).reshape(n, states)


def _expect_pass(held, kind):
    """Expected counts of a task: rows of emissions for each block of symbols that it met; block -1 has starts, moves and the likelihood."""

    def run(batches):
        model, press = held.value, zstandard.ZstdCompressor(level=1)
        k = len(model.start)
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), np.zeros((1, k))
        for batch in batches:
            a, b, c, likelihood = expected(model, _texts(batch.column(0), kind))
            start, move, emit = start + a, move + b, emit + c
            total[0, 0] += likelihood
        met = np.flatnonzero(emit.any(axis=1))
        blocks = [(-1, np.concatenate([start[None], move, total]).tobytes())]
        for block in np.unique(met // BLOCK).tolist():
            rows = met[met // BLOCK == block]
            blocks.append((block, _squeezed(rows - block * BLOCK, emit[rows], press)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks], pa.int64()), pa.array([x[1] for x in blocks], pa.binary())], ["block", "data"])

    return run


def _sum_pass(states: int):
    """The sums of a partition's blocks, added up as they come."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block < 0:
                    sums[block] = sums.get(block, 0) + np.frombuffer(data.as_py()).reshape(-1, states)
                else:
                    rows, values = _expanded(data.as_py(), states)
                    sums.setdefault(block, np.zeros((BLOCK, states)))[rows] += values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "data"])

    return run


def _score_pass(held, kind):
    def run(batches):
        model = held.value
        for batch in batches:
            texts, score = _texts(batch.column(5), kind), np.zeros(batch.num_rows)
            for rows, grid, sizes in lanes(texts):
                score[rows] = forward(model, grid, sizes)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), batch.column(6), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "known", "base", "rid", "score"],
            )

    return run


def train(encoded: DataFrame, alphabet: Alphabet, classes: dict[int, int], states: int, passes: int) -> Hmm:
    spark = encoded.sparkSession
    share = alphabet.count.copy()
    share[:CLASSES] += [classes.get(i, 0) for i in range(CLASSES)]
    share = (share + 0.5) / (share + 0.5).sum()
    model = Hmm.first(share, states)
    learned = encoded.where("not held_out")
    few = learned.where(hashed_share("rid", START_TEXTS, learned.count())).select("rid", "symbols").toArrow().sort_by("rid")
    texts = _texts(few.column(1), alphabet.kind)
    for _ in range(START_PASSES if texts else 0):
        model = model.updated(*expected(model, texts)[:3], share)
    before = None
    for _ in range(passes):
        held = Shared(spark, model.narrow())
        sums = learned.select("symbols").mapInArrow(_expect_pass(held, alphabet.kind), "block long, data binary")
        # one row for each block of symbols: what is gathered is the emission table
        table = sums.repartition("block").mapInArrow(_sum_pass(states), "block long, data binary").collect()
        emit, rest = np.zeros((-(-alphabet.size // BLOCK) * BLOCK, states)), np.zeros((states + 2, states))
        for block, data in table:
            into = rest if block < 0 else emit[block * BLOCK : (block + 1) * BLOCK]
            into += np.frombuffer(data).reshape(-1, states)
        if not rest[0].any():
            break
        emit = emit[: alphabet.size]
        model = model.updated(rest[0], rest[1:-1], emit, share)
        if before is not None and rest[-1, 0] - before < GAIN * abs(before):
            break
        before = rest[-1, 0]
    return model


def score(
    documents: DataFrame, held_out, states: int = STATES, least: int = LEAST, most: int = MOST, passes: int = PASSES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "hmm")
    rows = documents.select("doc_id", held_out.alias("held_out"), "text")
    counts = scratch.keep(
        rows.where("not held_out").select("text").mapInArrow(_count_pass, "key long, class int, c long").groupBy("key", "class").agg(F.sum("c").alias("c")),
        "counts",
    )
    total, kinds = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where("key = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = counts.where("key <> 0")
    fits = least_of_top(words, "c", most)
    least = total + 1 if fits is None else max(least, fits)
    top = words.where(F.col("c") >= least).select("key", "c").toArrow()
    alphabet = Alphabet(top.column(0).to_numpy(), top.column(1).to_numpy(), total, kinds, ends)
    held = Shared(spark, alphabet)
    rest = words.where(F.col("c") < least)
    per_class = {r[0]: (r[1], r[2]) for r in rest.groupBy("class").agg(F.sum("c"), F.count("*")).collect()}
    kind = documents.schema["doc_id"].dataType.simpleString()
    encoded = scratch.keep(
        rows.select("doc_id", "held_out", "text")
        .mapInArrow(
            _encode_pass(held),
            f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, symbols binary, rare array<struct<key:long,class:int,n:long>>",
        )
        .withColumn("rid", F.monotonically_increasing_id()),
        "encoded",
    )
    model = train(encoded, alphabet, {k: v[0] for k, v in per_class.items()}, states, passes)
    fitted = Shared(spark, model)
    scored = encoded.select("doc_id", "held_out", "n_tokens", "known", "base", "symbols", "rid").mapInArrow(
        _score_pass(fitted, alphabet.kind), f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, rid long, score double"
    )
    # a rare word's share of its class, and of all tokens
    rare = encoded.select("rid", F.explode("rare").alias("w")).select("rid", F.col("w.key").alias("key"), F.col("w.class").alias("class"), "w.n")
    class_table = spark.createDataFrame(
        [(k, float(per_class.get(k, (0, 0))[0] + 0.5 * (per_class.get(k, (0, 0))[1] + 1))) for k in range(CLASSES)], "class int, mass double"
    )
    met = rare.join(rest.select("key", "c"), "key", "left").join(F.broadcast(class_table), "class")
    c = F.coalesce("c", F.lit(0)) + 0.5
    sums = met.groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(c / F.lit(float(total + 0.5 * (kinds + 1))))).alias("rare_base"),
        F.sum(F.col("n") * F.log10(c / F.col("mass"))).alias("rare_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    return scored.join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(F.pmod(crc, F.lit(MODULUS)) == 1, F.lit(False))
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
