"""Language identification by interpolated Kneser-Ney character models.

Texts are lowered; runs of anything but letters become one space. Each
language has a model of order ``ORDER``: absolute discounting, continuation
counts below the highest order, interpolation down to a uniform floor. An
n-gram is a 64-bit code of 16 bits a character (characters above the basic
plane are folded), so suffix and context are shifts. Every lang value has a
model; those of ``BLOCK`` languages share sorted code arrays and have a column
each, and a text is scored block by block. It gets the language of the lowest
length-normalised cross-entropy.

The models are fitted on a sample of labelled rows of at most about
``PER_LANGUAGE`` documents for each language, chosen by the hash of doc_id;
n-grams are counted where the rows are and only sums are gathered. A tenth of
the sample is kept out and calibrates the score (a temperature on the entropy
differences) and the rejection bound (the ``REJECT`` quantile of the winner's
cross-entropy); ``rejected`` marks texts beyond it.

Edge cases: a null text, one without letters, or no labelled row at all gives
``und`` with score 0; ties go to the language that sorts first; rows with a
null doc_id are predicted but never learned from; U+0000 inside a text is no
letter; repeated rows each get a row; other columns are never inputs; very
long texts are scored whole, in portions of the batch; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import Shared, portions, utf8

ORDER = 4
PER_LANGUAGE = 2000
BLOCK = 8
REJECT = 0.999
DISCOUNT = 0.75
_MASK = np.uint64(0xFFFF)
_TABLES: dict = {}


def _tables():
    """Lower case, and whether a letter, of each basic-plane character."""
    if not _TABLES:
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(65536)]
        _TABLES["low"] = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], dtype=np.uint32)
        _TABLES["letter"] = np.array([c.isalpha() for c in chars])
    return _TABLES["low"], _TABLES["letter"]


def letters(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each led by ORDER - 1 zeros, and how many each has (0: no letters)."""
    low, letter = _tables()
    # U+0000 parts texts; one inside a text is no letter, like a space
    points = np.frombuffer("\0".join([t.replace("\0", " ") for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    plane = np.where(points < 65536, points, ((points ^ (points >> 7)) & 0x7FFF) | 0x8000).astype(np.uint32)
    value = np.where(points < 65536, low[plane], plane)
    is_letter = letter[plane]
    above = np.flatnonzero(points >= 65536)
    if len(above):
        is_letter[above] = [chr(c).isalpha() for c in points[above].tolist()]
    split = points == 0
    value = np.where(is_letter, value, 32)
    value[split] = 0
    keep = is_letter | split
    keep[1:] |= is_letter[:-1]  # the first other character after letters stands for the run
    text_of = np.cumsum(split)
    value, text_of = value[keep], text_of[keep]
    body = value != 0
    count = np.bincount(text_of[body], minlength=len(texts))
    has = np.bincount(text_of[body & (value != 32)], minlength=len(texts)) > 0
    count = np.where(has, count, 0)
    inside = body & has[text_of]
    value, text_of = value[inside], text_of[inside]
    pad = ORDER - 1
    at = np.arange(len(value)) + pad * (np.searchsorted(np.flatnonzero(count), text_of) + 1)
    out = np.zeros(len(value) + pad * int((count > 0).sum()), dtype=np.uint64)
    out[at] = value
    return out, count


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the highest order at every character, and how many belong to each text."""
    chars, count = letters(texts)
    if not len(chars):
        return np.zeros(0, dtype=np.uint64), count
    code = np.zeros(len(chars) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(16)) | chars[k : len(chars) - ORDER + 1 + k]
    return code[(code & _MASK) != 0], count


def floor_of(codes: np.ndarray) -> float:
    return 1.0 / (len(np.unique(codes & _MASK)) + 1)


class Models:
    """Kneser-Ney models of several languages over shared sorted codes."""

    def __init__(self, languages: list[str], codes: np.ndarray, counts: np.ndarray, owner: np.ndarray, floor: float | None = None):
        self.languages, n = languages, len(languages)
        self.codes, self.value, self.contexts, self.backoff = [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1)
        level: dict[int, list] = {o: [] for o in range(1, ORDER + 1)}
        self.floor = floor or floor_of(codes)
        for k in range(n):
            code, count = codes[owner == k], counts[owner == k].astype(np.float64)
            for order in range(ORDER, 0, -1):
                level[order].append((code, count))
                # one for each different character on the left: continuation counts of the order below
                code, count = np.unique(code & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
                count = count.astype(np.float64)
        for order in range(1, ORDER + 1):
            shared = np.unique(np.concatenate([c for c, _ in level[order]]))
            contexts = np.unique(shared >> np.uint64(16))
            value, backoff = np.full((len(shared), n), np.nan), np.ones((len(contexts), n))
            for k, (code, count) in enumerate(level[order]):
                at, ctx = np.searchsorted(shared, code), np.searchsorted(contexts, code >> np.uint64(16))
                total = np.bincount(ctx, weights=count, minlength=len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts))
                seen = total > 0
                backoff[seen, k] = DISCOUNT * kinds[seen] / total[seen]
                lower = self._below(order, code, k)
                value[at, k] = np.maximum(count - DISCOUNT, 0) / total[ctx] + backoff[ctx, k] * lower
            self.codes[order], self.value[order], self.contexts[order], self.backoff[order] = shared, value, contexts, backoff

    def _below(self, order: int, code: np.ndarray, k: int) -> np.ndarray:
        return np.full(len(code), self.floor) if order == 1 else self.probability(code, order - 1)[:, k]

    def probability(self, code: np.ndarray, top: int = ORDER) -> np.ndarray:
        """Of the last character of each code after those before it, per language."""
        p = np.full((len(code), len(self.languages)), self.floor)
        for order in range(1, top + 1):
            part = code & np.uint64((1 << 16 * order) - 1) if order < 4 else code
            at, hit = _find(self.codes[order], part)
            ctx, known = _find(self.contexts[order], part >> np.uint64(16))
            p = p * np.where(known[:, None], self.backoff[order][ctx], 1.0)
            seen = self.value[order][at]
            p = np.where(hit[:, None] & ~np.isnan(seen), seen, p)
        return p

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Mean bits a character per text and language, and characters per text."""
        code, count = grams(texts)
        kinds, back = np.unique(code, return_inverse=True)
        bits = -np.log2(self.probability(kinds)) if len(kinds) else np.zeros((0, len(self.languages)))
        text = np.repeat(np.arange(len(texts)), count)
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(text, weights=bits[back, k], minlength=len(texts)) / np.maximum(count, 1)
        return out, count


class Blocks:
    """Models of any number of languages, BLOCK by BLOCK, over one floor so that entropies compare."""

    def __init__(self, languages: list[str], codes: np.ndarray, counts: np.ndarray, owner: np.ndarray, block: int = BLOCK):
        self.languages, self.parts, floor = languages, [], floor_of(codes)
        for at in range(0, len(languages), block):
            own = (owner >= at) & (owner < at + block)
            self.parts.append(Models(languages[at : at + block], codes[own], counts[own], owner[own] - at, floor))

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        found = [m.entropies(texts) for m in self.parts]
        return np.concatenate([bits for bits, _ in found], axis=1), found[0][1]


def _find(table: np.ndarray, code: np.ndarray):
    at = np.minimum(np.searchsorted(table, code), len(table) - 1)
    return at, table[at] == code


def _count_pass(languages: list[str]):
    place = {name: k for k, name in enumerate(languages)}

    def run(batches):
        for batch in batches:
            owner = np.array([place[x] for x in batch.column(1).to_pylist()], dtype=np.int32)
            texts = [t.decode("utf-8", "replace") if t else "" for t in utf8(batch.column(0))]
            for k in np.unique(owner):
                own = [t for t, o in zip(texts, owner) if o == k]
                # portions bound the memory; each adds its counts
                counted = [np.unique(grams(own[lo:hi])[0], return_counts=True) for lo, hi in portions(own)]
                kinds, back = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([c for _, c in counted]), minlength=len(kinds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kinds), k, dtype=np.int32)), pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["owner", "code", "n"],
                )

    return run


def _score_pass(held, temperature: float, bound: float):
    def run(batches):
        models = held.value
        names = np.array([*models.languages, "und"], dtype=object) if models else np.array(["und"], dtype=object)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") if t else "" for t in utf8(batch.column(1))]
            pred, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            rejected, low = np.ones(len(texts), dtype=bool), np.full(len(texts), np.nan)
            for lo, hi in portions(texts, 1_000_000) if models else ():
                bits, count = models.entropies(texts[lo:hi])
                best = bits.argmin(axis=1)
                least = bits[np.arange(hi - lo), best]
                sure = 1 / np.exp2(-temperature * (bits - least[:, None])).sum(axis=1)
                some = count > 0
                pred[lo:hi] = np.where(some, best, pred[lo:hi])
                score[lo:hi] = np.where(some, sure, 0)
                low[lo:hi] = np.where(some, least, np.nan)
                rejected[lo:hi] = ~some | (least > bound)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[pred], pa.string()), pa.array(score), pa.array(low, from_pandas=True), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "bits", "rejected"],
            )

    return run


def _entropy_pass(held):
    def run(batches):
        models = held.value
        for batch in batches:
            texts = [t.decode("utf-8", "replace") if t else "" for t in utf8(batch.column(0))]
            for lo, hi in portions(texts, 1_000_000):
                bits, count = models.entropies(texts[lo:hi])
                keep = count > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo).filter(pa.array(keep)), pa.array(list(bits[keep]), pa.list_(pa.float64()))], ["lang", "bits"]
                )

    return run


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE):
    """(models, temperature, bound) from ``labelled(doc_id, text, lang)``, or None where nothing is labelled."""
    spark = labelled.sparkSession
    usable = labelled.where("text is not null and lang is not null and doc_id is not null")
    sizes = usable.groupBy("lang").count().collect()
    if not sizes:
        return None, 1.0, 0.0
    languages = sorted(r[0] for r in sizes)
    share = F.broadcast(spark.createDataFrame([(r[0], min(1.0, per_language / r[1])) for r in sizes], "lang string, share double"))
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = usable.select("doc_id", "text", "lang").join(share, "lang").where(turn < F.col("share")).select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)).alias("fold"))
    counted = sample.where("fold > 0").select("text", "lang").mapInArrow(_count_pass(languages), "owner int, code long, n long")
    table = counted.groupBy("owner", "code").agg(F.sum("n").alias("n")).toArrow()
    owner, code, n = (table.column(k).to_numpy() for k in range(3))
    if not len(owner):
        return None, 1.0, 0.0
    present = np.unique(owner)
    order = np.argsort(code.view(np.uint64), kind="stable")
    models = Blocks([languages[k] for k in present], code.view(np.uint64)[order], n[order], np.searchsorted(present, owner)[order])
    held = Shared(spark, models)
    kept = sample.where("fold = 0").select("text", "lang").mapInArrow(_entropy_pass(held), "lang string, bits array<double>").collect()
    kept = [r for r in kept if r[0] in models.languages]
    if not kept:
        return models, 10.0, float("inf")
    bits, truth = np.array([r[1] for r in kept]), np.array([models.languages.index(r[0]) for r in kept])
    rel = bits - bits.min(axis=1, keepdims=True)
    temperatures = (1, 2, 4, 8, 16, 32, 64)

    def loss(t):
        p = np.exp2(-t * rel)
        p /= p.sum(axis=1, keepdims=True)
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-6)).mean()

    return models, float(min(temperatures, key=loss)), float(np.quantile(bits.min(axis=1), REJECT))


def identify(documents: DataFrame, labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang_pred, score, bits, rejected) for every document."""
    models, temperature, bound = train(labelled, per_language)
    held = Shared(documents.sparkSession, models)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _score_pass(held, temperature, bound), f"doc_id {kind}, lang_pred string, score double, bits double, rejected boolean"
    )


def held_out(modulus: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 1, F.lit(False))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(documents, documents.where(~held_out(3)))
    return found.select("doc_id", held_out(3).alias("held_out"), "lang_pred", "score", "rejected")
