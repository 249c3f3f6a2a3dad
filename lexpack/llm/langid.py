"""Language identification with error-correcting output codes.

Every language gets a codeword; for each bit a binary classifier over hashed byte n-grams tells the languages whose bit is 1
from those whose bit is 0. A text's bit margins are decoded to the codeword of least loss, each bit's loss weighted by how well
its classifier separates the languages; near ties are flagged as ambiguous.

The classifiers are log-odds of smoothed n-gram frequencies, each language weighing the same. They are learned from the counts
of all labelled training rows: a task adds its texts into one count vector for each language, and vectors are summed in two
steps, each as a stream that holds one sum. The driver gets one vector of ``2**bits`` counts for each language (256 KiB at 15 bits), which the number of languages
bounds, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import ship
from lexpack.llm.text import LETTERS, encoded, extended, pieces, slices

BITS = 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Into so many parts a language's counts are summed before they are summed to one.
SALTS = 16
#: A text is ambiguous if the best and the second codeword are closer than this in probability.
MARGIN = 0.1
_M = np.uint32(0x9E3779B1)

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]


def gram_codes(raw: bytes, bits: int = BITS) -> np.ndarray:
    """Hashed byte n-grams of the letters of a text, runs of anything else counting as one blank; n-grams of blanks only are left out."""
    clean = b" " + b" ".join(raw.translate(LETTERS).split()) + b" "
    x = np.frombuffer(clean, np.uint8).astype(np.uint32)
    out = []
    code = x + np.uint32(1)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            code = code[:-1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)
        if n in ORDERS and len(code):
            h = (code + np.uint32(n * 0x01000193)) * _M
            out.append((h >> np.uint32(32 - bits))[x[: len(code)] != 32] if n == 1 else h >> np.uint32(32 - bits))
    return np.concatenate(out)


def has_letter(text: bytes | None) -> bool:
    return text is not None and any(map(str.isalpha, text.decode("utf-8", "replace")))


def codewords(n: int, seed: int = 6) -> np.ndarray:
    """n codewords of 0 and 1: all distinct splits up to 6 languages, else random columns of which the best spread of 64 draws is taken."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [[1] + [c >> i & 1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T
    rng, width, best = np.random.default_rng(seed), max(16, int(np.ceil(10 * np.log2(n)))), (-1, None)
    for _ in range(64):
        m = rng.integers(0, 2, (n, width), dtype=np.int8)
        m = m[:, (m.min(axis=0) == 0) & (m.max(axis=0) == 1)]
        sign = m.astype(np.int32) * 2 - 1
        apart = (m.shape[1] - sign @ sign.T) // 2
        least = int((apart + np.eye(n, dtype=np.int64) * width).min())
        best = max(best, (least, m), key=lambda x: x[0])
    return best[1]


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # of 1 and -1, a row a language
    weights: np.ndarray  # float32, a row a hashed n-gram, a column a bit
    trust: np.ndarray  # a bit
    bits: int

    def margins(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros(self.codes.shape[1]), 0
        for piece in pieces(raw):
            codes = gram_codes(piece, self.bits)
            used = np.bincount(codes, minlength=1 << self.bits)
            total += used @ self.weights if len(codes) > 1 << self.bits - 2 else self.weights[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / np.sqrt(max(n, 1))

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """The language, its probability among the learned ones, and whether another is about as likely."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        z = self.codes * self.margins(text)[None, :]
        loss = (self.trust * np.logaddexp(0, -z)).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.langs[order[0]], float(p[order[0]]), len(p) > 1 and bool(p[order[0]] - p[order[1]] < MARGIN)


def fit(counts: dict[str, np.ndarray], bits: int = BITS, smoothing: float = 0.5) -> Model:
    """The model of the n-gram counts of each language."""
    langs = sorted(counts)
    codes = codewords(len(langs))
    if not langs:
        return Model([], np.ones((0, 1)), np.zeros((1 << bits, 1), np.float32), np.ones(1), bits)
    freq = np.stack([(c + smoothing) / (c.sum() + smoothing * len(c)) for c in (counts[x].astype(np.float64) for x in langs)])
    weights, trust = [], []
    for bit in codes.T:
        if bit.min() == bit.max():
            weights.append(np.zeros(1 << bits))
            trust.append(1.0)
            continue
        w = np.log(freq[bit == 1].mean(axis=0)) - np.log(freq[bit == 0].mean(axis=0))
        weights.append(w)
        trust.append(max(1e-3, float(((freq @ w) * (bit * 2 - 1)).min())))
    trust = np.array(trust) / np.sum(trust)
    return Model(langs, codes.astype(np.float64) * 2 - 1, np.stack(weights, axis=1).astype(np.float32), trust, bits)


def count_grams(rows: DataFrame, text: str, lang: str, bits: int = BITS) -> dict[str, np.ndarray]:
    """The n-gram counts of each non-null language over all rows."""

    def partial(batches):
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches, "t"):
            for t, name in zip(encoded(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if t is not None and has_letter(t):
                    total = found.setdefault(name, np.zeros(1 << bits, np.int64))
                    for piece in pieces(t):
                        total += np.bincount(gram_codes(piece, bits), minlength=1 << bits)
        yield from (pa.RecordBatch.from_pydict({"l": pa.array([k], pa.string()), "c": pa.array([v.tobytes()], pa.binary())}) for k, v in found.items())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, name = np.zeros(1 << bits, np.int64), None
        for batch in batches:  # one at a time, however many tasks there were
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                total += np.frombuffer(blob.as_buffer(), np.int64)
        yield pa.RecordBatch.from_pydict({"l": pa.array([name.as_py()], pa.string()), "c": pa.array([total.tobytes()], pa.binary())})

    each = rows.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null").mapInArrow(partial, "l string, c binary")
    some = each.select("l", "c", (F.spark_partition_id() % SALTS).alias("s")).groupBy("l", "s").applyInArrow(added, "l string, c binary")
    return {r.l: np.frombuffer(bytes(r.c), np.int64) for r in some.groupBy("l").applyInArrow(added, "l string, c binary").toLocalIterator()}


def train(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS) -> Model:
    ship(docs.sparkSession)
    return fit(count_grams(docs, text, lang, bits), bits)


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows that the production query learns from; a null doc_id counts as the empty string."""
    return docs.where(~held_out(doc_id))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Only the text is read. Whole texts
    count, in pieces. Repeated rows get equal results; columns named like a result are replaced.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def make():
        def per_batch(batch):
            found = [shared.value.predict(t) for t in encoded(batch.column(batch.schema.get_field_index(text)))]
            return [list(x) for x in zip(*found, strict=True)]

        return per_batch

    return extended(docs, text, FIELDS, make, keep)


def report(docs: DataFrame) -> DataFrame:
    """One row a document row: doc_id, held_out, lang_pred, score, ambiguous; learned from the rows not held out."""
    model = train(training_rows(docs))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), *(f.name for f in FIELDS))


def select(docs: DataFrame) -> DataFrame:
    """The documents in an identified language: texts without a letter and ambiguous ones go."""
    model = train(training_rows(docs))
    clash = {f.name for f in FIELDS}
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in clash}
    found = identify(docs.withColumnsRenamed(own), model)
    return found.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).drop(*clash).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
