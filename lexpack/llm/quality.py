"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every text. Expectation-maximisation estimates, without any true label, how
each of them votes on good and on bad texts, and so the probability that a text is good given its votes. These posterior labels
train a logistic scorer on hashed features (byte n-grams, and the votes), which then scores all texts.

Votes are counted over all rows: the vote patterns (3 to the power of the labellers at most, 6,561) are counted by the
cluster and EM runs on the counts. The scorer is fitted on a bounded sample: the ``sample`` distinct texts with the smallest hashes,
or all where there are no more. Ids play no part in the choice and a text counts once, however many rows repeat it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import ship, stored
from lexpack.llm.text import encoded, extended, pieces

BITS = 14
SAMPLE = 10_000
#: How many times as many hashes as are wanted are looked at first.
MARGIN = 2
#: Rows whose gradient is taken at a time.
PART = 256
#: A vote's weight among the scorer's features.
VOTE = 0.2
#: Distinct words are counted in runs of so many, the last of up to twice as many, or the share would fall with the length.
RUN = 1000
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "word_length", "capitals", "distinct_words", "repeated_lines", "line_ends", "digits", "bars")
_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 capital, 2 digit, 3 white space, 4 symbol, 5 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 10, 11, 12, 13, 32]], _KIND[128:] = 0, 1, 2, 3, 5
_M = np.uint32(0x9E3779B1)


def votes(text: bytes | None) -> list[int]:
    """One vote for each of LABELLERS; all abstain on a text without words."""
    t = text or b""
    kinds, words, long, distinct, held = np.zeros(6, np.int64), 0, 0, 0, []
    for piece in pieces(t):
        kinds += np.bincount(_KIND[np.frombuffer(piece, np.uint8)], minlength=6)
        own = piece.split()
        words, long = words + len(own), long + sum(map(len, own))
        held += own
        whole = max(0, len(held) // RUN - 1) * RUN
        distinct += sum(len(set(held[at : at + RUN])) for at in range(0, whole, RUN))
        held = held[whole:]
    if not words:
        return [ABSTAIN] * len(LABELLERS)
    distinct += len(set(held))
    size = max(1, int(kinds.sum() - kinds[3]))
    lines = [x.strip() for x in t.split(b"\n") if x.strip()]

    def judge(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    symbols, capitals, digits, length = kinds[4] / size, kinds[1] / size, kinds[2] / size, long / words
    spread = distinct / words
    repeats = 1 - len(set(lines)) / len(lines)
    ended = sum(x.endswith((b".", b"!", b"?", b'"', b"'", b":", b";", "…".encode(), "»".encode(), "。".encode())) for x in lines) / len(lines)
    return [
        judge(symbols > 0.12, symbols < 0.05),
        judge(length < 3 or length > 9, 4 <= length <= 7.5),
        judge(capitals > 0.3, capitals < 0.06),
        judge(words >= 30 and spread < 0.2, spread > 0.5),
        judge(repeats > 0.3, len(lines) > 2 and repeats < 0.05),
        judge(ended < 0.3, ended > 0.8),
        judge(digits > 0.15, digits < 0.03),
        judge(t.count(b"|") + t.count(b"{") + t.count(b"<") > 0.05 * words, False),
    ]


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, vote probabilities [labeller, class, vote], posterior of each pattern) by EM from the majority's view.

    patterns: rows of votes; counts: how many texts have each.
    """
    n = len(LABELLERS)
    if not len(patterns):
        return 0.5, np.full((n, 2, 3), 1 / 3), np.zeros(0)
    lead = (patterns == GOOD).sum(axis=1) - 2.0 * (patterns == BAD).sum(axis=1)
    good = 1 / (1 + np.exp(-lead))
    hot = np.stack([patterns == v for v in (ABSTAIN, BAD, GOOD)], axis=2).astype(float)  # pattern, labeller, vote
    for _ in range(rounds):
        share = float(np.clip((good @ counts) / counts.sum(), 0.01, 0.99))
        rates = np.stack([np.einsum("p,plv->lv", w * counts, hot) + 1 for w in (1 - good, good)], axis=1)
        rates /= rates.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,lcv->pc", hot, np.log(rates)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return share, rates, good


def features(text: bytes | None, own_votes: list[int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 1- to 3-grams of the whole text and its votes: (indices, weights).

    Weights of n-grams are square roots of shares and have length 1; a vote weighs VOTE. Votes are there for texts too short to
    have telling n-grams.
    """
    total = np.zeros(1 << bits, np.int64)
    for piece in pieces(text or b""):
        x = np.frombuffer(piece, np.uint8).astype(np.uint32)
        code = x + np.uint32(1)
        for n in range(1, 4):
            if n > 1:
                code = code[:-1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)
            total += np.bincount(((code + np.uint32(n * 0x01000193)) * _M) >> np.uint32(32 - bits), minlength=1 << bits)
    at = np.flatnonzero(total)
    values = np.sqrt(total[at])
    cast = np.array([j * 3 + v for j, v in enumerate(own_votes) if v != ABSTAIN], np.uint32)
    cast = ((cast + np.uint32(0x02000193)) * _M) >> np.uint32(32 - bits)
    values = values / max(1e-9, float(np.sqrt((values**2).sum())))
    return np.concatenate([at, cast]).astype(np.uint16), np.concatenate([values, np.full(len(cast), VOTE)]).astype(np.float32)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes | None, own_votes: list[int]) -> float:
        """0 for a text without words, else the probability that it is good."""
        if not (text or b"").split(None, 1):
            return 0.0
        at, x = features(text, own_votes, int(len(self.weights)).bit_length() - 1)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x + self.bias, -50, 50))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, rounds: int = 150, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by Adam over the whole sample; every row weighs the same, so a text with little to go by is judged by the share of good ones."""
    w, b = np.zeros(1 << bits), 0.0
    if not len(rows):
        return Scorer(w, 0.0)
    parts = []
    for at in range(0, len(rows), PART):
        own = rows[at : at + PART]
        parts.append((np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own]), [len(r[0]) for r in own], labels[at : at + PART]))
    del rows
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        gw, gb = decay * w, 0.0
        for at, x, sizes, y in parts:
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * x, len(sizes)) + b, -50, 50)))
            g = (p - y) / len(labels)
            gw, gb = gw + np.bincount(at, g[row] * x, 1 << bits), gb + float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= 0.3 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return Scorer(w, b)


def cutoff(hashes: DataFrame, sample: int, distinct: int) -> int:
    """The ``sample``-th smallest of the distinct values of column h, or the largest if there are no more.

    ``distinct`` is an estimate of their number, by which only the small hashes are sorted; should it be too high, more are.
    """
    share = MARGIN * sample / max(distinct, 1)
    while True:
        low = hashes if share >= 1 else hashes.where(F.col("h") <= int(-(1 << 63) + share * (1 << 64)))
        found = low.distinct().orderBy("h").limit(sample).agg(F.count("h").alias("n"), F.max("h").alias("h")).first()
        if found.n >= sample or share >= 1:
            return found.h
        share *= 4


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """One row a document row: doc_id, votes (a letter g, b or - for each of LABELLERS), posterior, score, keep.

    ``posterior``: the weak-label model's probability that the text is good; ``score``: the trained scorer's; ``keep``: a score of
    0.5 or more. Texts without words, null ones too, have the score 0 and aren't kept. Ids may be null or repeated: they are only
    returned. Repeated texts get equal results. An empty table gives none. At least one text is sampled if there is any row, so the
    scorer is always fitted.
    """
    if not 1 <= bits <= 16 or sample < 1:
        raise ValueError("bits must be from 1 to 16 and sample at least 1")
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = rows.select("text", F.xxhash64("text").alias("h"))

    def vote():
        return lambda batch: [["".join("-bg"[v] for v in votes(t)) for t in encoded(batch.column(batch.schema.get_field_index("text")))]]

    voted = stored(extended(hashed, "text", [T.StructField("votes", T.StringType())], vote, keep=["h"]), "votes")
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d")).collect()  # at most 3 ** len(LABELLERS) rows
    counted.sort(key=lambda r: r.votes)
    patterns = np.array([["-bg".index(c) for c in r.votes] for r in counted]).reshape(-1, len(LABELLERS))
    _, _, good = fit_labels(patterns, np.array([r.n for r in counted], float))
    label = {r.votes: float(g) for r, g in zip(counted, good, strict=True)}
    labels = spark.sparkContext.broadcast(label)

    def example(batches):
        for batch in batches:
            judged = [(t, votes(t)) for t in encoded(batch.column(1))]
            made = [(labels.value["".join("-bg"[x] for x in v)], *(x.tobytes() for x in features(t, v, bits))) for t, v in judged]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*made, strict=True), (pa.float64(), pa.binary(), pa.binary()), strict=True))], names=["h", "y", "i", "x"])

    # A text's votes, hash and features don't depend on the row, so of each chosen text one row will do; copies are combined before the shuffle.
    last = cutoff(voted.select("h"), sample, sum(r.d for r in counted)) if counted else 0
    chosen = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("text").alias("text"))
    # At most 2 ** bits features of six bytes each a text: 1 GB if every sampled text is a book, some 50 MB of usual ones.
    examples = chosen.mapInArrow(example, "h long, y double, i binary, x binary").toArrow().sort_by("h")
    parts = [[np.frombuffer(b.as_buffer(), k) for b in examples.column(c)] for c, k in (("i", np.uint16), ("x", np.float32))]
    scorer = fit_scorer(list(zip(*parts, strict=True)), examples.column("y").to_numpy(), bits)
    del examples, parts
    shared = spark.sparkContext.broadcast(scorer)

    def judge():
        def per_batch(batch):
            raw = encoded(batch.column(batch.schema.get_field_index("text")))
            judged = [votes(t) for t in raw]
            own = ["".join("-bg"[x] for x in v) for v in judged]
            scores = [shared.value.score(t, v) for t, v in zip(raw, judged, strict=True)]
            return [own, [labels.value.get(v) for v in own], scores, [s >= 0.5 for s in scores]]

        return per_batch

    fields = [T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    return extended(rows, "text", fields, judge, keep=["doc_id"])
