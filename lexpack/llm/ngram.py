"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model smoothed by Dirichlet priors: p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu), with h' one word
shorter, down to the add-0.1 unigram that also prices unknown words. For an unseen hw this is mu / (c(h) + mu) times
p(w | h'), so it is an exact backoff automaton: a state for every seen history, an arc for every seen n-gram, and a failure arc
with weight log10(mu / (c(h) + mu)) to the next shorter history. A text is scored in one traversal from left to right.

The automaton of the whole corpus is never in one place. Documents form chunks of bounded text; a chunk needs only the part of
the automaton that its own n-grams can reach:

1. each chunk counts its distinct n-grams (of training documents; the others with 0) and sends them, sorted and cut into ``fan``
   slices of the hash range, on their way to the slices' owners;
2. chunks exchange in rounds, as in a butterfly network: a node of round k stands for fan^k chunks and one of fan^k slices of the
   range. It adds up what its ``fan`` senders sent and sends ``fan`` slices of that on, so n-grams that chunks share travel once
   from there. The last round's nodes know their slices of the whole corpus;
3. the answers go back the same way, each in the order asked;
4. the chunk compiles states and arcs from the answer and traverses its documents.

With at most MOST_FAN senders a node, the rounds are the logarithm of the corpus to that base and the messages of a round MOST_FAN for
each chunk at most: rows grow as the input, not as its square. A node has about as much content as a chunk, and an n-gram is in it
once from each sender, so no key is hot whatever the corpus. Words and
n-grams are known by 64-bit hashes (63 bits and a bit that marks single words): for ten million distinct words the chance that
any two are taken for one is about 1e-5. Counts cover all training documents; nothing is pruned.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import ship, stored
from lexpack.llm.text import LOWER, encoded, pieces

ORDER = 2
MU = 20.0
ADD = 0.1
CHUNK_BYTES = 4 << 20
MOST_FAN = 256
_BOS, _END = 0, 1
_BOS_KEY, _END_KEY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ONE = np.uint64(1)
_NONE = 9.0  # no log-probability


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Texts as numbered tokens: a start mark, the words and one end for each; and the distinct n-grams of every order."""

    def __init__(self, texts: list[bytes | None], order: int = ORDER):
        read, sizes = [], []
        for t in texts:
            read.append(b" start")  # no word holds a blank
            before = len(read)
            for piece in pieces((t or b"").translate(LOWER)):
                read += piece.split()
            read.append(b" end")
            sizes.append(len(read) - before)
        words = defaultdict(itertools.count(2).__next__, {b" start": _BOS, b" end": _END})
        self.ids, self.sizes = np.fromiter(map(words.__getitem__, read), np.int64, len(read)), np.array(sizes, np.int64)
        self.order, self.n_words = order, len(words)
        del read
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.doc = np.repeat(np.arange(len(texts)), self.sizes + 1)
        place = np.arange(len(self.ids)) - self.first[self.doc] if len(texts) else np.zeros(0, np.int64)
        digest = xxhash.xxh64_intdigest
        hashed = np.array([digest(w, 3) for w in words], np.uint64)
        hashed[_BOS], hashed[_END] = _BOS_KEY, _END_KEY
        by_order, self.at = [hashed[self.ids] | _ONE], [np.arange(len(self.ids))]
        key = by_order[0]
        for k in range(2, order + 1):
            key = np.concatenate([key[:1], _mix(key[:-1] + np.uint64(k)) + by_order[0][1:] * np.uint64(0x9E3779B97F4A7C15)])
            key = _mix(key) & ~_ONE
            self.at.append(np.flatnonzero(place >= k - 1))
            by_order.append(key[self.at[-1]])
        self.keys, inverse = np.unique(np.concatenate(by_order), return_inverse=True)
        self.of = np.split(inverse, np.cumsum([len(x) for x in by_order])[:-1])  # n-gram numbers, order by order

    def digest(self, training: np.ndarray) -> int:
        """What tells other texts, another order of them or other training marks from these, as a signed number."""
        h = xxhash.xxh3_64()
        for x in (self.keys, self.ids, self.sizes, training.astype(np.uint8)):
            h.update(x.tobytes())
        return h.intdigest() - (1 << 63)

    def counts(self, training: np.ndarray) -> np.ndarray:
        """How often each distinct n-gram occurs in the documents that ``training`` marks."""
        out = np.zeros(len(self.keys), np.int64)
        for at, grams in zip(self.at, self.of, strict=True):
            out += np.bincount(grams[training[self.doc[at]]], minlength=len(out))
        return out

    def score(self, counts: np.ndarray, n: int, v: int, mu: float = MU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n_known, base_score, score) of each document, from the global counts of ``keys``."""
        single = np.zeros(self.n_words, np.int64)
        single[self.ids] = counts[self.of[0]]
        p = (single + ADD) / (n + ADD * (v + 1))
        log_p = np.log10(p)
        real = self.ids != _BOS
        docs = len(self.sizes)
        known = np.bincount(self.doc[real], weights=single[self.ids[real]] > 0, minlength=docs).astype(np.int64)
        base = np.bincount(self.doc[real], weights=log_p[self.ids[real]], minlength=docs)

        # The automaton at each position: by depth, the weight of the arc that the position's word takes from a state of that
        # depth (_NONE where there is no arc), and the weight of the failure arc of the state that the position leaves behind.
        prob = np.zeros(len(self.keys))
        prob[self.of[0]] = p[self.ids]
        arcs, fails = [log_p[self.ids]], []
        for k in range(2, self.order + 1):
            grams, where = np.unique(self.of[k - 1], return_index=True)
            at = self.at[k - 1][where]
            lower = np.full(len(self.ids), -1)
            lower[self.at[k - 2]] = self.of[k - 2]
            shorter, history = lower[at], lower[at - 1]
            prob[grams] = (counts[grams] + mu * prob[shorter]) / (counts[history] + mu)
            arc, fail = np.full(len(self.ids), _NONE), np.zeros(len(self.ids))
            own = self.of[k - 1]
            seen = counts[own] > 0
            arc[self.at[k - 1][seen]] = np.log10(prob[own[seen]])
            fail[self.at[k - 2]] = np.log10(mu / (counts[self.of[k - 2]] + mu))
            arcs.append(arc)
            fails.append(fail)
        known_word = single[self.ids] > 0
        del prob
        cut = [slice(a, a + n + 1) for a, n in zip(self.first.tolist(), self.sizes.tolist(), strict=True)]
        return known, base, np.array([self._traverse([x[c] for x in arcs], [x[c] for x in fails], known_word[c]) for c in cut])

    def _traverse(self, arcs: list[np.ndarray], fails: list[np.ndarray], known: np.ndarray) -> float:
        """The log-probability of one document, from left to right; the state is known by its depth, the length of its history."""
        deepest, found, seen = self.order - 1, 0.0, known.tolist()
        by_place = zip(zip(*(x[1:].tolist() for x in arcs), strict=True), zip(*(x[:-1].tolist() for x in fails), strict=True) if fails else [()] * (len(seen) - 1), seen[1:], strict=True)
        depth = deepest and int(seen[0])
        for arc, fail, word_seen in by_place:
            weight = arc[depth]
            while weight == _NONE:
                depth -= 1
                found += fail[depth]
                weight = arc[depth]
            found += weight
            if depth < deepest and (depth or word_seen):
                depth += 1
        return found


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as byte planes, which the shuffle's compression shrinks where the high bytes are alike."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(blob: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob.as_buffer(), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def sliced(keys: np.ndarray, parts: int, at: int = 0, of: int = 1) -> np.ndarray:
    """Where the slices ``at * parts`` and so on of the range in ``of * parts`` begin in sorted keys of slice ``at`` of ``of``, and the end."""
    edges = np.array([(i << 64) // (parts * of) for i in range(at * parts, (at + 1) * parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def rounds_for(chunks: int, most: int = MOST_FAN) -> tuple[int, int]:
    """(rounds, fan) of the exchange between about so many chunks."""
    rounds = 1
    while most**rounds < chunks:
        rounds += 1
    fan = max(1, math.ceil(chunks ** (1 / rounds)))
    while fan**rounds < chunks:
        fan += 1
    return rounds, fan


def together(messages: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, sums, place of each message's keys among them) of messages (keys, counts)."""
    asked = [np.cumsum(unpacked(x), dtype=np.uint64) for x in messages.column("keys")]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, inverse, np.concatenate([unpacked(x) for x in messages.column("counts")]).astype(np.int64))
    return keys, sums, np.split(inverse, np.cumsum([len(x) for x in asked])[:-1])


def chunks(batches, text: str, limit: int = CHUNK_BYTES):
    """(number, rows) of the chunks of a task: runs of rows of about ``limit`` text bytes, wherever the batches end."""
    number, held, size = 0, [], 0
    for batch in batches:
        sizes = [16 + (x or 0) for x in pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()]
        a = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= limit:
                held.append(batch.slice(a, i + 1 - a))
                yield number, pa.Table.from_batches(held)
                number, held, size, a = number + 1, [], 0, i + 1
        if a < batch.num_rows:
            held.append(batch.slice(a))
    if held:
        yield number, pa.Table.from_batches(held)


def _chunk_id(number: int) -> int:
    return (TaskContext.get().partitionId() << 32) + number


def _texts(table: pa.Table) -> list[bytes | None]:
    return encoded(table.column("t").combine_chunks())


def _in_order(found: pa.Table) -> np.ndarray:
    """The counts of answers (slice q, found) for one asker, in the order of its keys."""
    order = np.argsort(found.column("q").to_numpy())
    return np.concatenate([np.zeros(0, np.int64), *(unpacked(found.column("found")[int(i)]).astype(np.int64) for i in order)])


def held_out(doc_id):
    """Whether a row is held out; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, mu: float = MU, chunk_bytes: int = CHUNK_BYTES, most_fan: int = MOST_FAN) -> DataFrame:
    """One row a document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training``: a boolean column of ``docs``; the model learns from the rows where it is true. Null texts are empty: their one
    token is the end. Repeated rows are scored, and learned from, each. With no training rows every token is unknown and has
    the probability 1. The input's partitions must come out alike when recomputed, as those of a file scan do (cut others
    first); a chunk that differs fails the job.
    """
    if order < 1 or mu <= 0 or most_fan < 2:
        raise ValueError("order must be at least 1, mu above 0 and most_fan at least 2")
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"), F.coalesce(training, F.lit(False)).alias("r"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    rounds, fan = rounds_for(max(1, -(-total // chunk_bytes)), most_fan)
    # A message goes from (fs, fp) to node (s, p) of the next round: set s of chunks, slice p of the range. Chunks are (chunk, 0).
    schema = "fs long, fp long, s long, p long, keys binary, counts binary, digest long"

    def messages(fs: int, fp: int, s: int, level: int, keys: np.ndarray, counts: np.ndarray, digest: int = 0):
        edges = sliced(keys, fan, fp, fan**level)
        for t in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[t], edges[t + 1])
            blobs = [pa.array([packed(x)], pa.binary()) for x in (np.diff(keys[part], prepend=np.uint64(0)), counts[part])]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (fs, fp, s, fp * fan + t)), *blobs, pa.array([digest], pa.int64())], names=["fs", "fp", "s", "p", "keys", "counts", "digest"])

    def ask(batches):
        for number, table in chunks(batches, "t", chunk_bytes):
            chunk, training = Chunk(_texts(table), order), table.column("r").to_numpy()
            own = _chunk_id(number)
            # Chunks fall into the sets of the first round at random, which keeps these about equal.
            first = int(_mix(np.array([own + 1], np.uint64))[0]) * fan ** (rounds - 1) >> 64
            yield from messages(own, 0, first, 0, chunk.keys, chunk.counts(training), chunk.digest(training))

    def pass_on(level):
        def run(key, table):
            s, p = (k.as_py() for k in key)
            keys, sums, _ = together(table)
            return pa.Table.from_batches(messages(s, p, s // fan, level, keys, sums))

        return run

    def answer(table):
        keys, sums, places = together(table)
        word = (keys & _ONE).astype(bool) & (keys != (_BOS_KEY | _ONE))
        n = [int(sums[word].sum())] + [0] * (len(places) - 1)
        v = [int((sums[word] > 0).sum())] + [0] * (len(places) - 1)
        return pa.table({"fs": table.column("fs"), "fp": table.column("fp"), "p": table.column("p"), "found": pa.array([packed(sums[x]) for x in places], pa.binary()), "digest": table.column("digest"), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})

    def relay(asked, found):
        _, _, places = together(asked)
        sums = _in_order(found)
        return pa.table({"fs": asked.column("fs"), "fp": asked.column("fp"), "p": asked.column("p"), "found": pa.array([packed(sums[x]) for x in places], pa.binary()), "digest": asked.column("digest")})

    sent = [rows.select("t", "r").mapInArrow(ask, schema)]
    for level in range(1, rounds):
        # Stored, for the way back reads them again; the last round's are read once.
        sent[-1] = stored(sent[-1], "ngram")
        sent.append(sent[-1].groupBy("s", "p").applyInArrow(pass_on(level), schema))
    answers = stored(sent[-1].groupBy("s", "p").applyInArrow(answer, "fs long, fp long, p long, found binary, digest long, n long, v long"), "ngram")
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    for asked in sent[-2::-1]:
        back = answers.select(F.col("fs").alias("s"), F.col("fp").alias("p"), F.col("p").alias("q"), "found")
        answers = stored(asked.groupBy("s", "p").cogroup(back.groupBy("s", "p")).applyInArrow(relay, "fs long, fp long, p long, found binary, digest long"), "ngram")

    def number_rows(batches):
        for number, table in chunks(batches, "t", chunk_bytes):
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, _chunk_id(number)))], names=[*batch.schema.names, "chunk"])

    numbered_schema = T.StructType([*rows.schema, T.StructField("chunk", T.LongType())])

    def traverse(table, found):
        chunk, training = Chunk(_texts(table), order), table.column("r").to_numpy()
        counts, digests = _in_order(found), found.column("digest").unique().to_pylist()
        if digests != [chunk.digest(training)] or len(counts) != len(chunk.keys):
            raise RuntimeError("a chunk's documents are not those that were counted; cut the input's lineage first")
        known, base, scores = chunk.score(counts, n, v, mu)
        return pa.table({"d": table.column("d"), "r": table.column("r"), "n_tokens": pa.array(chunk.sizes), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(scores)})

    out = T.StructType([rows.schema["d"], rows.schema["r"], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    numbered = rows.select("d", "t", "r").mapInArrow(number_rows, numbered_schema)
    back = answers.select(F.col("fs").alias("chunk"), F.col("p").alias("q"), "found", "digest")
    scored = numbered.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(traverse, out)
    return scored.select(F.col("d").alias("doc_id"), (~F.col("r")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    return score(docs, ~held_out(F.col(doc_id)), doc_id, text, **how)


def perplexity(score: float, tokens: int) -> float:
    return 10 ** (-score / tokens) if tokens else math.nan
