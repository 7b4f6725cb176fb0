"""Language-model scoring with Katz backoff.

P(w | h) is the Good-Turing discounted relative frequency of an n-gram that was seen ``MIN_COUNT`` times
(once for single tokens), and alpha(h) P(w | h') otherwise, h' being h without its first token.  alpha is
what the discounts leave over, divided by the lower order's probability of all words unseen after h: the
probabilities of all known words and the unknown one sum to exactly one after every h.

The corpus is cut into chunks, a row each: local token ids plus the hashes of the chunk's words.  N-gram
counts live in tables partitioned by key range.  For each order, every chunk sends each table partition
its distinct keys with its own training counts; the partition adds them up, keeps the n-grams that the
model holds, and answers each chunk with the totals of its keys.  The weights alpha are gathered and
answered in the same way.  Each chunk then holds all it needs to evaluate its tokens recursively.  No
step sends a token twice, and no history's n-grams are gathered in one place: keys are spread by hash.

Defined results: null and empty texts are the end token alone.  Rows that repeat an id are scored each.
Without training documents every token is the unknown one, with probability 1.  A null id is in fold 0.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, release_shuffles, settled, table
from .packed import give_back, pack, pack_sorted, runs, slices, unpack, unpack_sorted
from .word_arrays import U, mix, word_hashes

ORDER = 2
MIN_COUNT = 1                # of an n-gram of two or more tokens to be held by the model; 1: every one seen
DISCOUNTED = 5               # counts up to this are discounted
HELD_OUT_FOLD = 1
CHUNK_TOKENS = 1 << 21       # of a chunk, about; a longer text is a chunk of its own
PART_KEYS = 1 << 21          # keys a table partition is sent, about
START, END = U(0x53544152545F5F5F), U(0x454E445F5F5F5F5F)

ANSWER = "chunk long, part int, level int, body binary, stats array<long>"


# --- chunks ---------------------------------------------------------------------------------------

def chunks(docs: DataFrame) -> DataFrame:
    """chunk, ids, held, lengths (in tokens, with the end), words (sorted hashes), order (of ids in words), tokens."""

    def row(ids, held, lengths, parts) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        words, local, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable").astype(np.uint32)      # small ids for frequent words
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())),
            "lengths": pa.array([lengths], pa.list_(pa.int32())), "words": pa.array([pack_sorted(words)], pa.binary()),
            "order": pa.array([pack(order)], pa.binary()), "tokens": pa.array([pack(rank[local])], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lengths, parts, n = [], [], [], [], 0
        end = np.array([END])
        for batch in batches:
            doc_ids, out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for first, hashes, offsets in word_hashes(batch.column("text")):
                for k in range(len(offsets) - 1):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    if n and n + b - a > CHUNK_TOKENS:
                        yield row(ids, held, lengths, parts)
                        ids, held, lengths, parts, n = [], [], [], [], 0
                    ids.append(doc_ids[first + k])
                    held.append(out[first + k])
                    lengths.append(b - a + 1)
                    parts += [hashes[a:b], end]
                    n += b - a + 1
        if ids:
            yield row(ids, held, lengths, parts)
        give_back()

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "text")
    cut = rows.mapInArrow(run, "ids array<long>, held array<boolean>, lengths array<int>, words binary, order binary, tokens binary")
    return cut.select(F.monotonically_increasing_id().alias("chunk"), "*")


class Chunk:
    """A chunk's token sequence, each document as start, words, end."""

    def __init__(self, row: dict) -> None:
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        words, order = unpack_sorted(row["words"]), unpack(row["order"], np.uint32)
        tokens = words[order][unpack(row["tokens"], np.uint32)]
        lengths = np.array(row["lengths"], np.int64)
        ends = np.cumsum(lengths + 1)                              # with the start tokens
        firsts = ends - lengths - 1
        self.firsts = firsts
        self.hashes = np.empty(len(tokens) + len(lengths), U)
        is_start = np.zeros(len(self.hashes), bool)
        is_start[firsts] = True
        self.hashes[is_start], self.hashes[~is_start] = START, tokens
        doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.training = ~self.held[doc]
        self.place = np.arange(len(self.hashes)) - firsts[doc]     # 0: the start token
        self._levels: dict[int, tuple] = {}

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last positions, distinct keys ascending, index of each n-gram's key); n-grams stay in their document.

        The first tokens of a document have no longer n-grams than from its start token on.  Level 1 holds
        the start tokens too, as histories.
        """
        if n not in self._levels:
            at = np.flatnonzero(self.place >= n - 1)
            keys = self.hashes[at] if n == 1 else np.full(len(at), U(n), U)
            if n > 1:
                for k in range(n - 1, -1, -1):
                    keys = mix(keys ^ self.hashes[at - k])
            distinct, index = np.unique(keys, return_inverse=True)
            self._levels[n] = at, distinct, index
        return self._levels[n]

    def counts(self, n: int) -> np.ndarray:
        """Training count of each distinct key in this chunk."""
        at, distinct, index = self.level(n)
        return np.bincount(index[self.training[at]], minlength=len(distinct)).astype(np.uint32)

    def history(self, n: int) -> np.ndarray:
        """For each n-gram (n > 1): index of its first n - 1 tokens among the keys of level n - 1."""
        at = self.level(n)[0]
        lower_at, _, lower_index = self.level(n - 1)
        where = np.empty(len(self.hashes), np.int64)
        where[lower_at] = lower_index
        return where[at - 1]


# --- what tables answer ---------------------------------------------------------------------------

def ask(rows: DataFrame, parts: int, message: Callable[[dict], tuple[np.ndarray, list[np.ndarray]]],
        answer: Callable, fields: list, level: int) -> DataFrame:
    """Send each chunk's keys and values to the table partitions, and what these make of them back.

    ``message(row)``: ascending keys and value arrays of a chunk.  ``answer(keys, index, values)``: all
    distinct keys of a partition, and for each sent key the index of its distinct one, with the values
    sent; gives (what chunks get: arrays over the distinct keys or, where marked, over the keys sent;
    the table partition or None; statistics or None).
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, values = message(row)
                bounds = slices(keys, parts)
                out = {"part": [], "chunk": [], "keys": [], "values": []}
                for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    if b > a:
                        out["part"].append(p)
                        out["chunk"].append(row["chunk"])
                        out["keys"].append(pack_sorted(keys[a:b]))
                        out["values"].append([pack(v[a:b]) for v in values])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(out["part"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int64()),
                    "keys": pa.array(out["keys"], pa.binary()), "values": pa.array(out["values"], pa.list_(pa.binary()))})

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["part"]):
            part, senders = group.column("part")[0].as_py(), group.column("chunk").to_pylist()
            sent = [unpack_sorted(k) for k in group.column("keys").to_pylist()]
            values = [np.concatenate([unpack(v[i], t) for v in group.column("values").to_pylist()]) for i, t in enumerate(fields)]
            keys, index = np.unique(np.concatenate(sent), return_inverse=True)
            back, held, stats = answer(keys, index, values)
            rows, at = [], 0
            for chunk, k in zip(senders, sent):
                own = index[at:at + len(k)]
                first = np.arange(at, at + len(k))
                arrays = [pack(v[first] if by_sender else v[own]) for v, by_sender in back]
                rows.append((chunk, part, level, b"".join(len(x).to_bytes(8, "little") + x for x in arrays), None))
                at += len(k)
            rows.append((None, part, level, held, stats))
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int32()),
                "level": pa.array([r[2] for r in rows], pa.int32()), "body": pa.array([r[3] for r in rows], pa.binary()),
                "stats": pa.array([r[4] for r in rows], pa.list_(pa.int64()))})
        give_back()

    release_shuffles(rows.sparkSession)
    sent = rows.mapInArrow(send, "part int, chunk long, keys binary, values array<binary>")
    return settled(sent.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(reply, ANSWER),
                   drop_shuffles=True)


def read_answers(answers: list[dict] | None, level: int, dtypes: list) -> list[np.ndarray]:
    """A chunk's answers of one level, put together in key order."""
    out: list[list[np.ndarray]] = [[] for _ in dtypes]
    for a in sorted((a for a in answers or () if a["level"] == level), key=lambda a: a["part"]):
        body, at = a["body"], 0
        for k, dtype in enumerate(dtypes):
            n = int.from_bytes(body[at:at + 8], "little")
            out[k].append(unpack(body[at + 8:at + 8 + n], dtype))
            at += 8 + n
    return [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, dtypes)]


def adder(level: int, min_count: int) -> Callable:
    """Adds up counts; chunks get (total, whether they are the first to send the key); statistics of totals."""
    def answer(keys, index, values):
        total = np.bincount(index, weights=values[0], minlength=len(keys)).astype(np.int64)
        first = np.zeros(len(index), bool)
        first[np.unique(index, return_index=True)[1]] = True
        told = total[keys != START] if level == 1 else total
        n_r = np.bincount(np.minimum(told, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:DISCOUNTED + 2]
        held = total >= min_count
        table = (lambda k, c: len(k).to_bytes(8, "little") + k + c)(pack_sorted(keys[held]), pack(total[held]))
        stats = [int(told.sum()), int((told > 0).sum()), *map(int, n_r)]
        return [(total, False), (first, True)], table, stats
    return answer


def weigher(least: float) -> Callable:
    """Adds up, per history, seen probability mass of both orders; chunks get log10 alpha and the reserve.

    ``least``: what the lower order leaves to unseen words at the least, so that rounding can't take it below.
    """
    def answer(keys: np.ndarray, index: np.ndarray, values: list[np.ndarray]) -> tuple:
        mass, lower = (np.bincount(index, weights=v, minlength=len(keys)) for v in values[:2])
        size = np.zeros(len(keys))
        size[index] = values[2]                                  # the history's count, equal from every sender
        # where all a history's tokens are held undiscounted, one more is reserved for the others
        reserve = (mass > 0) & (mass >= size - 1e-9)
        seen = np.divide(mass, size + reserve, out=np.zeros_like(mass), where=size > 0)
        alpha = np.where(mass > 0, (1 - seen) / np.maximum(1 - lower, least), 1.0)
        return [(np.log10(alpha), False), (reserve, False)], None, None
    return answer


# --- the model ------------------------------------------------------------------------------------

def discounts(n_r: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0..DISCOUNTED (after Katz); 1 where the counts of counts can't tell."""
    out = np.ones(DISCOUNTED + 1)
    k = DISCOUNTED
    if n_r[0] and n_r[k]:
        common = (k + 1) * n_r[k] / n_r[0]
        for r in range(1, k + 1):
            if n_r[r - 1] and common < 1:
                d = ((r + 1) * n_r[r] / (r * n_r[r - 1]) - common) / (1 - common)
                if 0 < d < 1:
                    out[r] = d
    return out


class Katz:
    """Global numbers of the model: sizes and discounts of each order."""

    def __init__(self, stats: dict[int, list[int]]) -> None:
        self.tokens, self.types = stats[1][0], stats[1][1]
        self.starts = 0
        self.factor = {n: discounts(s[2:]) for n, s in stats.items()}
        n_r = stats[1][2:2 + DISCOUNTED]
        d = self.factor[1]
        kept = self.tokens - sum((1 - d[r]) * r * n_r[r - 1] for r in range(1, DISCOUNTED + 1))
        # the unknown token gets what the discounts leave, or as much as one more token if they leave nothing
        self.unknown = (self.tokens - kept) / self.tokens if self.tokens and self.tokens - kept > 1e-9 else 1 / (self.tokens + 1)
        self.scale = (1 - self.unknown) / kept if kept else 0.0

    def discounted(self, counts: np.ndarray, n: int) -> np.ndarray:
        return counts * self.factor[n][np.where(counts <= DISCOUNTED, counts, 0)]

    def single(self, counts: np.ndarray) -> np.ndarray:
        """P of single tokens with these counts."""
        return np.where(counts > 0, self.discounted(counts, 1) * self.scale, self.unknown)


def evaluated(chunk: Chunk, answers: list[dict], model: Katz, order: int, min_count: int) -> np.ndarray:
    """log10 P of each position under orders up to ``order`` (start tokens: 0)."""
    at, _, index = chunk.level(1)
    counts = {1: read_answers(answers, 1, [np.int64, bool])[0]}
    logs = np.log10(model.single(counts[1]))[index]
    logs[chunk.place == 0] = 0.0
    for n in range(2, order + 1):
        at, _, index = chunk.level(n)
        counts[n] = read_answers(answers, n, [np.int64, bool])[0]
        alpha, reserve = read_answers(answers, -n, [np.float64, bool])
        history = chunk.history(n)
        c = counts[n][index]
        held = c >= min_count
        size = counts[n - 1][history] + reserve[history]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10(model.discounted(c, n)) - np.log10(size)
        logs[at] = np.where(held, seen, alpha[history] + logs[at])
    return logs


def weight_message(model: Katz, n: int, min_count: int) -> Callable:
    """For each history of order ``n`` in a chunk: mass of its n-grams that this chunk was first to send, their
    lower-order probability, and the history's count."""
    def message(row: dict):
        chunk = Chunk(row)
        lower_logs = evaluated(chunk, row["answers"], model, n - 1, min_count)
        at, distinct, index = chunk.level(n)
        counts, first = read_answers(row["answers"], n, [np.int64, bool])
        one = np.zeros(len(distinct), np.int64)
        one[index] = np.arange(len(index))                            # an occurrence of each key
        own = np.flatnonzero(first & (counts >= min_count))
        history = chunk.history(n)[one[own]]
        keys = chunk.level(n - 1)[1]
        mass = np.bincount(history, weights=model.discounted(counts[own], n), minlength=len(keys))
        lower = np.bincount(history, weights=10.0 ** lower_logs[at[one[own]]], minlength=len(keys))
        size = read_answers(row["answers"], n - 1, [np.int64, bool])[0].astype(np.float64)
        return keys, [mass, lower, size]
    return message


def with_answers(cut: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Chunks with all the answers they got."""
    told = answers[0]
    for a in answers[1:]:
        told = told.unionByName(a)
    told = (told.filter("chunk is not null").groupBy(F.col("chunk").alias("_c"))
            .agg(F.collect_list(F.struct("part", "level", "body")).alias("answers")))     # bounded by the chunk's size
    return cut.join(told, F.col("chunk") == F.col("_c")).drop("_c")


def katz_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(scores per document, tables: level, part and held n-gram keys with their counts)."""
    cut = settled(chunks(docs))
    total = cut.agg(F.sum(F.expr("aggregate(lengths, 0L, (s, x) -> s + x)"))).first()[0] or 0
    parts = max(1, total // PART_KEYS)
    answers, stats = [], {}
    for n in range(1, order + 1):
        got = ask(cut, parts, lambda row, n=n: (lambda c: (c.level(n)[1], [c.counts(n)]))(Chunk(row)),
                  adder(n, 1 if n == 1 else min_count), [np.uint32], n)
        width = DISCOUNTED + 3
        sums = got.filter("chunk is null").agg(*[F.sum(F.get("stats", F.lit(k))) for k in range(width)]).first()
        stats[n] = [int(x or 0) for x in sums]
        answers.append(got)
        if n > 1:
            model = Katz(stats)
            least = model.unknown if n == 2 else np.finfo(np.float64).epsneg   # the unknown token is never seen
            answers.append(ask(with_answers(cut, answers), parts, weight_message(model, n, min_count),
                               weigher(least), [np.float64, np.float64, np.float64], -n))
    model = Katz(stats)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                logs = evaluated(chunk, row["answers"], model, order, min_count)
                _, _, index = chunk.level(1)
                counts = read_answers(row["answers"], 1, [np.int64, bool])[0].astype(np.float64)[index]
                real = chunk.place > 0
                base = np.where(real, np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.types + 1))), 0.0)
                add = lambda x: np.add.reduceat(x, chunk.firsts)      # noqa: E731
                n = len(chunk.ids)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(chunk.ids, pa.int64()), "held_out": pa.array(chunk.held, pa.bool_()),
                    "n_tokens": pa.array(add(real.astype(np.int64)), pa.int64()),
                    "n_known": pa.array(add((real & (counts > 0)).astype(np.int64)), pa.int64()),
                    "train_tokens": pa.array(np.full(n, model.tokens), pa.int64()),
                    "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(logs), pa.float64())})
        give_back()

    release_shuffles(docs.sparkSession)
    scores = with_answers(cut, answers).mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    tables = answers[0].filter("chunk is null and level > 0").select("level", "part", "body")
    for a in answers[1:]:
        tables = tables.unionByName(a.filter("chunk is null and level > 0").select("level", "part", "body"))
    return scores, tables


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents", "doc_id", "text"))[0]
