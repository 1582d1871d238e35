"""Language-model scoring with a hidden Markov model.

Token counts of all training documents are summed over partitions into a table that stays distributed.
Each token belongs to one emission class. The ``OWN`` most frequent ones seen ``MIN_COUNT`` times at
least are a class each; every other token, known or not, falls into one of ``REST`` classes by the
CRC-32 of its letters, so that all tokens give and get evidence of the state while the model stays of a
fixed size at any size of the corpus. Within a class a token's share is its count plus one, over those
of all its tokens and one unknown token; that share is the same in every state, so it leaves the
recursion as a factor: texts are read as classes once, where they lie, for all rounds and the scores; tokens
without a class of their own alone are shuffled to meet their counts, and the likelihood of the whole
text stays exact and normalised.

Baum-Welch: each partition adds up expected counts of starts, transitions and emissions over whole
texts, and the sums are merged in two streamed steps by slices of the classes (first among 64 partitions,
then over all). Every round's model comes from sums over training documents without a choice among them.
The first pass is incremental: it reads each document once, in ``PARTS`` parts, and after each part the
model follows the sums of all parts read so far. ``ROUNDS`` more passes read all documents under one
model each, so the sums that make the final model are of the whole corpus. Long texts go through
the recursion in pieces of ``CELLS`` tokens with the messages carried across, so no start is learned
inside a text and memory is bounded by one text's tokens.

Edge cases: null and empty texts have the end token alone; unknown tokens count as zero; rows with
equal ids or texts are scored apart; without training documents all probabilities are those of the
unknown token; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, settle, texts_of

STATES = 8
PARTS = 8  # of the first pass
ROUNDS = 2
OWN = 1 << 16  # classes of one token
REST = 1 << 14  # classes of all other tokens, at most; fewer while they would hold under ``REST_TOKENS`` each
REST_TOKENS = 64
CELLS = 1 << 18  # tokens and padding that one batch of texts holds, or one piece of a longer text
TEXTS = 2048  # at most that one batch holds
MIN_COUNT = 4  # a state cannot be told from fewer
PRIOR = 0.1  # the share of each state's emissions that follows the counts of all
END = " "  # no word has a space
SLICE = 12_500
FLUSH = 200_000
_ONES = np.ones(STATES, np.float32)
MEMORY = 1_000_000


class Vocabulary(dict):
    """The class of each token: looked up among the frequent ones, else by its CRC-32; remembers a bounded number."""

    def __init__(self, own: dict[bytes, int], rest: int):
        super().__init__(own)
        self.own, self.rest = own, rest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= len(self.own) + MEMORY:
            self.clear()
            self.update(self.own)
        found = self[word] = len(self.own) + zlib.crc32(word) % self.rest
        return found


class Model:
    """Starts, transitions and emissions over the classes: the frequent ``tokens``, then the rest classes."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, rest: np.ndarray, total: int, distinct: int):
        """``rest``: the (count, distinct tokens) of each rest class."""
        self.tokens, self.counts, self.rest, self.total, self.distinct = tokens, counts, rest, total, distinct
        shares = np.concatenate([counts + 1.0, rest.sum(1) + 1.0])
        self.base = shares / shares.sum()
        rng = np.random.default_rng(11)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.4 / STATES) + 0.6 * np.eye(STATES)
        emit = self.base[:, None] * rng.uniform(0.5, 1.5, (len(shares), STATES))
        self.emit = emit / emit.sum(0)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """The maximisation step; without any text the model stays."""
        if not start.sum():
            return
        self.start = (start + 1) / (start.sum() + STATES)
        self.move = (move + 1) / (move.sum(1, keepdims=True) + STATES)
        sums = emit.sum(0)
        self.emit = np.where(sums > 0, (1 - PRIOR) * emit / np.maximum(sums, 1e-300) + PRIOR * self.base[:, None], self.base[:, None])

    def vocabulary(self) -> Vocabulary:
        return Vocabulary({t: k for k, t in enumerate(self.tokens)}, len(self.rest))


def _ids(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    """The classes of the words and of the end."""
    out = np.empty(len(words) + 1, np.int32)
    out[:-1] = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
    out[-1] = vocabulary[END.encode()]
    return out


class _Pass:
    """The recursions over one batch of texts side by side, the longest first, from ``first`` messages."""

    def __init__(self, model: Model, emit: np.ndarray, ids: np.ndarray, active: np.ndarray, first: np.ndarray | None):
        self.model, self.ids, self.active = model, ids, active
        self.e = e = emit[ids]
        self.alpha, self.scale = np.zeros_like(e), np.ones(ids.shape, np.float32)
        move, alpha = model.move.astype(np.float32), first
        for t, n in enumerate(active):
            a = (alpha[:n] @ move if alpha is not None else model.start.astype(np.float32)) * e[t, :n]
            s = a @ _ONES
            self.scale[t, :n] = s
            alpha = self.alpha[t, :n]
            np.divide(a, s[:, None], out=alpha)

    def back(self, after: np.ndarray | None, move_sum: np.ndarray) -> np.ndarray:
        """Turns ``alpha`` into the shares of the states; ``after`` is the message into the last step.

        Returns the message out of the first step, that is, times its emission and scale.
        """
        move, e, alpha = self.model.move.astype(np.float32), self.e, self.alpha
        beta = np.ones((self.ids.shape[1], STATES), np.float32)
        for t in range(len(self.active) - 1, -1, -1):
            if after is not None:
                m = len(after)
                move_sum += self.model.move * (alpha[t, :m].T @ after)
                beta[:m] = after @ move.T
            n = self.active[t]
            after = e[t, :n] * beta[:n] / self.scale[t, :n, None]
            alpha[t, :n] *= beta[:n]
        return after


def expected(model: Model, texts: list[np.ndarray], rows: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, transitions and emissions over the whole texts."""
    start, move, sums = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(model.base), STATES))
    emit = model.emit.astype(np.float32)
    texts = sorted(texts, key=len, reverse=True)

    def add(done: _Pass) -> None:
        flat, gamma = done.ids.ravel(), done.alpha.reshape(-1, STATES)
        for k in range(STATES):
            sums[:, k] += np.bincount(flat, gamma[:, k], len(sums))

    at = 0
    while at < len(texts):
        if len(texts[at]) > CELLS:
            pieces = [texts[at][k : k + CELLS, None] for k in range(0, len(texts[at]), CELLS)]
            first: list = [None]
            for piece in pieces[:-1]:
                first.append(_Pass(model, emit, piece, np.ones(len(piece), np.int64), first[-1]).alpha[-1].copy())
            after = None
            for piece, message in zip(reversed(pieces), reversed(first), strict=True):
                done = _Pass(model, emit, piece, np.ones(len(piece), np.int64), message)
                after = done.back(after, move)
                add(done)
            start += done.alpha[0].sum(0)
            at += 1
            continue
        some = texts[at : at + max(1, min(rows, CELLS // len(texts[at])))]
        at += len(some)
        lengths = np.array([len(x) for x in some])
        ids = np.zeros((lengths[0], len(some)), np.int32)
        for k, x in enumerate(some):
            ids[: len(x), k] = x
        done = _Pass(model, emit, ids, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left"), None)
        done.back(None, move)
        start += done.alpha[0].sum(0)
        add(done)
    return start, move, sums


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of the classes of each text by the scaled forward recursion."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(x) for x in texts], kind="stable")
    lengths = np.array([len(texts[k]) for k in order])
    flat = np.concatenate([texts[k] for k in order])
    at = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    alpha, sums = None, np.zeros(len(texts))
    for t in range(lengths[0]):
        n = active[t]
        e = model.emit[flat[at[:n] + t]]
        alpha = (alpha[:n] @ model.move if t else model.start) * e
        s = alpha.sum(1)
        sums[:n] += np.log10(s)
        alpha /= s[:, None]
    out[order] = sums
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([x.decode() for x in found], pa.string()), pa.array(found.values(), pa.int64())], names=["token", "n"])
        found.clear()
        return out

    for batch in batches:
        for text in texts_of(batch["text"]):
            found.update(text.lower().split())
            found[END.encode()] += 1
            if len(found) > FLUSH:
                yield rows()
    yield rows()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) over all of ``docs``; the end of a text is the token of one space."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


_SUMS = "part int, salt int, places binary, sums binary"


def _row(part: int, salt: int, places: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([places.astype("<i4").tobytes()], pa.binary()), pa.array([sums.astype("<f4" if part else "<f8").tobytes()], pa.binary())], names=["part", "salt", "places", "sums"])


def _packed(ids: list[np.ndarray]) -> pa.Array:
    """Three bytes a class: there are fewer than 2 ** 24."""
    return pa.array([np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes() for x in ids], pa.binary())


def _unpacked(column) -> list[np.ndarray]:
    out = []
    for x in column.to_pylist():
        wide = np.zeros((len(x) // 3, 4), np.uint8)
        wide[:, :3] = np.frombuffer(x, np.uint8).reshape(-1, 3)
        out.append(wide.view("<i4").ravel())
    return out


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, None
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                found = expected(model, _unpacked(batch.slice(k, TEXTS)["ids"]))
                if total is None:
                    total = found
                else:
                    for a, b in zip(total, found, strict=True):
                        a += b
        if total is not None:
            start, move, sums = total
            salt = TaskContext.get().partitionId() >> 6
            yield _row(0, salt, np.zeros(0), np.concatenate([start, move.ravel()]))
            at = np.flatnonzero(sums.any(1))  # of the classes seen here
            for k, own in enumerate(np.split(at, np.searchsorted(at, np.arange(SLICE, len(sums), SLICE)))):
                if len(own):
                    yield _row(1 + k, salt, own - k * SLICE, sums[own])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rows of each (part, salt), which follow each other; one sum is held at a time."""
    key, total = None, None

    def row() -> pa.RecordBatch:
        if key[0] == 0:
            return _row(*key, np.zeros(0), total)
        at = np.flatnonzero(total.any(1))
        return _row(*key, at, total[at])

    for batch in batches:
        for part, salt, places, sums in zip(*(batch[c].to_pylist() for c in ("part", "salt", "places", "sums")), strict=True):
            if (part, salt) != key:
                if key is not None:
                    yield row()
                key, total = (part, salt), np.zeros(STATES + STATES**2) if part == 0 else np.zeros((SLICE, STATES))
            if part == 0:
                total += np.frombuffer(sums)
            else:
                total[np.frombuffer(places, np.int32)] += np.frombuffer(sums, np.float32).reshape(-1, STATES)
    if key is not None:
        yield row()


def _sums(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The expected counts of starts and transitions, in a row, and of emissions over the texts of ``coded``."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    sums = coded.select("ids").mapInArrow(_expect(shared), _SUMS)
    near = sums.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_merge, _SUMS)
    rows = near.withColumn("salt", F.lit(0)).repartition("part").sortWithinPartitions("part", "salt").mapInArrow(_merge, _SUMS).collect()  # of the model's size
    first, emit = np.zeros(STATES + STATES**2), np.zeros((len(model.base), STATES))
    for r in rows:
        if r["part"] == 0:
            first = np.frombuffer(r["sums"])
        else:
            emit[np.frombuffer(r["places"], np.int32) + (r["part"] - 1) * SLICE] = np.frombuffer(r["sums"], np.float32).reshape(-1, STATES)
    shared.unpersist()
    return first, emit


def _updated(model: Model, first: np.ndarray, emit: np.ndarray) -> Model:
    new = Model.__new__(Model)
    new.__dict__.update(model.__dict__)
    new.update(first[:STATES], first[STATES:].reshape(STATES, STATES), emit)
    return new


def classes(counts: DataFrame) -> Model:
    """The untrained model of a corpus with these token counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.where((F.col("token") != END) & (F.col("n") >= MIN_COUNT)).orderBy(F.desc("n"), "token").limit(OWN - 1)
    top = [*counts.where(F.col("token") == END).collect(), *frequent.collect()]  # OWN rows at most
    sizes = np.array([r["n"] for r in top], np.float64)
    number = max(1, min(REST, -(-(distinct - len(top)) // REST_TOKENS)))
    rest = np.zeros((number, 2))
    all_classes = counts.groupBy(_rest_class(number).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("tokens")).collect()  # REST rows at most
    for r in all_classes:
        rest[r["class"]] = r["n"], r["tokens"]
    tokens = [r["token"].encode() for r in top]
    own = np.array([zlib.crc32(x) % number for x in tokens], np.int64)
    np.subtract.at(rest, own, np.stack([sizes, np.ones(len(sizes))], 1))
    return Model(tokens, sizes, rest, total, distinct)


def _rest_class(number: int) -> Column:
    return F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(number)).cast("int")


def train(docs: DataFrame, counts: DataFrame, text_col: str = "text", rounds: int = ROUNDS, warm_rounds: int = PARTS) -> Model:
    """A model of ``docs``; ``counts`` are their token counts."""
    model = classes(counts)
    return fit(code(docs, model, text_col), model, rounds, warm_rounds)


def fit(coded: DataFrame, model: Model, rounds: int = ROUNDS, parts: int = PARTS) -> Model:
    """``model`` after a pass in ``parts`` and ``rounds`` whole ones over all texts of ``coded``."""
    if not model.total:
        return model
    read = None
    for part in range(parts):
        own = _sums(coded.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part), model)
        read = own if read is None else tuple(a + b for a, b in zip(read, own, strict=True))
        model = _updated(model, *read)
    for _ in range(rounds):
        model = _updated(model, *_sums(coded, model))
    return model


def _coded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocabulary, own = model.vocabulary(), len(model.tokens)
        base = np.concatenate([np.log10((model.counts + 1) / (model.total + model.distinct + 1)), np.zeros(len(model.rest))])
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, len(whole), TEXTS):
                batch = whole.slice(k, TEXTS)
                ids, rest = [], []
                for text in texts_of(batch["text"]):  # the words of one text at a time
                    words = text.lower().split()
                    ids.append(_ids(vocabulary, words))
                    words.append(END.encode())
                    rest.append([(w.decode(), n) for w, n in Counter([words[k] for k in np.flatnonzero(ids[-1] >= own).tolist()]).items()])
                offsets = np.cumsum([0, *map(len, rest)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array([w for x in rest for w, _ in x], pa.string()), pa.array([n for x in rest for _, n in x], pa.int64())], names=["token", "n"])
                columns = {
                    "row": pa.array(np.arange(row, row + len(batch))),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "n_frequent": pa.array([int((x < own).sum()) for x in ids], pa.int64()),
                    "base": pa.array([float(base[x].sum()) for x in ids], pa.float64()),
                    "ids": _packed(ids),
                    "rest": pa.ListArray.from_arrays(pa.array(offsets), pairs),
                }
                row += len(batch)
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.record_batch([*(batch[c] for c in names), *columns.values()], names=[*names, *columns])

    return run


def code(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the classes of each text and its tokens of the rest classes, as a written table."""
    rows = docs.select(*(keep or []), F.col(text_col).alias("text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return settle(rows.mapInArrow(_coded(shared), kept + "row long, n_tokens long, n_frequent long, base double, ids binary, rest array<struct<token:string,n:long>>"), "coded")


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), TEXTS):
                batch = whole.slice(k, TEXTS)
                names = [c for c in batch.schema.names if c != "ids"]
                yield pa.record_batch([*(batch[c] for c in names), pa.array(forward(shared.value, _unpacked(batch["ids"])), pa.float64())], names=[*names, "forward"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    return score_coded(code(docs, model, text_col, keep), model, counts, keep or [])


def score_coded(coded: DataFrame, model: Model, counts: DataFrame, keep: list[str]) -> DataFrame:
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = coded.select(*keep, "row", "n_tokens", "n_frequent", "base", "ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "forward double"])
    rest = coded.select("row", F.explode("rest").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    sizes = spark.createDataFrame([(k, float(n + d + 1)) for k, (n, d) in enumerate(model.rest.tolist())], "class int, size double")
    c = F.coalesce("n", F.lit(0)) + F.lit(1.0)
    met = rest.join(counts, "token", "left").withColumn("class", _rest_class(len(model.rest))).join(F.broadcast(sizes), "class")  # REST rows at most
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * F.log10(c / F.lit(float(model.total + model.distinct + 1)))).alias("rest_base"),
        F.sum(F.col("times") * F.log10(c / F.col("size"))).alias("rest_score"),
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    out = rows.mapInArrow(_scored(shared), schema).join(sums, "row", "left")
    return out.select(*keep, "n_tokens", (F.col("n_frequent") + zero("rest_known")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + zero("rest_base")).alias("base_score"), (F.col("forward") + zero("rest_score")).alias("score"))


def score_documents(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document."""
    held = held_out if held_out is not None else doc_remainder(F.col("doc_id"), 7) == 2
    training = docs.where(~held)
    counts = settle(token_counts(training), "token-counts")
    keep = ["doc_id", "_held_out"]
    model = classes(counts)
    coded = code(docs.withColumn("_held_out", held), model, keep=keep)
    model = fit(coded.where("not _held_out"), model)
    return score_coded(coded, model, counts, keep).withColumnRenamed("_held_out", "held_out")
