"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to order three with frozen counts. A byte costs the
negative logarithm of its share in the longest context known; a byte new to a context costs that
context's escape (distinct bytes over total and distinct) and goes on in the next shorter one, down
to one in 256; escapes exclude nothing, so the lengths meet Kraft's inequality. A text's code length under each language is the exact sum over all its bytes, and the
shortest wins; the score is its posterior under equal priors.

Counts are taken by partition from at most about ``TRAIN_DOCS`` documents of a language, chosen by a
hash of id and text, and summed in the shuffle; one row a language and byte quadruple reaches the
driver, bounded by those documents. Contexts of order three seen fewer than ``MIN_CONTEXT`` times in
every language are cut from the trees.

Edge cases: texts that are null, empty or without a letter are ``und`` with score 0; null languages
teach nothing; with no training documents all texts are ``und``; ties go to the first language in
order; bytes never seen cost the escapes to order -1; repeated rows are scored apart; a text of any length is coded whole,
in slices of bounded memory; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, kept, numbered, texts_of

TRAIN_DOCS = 2_000
MIN_CONTEXT = 8
SLICE = 1 << 19
UNKNOWN = "und"
#: A text costs less than this under its language, or it shows no language: bits a byte of letters drawn evenly, and bits more for any text, which one long key or address may cost.
MAX_BITS, SPARE_BITS = math.log2(26), 256


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts with three zero bytes before each, and the text of each byte (-1: the zeros)."""
    data = np.frombuffer(b"".join(b"\0\0\0" + x.lower() for x in texts), np.uint8)
    own = np.repeat(np.arange(len(texts)), [len(x) + 3 for x in texts])
    begins = np.cumsum([0, *(len(x) + 3 for x in texts[:-1])]) if texts else np.zeros(0, np.int64)
    own[(begins[:, None] + np.arange(3)).ravel().astype(np.int64)] = -1
    return data, own


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch["lang"].to_pylist()
        texts = texts_of(batch["text"])
        for lang in sorted(set(langs)):
            chosen = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for k in range(0, len(chosen), 200):
                data, own = _stream(chosen[k : k + 200])
                d = data.astype(np.uint32)
                grams = (d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:])[own[3:] >= 0]
                codes, n = np.unique(grams, return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Code lengths in bits of each byte class after each context, for all languages side by side."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        seen = np.zeros(256, bool)
        seen[0] = True
        for codes, _ in grams.values():
            seen[codes & 255] = True
        self.size = a = int(seen.sum()) + 1
        self.classes = np.full(256, a - 1, np.uint8)  # the last class: bytes never seen
        self.classes[seen] = np.arange(a - 1)
        counts = {}
        total = np.zeros((len(self.langs), a**3), np.int64)
        for k, lang in enumerate(self.langs):
            codes, n = grams[lang]
            c = [self.classes[codes >> s & 255].astype(np.int64) for s in (24, 16, 8, 0)]
            context = (c[0] * a + c[1]) * a + c[2]
            counts[lang] = (context, c[3], n, ((c[1] * a + c[2]) * a + c[3]))
            total[k] = np.bincount(context, n, a**3)
        kept = np.flatnonzero((total >= MIN_CONTEXT).any(0))
        self.context = np.zeros(a**3, np.int32)
        self.context[kept] = np.arange(1, len(kept) + 1)
        self.bits = np.zeros((a**3 + (len(kept) + 1) * a, len(self.langs)), np.float32)
        for k, lang in enumerate(self.langs):
            context, last, n, three = counts[lang]
            second = np.bincount(three, n, a**3).reshape(a, a, a)
            first = second.sum(0)
            p = _escape(first.sum(0)[None], np.full((1, a), 1 / 256))
            p = _escape(first, np.broadcast_to(p, (a, a)))
            p = _escape(second.reshape(-1, a), np.tile(p, (a, 1)))
            self.bits[: a**3, k] = -np.log2(p.ravel())
            known = self.context[context] > 0
            third = np.bincount(((self.context[context].astype(np.int64) - 1) * a + last)[known], n[known], len(kept) * a).reshape(-1, a)
            q = _escape(third, p[kept % a**2])
            self.bits[a**3 + a :, k] = -np.log2(q.ravel())

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        data, own = _stream(texts)
        out = np.zeros((len(texts) + 1, len(self.langs)))
        a = self.size
        for k in range(3, len(data), SLICE):
            d = self.classes[data[k - 3 : k + SLICE]].astype(np.int32)
            two = d[1:-2] * a + d[2:-1]
            near = two * a + d[3:]
            context = self.context[d[:-3] * (a * a) + two]
            at = np.where(context > 0, a**3 + context * a + d[3:], near)
            bits = self.bits[at]
            place = own[k : k + SLICE] + 1
            top = len(texts) + 1
            for lang in range(len(self.langs)):
                out[:, lang] += np.bincount(place, bits[:, lang], top)
        return out[1:]


def _escape(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Shares in each context, of what is new in it by the shorter context; unseen contexts are the shorter one."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    whole = np.maximum(total + distinct, 1)
    return np.where(total == 0, shorter, np.where(counts > 0, counts / whole, distinct / whole * shorter))


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model from the rows of ``docs`` where ``learn`` holds."""
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = rows.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return None
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, train_docs / r["count"])))))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    counts = rows.where(place < F.element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow().to_pandas()
    grams = {lang: (g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in found.groupby("lang")}
    return Model(grams) if grams else None


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language", dict)  # a worker that encoded tokens before holds none of them now
        for whole in batches:
            for k in range(0, len(whole), 300):  # what is held and sent on stays as small
                batch = whole.slice(k, 300)
                preds, scores, costs = [], [], []
                texts = texts_of(batch["text"])
                model = shared.value
                bits = model.lengths(texts) if model else None
                for j, text in enumerate(texts):
                    if model is None or not any(map(str.isalpha, text.decode())):
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        costs.append(float(8 * len(text)))
                    else:
                        best = int(bits[j].argmin())
                        preds.append(model.langs[best])
                        costs.append(float(bits[j, best]))
                        scores.append(float(1 / np.exp2(np.minimum(0, bits[j, best] - bits[j])).sum()))
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.record_batch([*(batch[c] for c in names), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(costs, pa.float64())], names=[*names, "lang_pred", "score", "bits"])

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and bits, the code length under that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(keep or []), F.col(text_col).alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double, bits double"])
    return rows.mapInArrow(_scored(shared), schema)


def identify(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each document; held-out rows teach nothing."""
    held = held_out if held_out is not None else doc_remainder(F.col("doc_id"), 4) == 2
    model = train(docs, ~held)
    return predict(docs.withColumn("_held_out", held), model, keep=["doc_id", "_held_out"]).select("doc_id", F.col("_held_out").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in a language that their labels teach, with all their columns.

    Texts without a letter go, texts whose best language scores under ``min_score``, and texts that cost
    ``MAX_BITS`` bits a byte and ``SPARE_BITS`` more under it: no language taught explains them better
    than letters drawn at random. Columns may have any names.
    """
    model = train(docs, F.lit(True), text_col, lang_col, id_col)
    plain = numbered(docs)
    text = f"c{docs.columns.index(text_col)}"
    told = predict(plain, model, text, plain.columns)
    explained = F.col("bits") <= MAX_BITS * F.octet_length(text) + SPARE_BITS
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & explained).select(*plain.columns).toDF(*docs.columns)
