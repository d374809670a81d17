"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of +1 and -1 bits. For each bit a binary classifier, a
log-odds weight per hashed n-gram, tells the languages with +1 from those with -1. A
text's mean weight gives one margin per bit; loss-weighted decoding adds up the
logistic losses of a codeword's bits, each weighted by how well its classifier
separates, and takes the codeword of least loss. A text whose two best codewords are
about as near is flagged as ambiguous.

Training reads at most about ``SAMPLE`` documents a language (a documented bound),
chosen by a hash of doc_id; n-gram counts are summed by Spark and only the table
of ``languages x BUCKETS`` sums comes to the driver. Prediction reads the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with
one learned language every other text is that language; with none (or an empty
table) all are ``und``; a null doc_id counts as the empty text in the fold rule;
repeated rows get equal predictions; a text of any length is read whole, its n-grams in
blocks; further columns are ignored, a kept one may have any name but a result's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import columns, ship_package

FOLDS, HELD_OUT = 3, 1
SAMPLE = 1500
BUCKETS = 1 << 15
NGRAMS = (2, 3, 4)
#: Two best codewords nearer than this, as a share of their loss, are ambiguous.
NARROW = 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 16


def held_out() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


def grams(text: str):
    """Hashed n-gram buckets of a whole text, lower-cased, in blocks."""
    data = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "replace") + b" ", np.uint8)
    data = data.astype(np.uint32)
    most = max(NGRAMS)
    for at in range(0, len(data), _BLOCK):
        part = data[at : at + _BLOCK + most - 1]
        for n in NGRAMS:
            size = min(_BLOCK, len(part) - n + 1)
            if size <= 0:
                continue
            h = np.full(size, n, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) ^ part[i : i + size]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            yield (h >> np.uint32(17)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """``n`` x bits matrix of +1/-1, rows far apart; all splits for up to six languages, else a seeded choice."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    bits, rng = int(np.ceil(12 * np.log2(n))), np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(50):
        code = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        distance = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if (np.abs(code.sum(axis=0)) < n).all() and distance.min() > apart:
            best, apart = code, distance.min()
    return best


class Model:
    """Languages, codewords, weights ``BUCKETS`` x bits, scale and trust of each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: languages x BUCKETS."""
        self.languages, self.code = languages, codewords(len(languages))
        if not languages:
            return
        share = (counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * BUCKETS)
        yes, no = np.maximum(self.code, 0), np.maximum(-self.code, 0)
        mean = lambda part: (part.T @ share) / np.maximum(part.sum(axis=0), 1)[:, None]
        one, other = mean(yes), mean(no)
        fill = share.mean(axis=0) / 100 + 1e-12
        self.weights = (np.log(one + fill) - np.log(other + fill)).T.astype(np.float32)
        expected = share @ self.weights  # languages x bits: the margin of a typical text
        low = np.array([expected[c > 0, b].min() if (c > 0).any() else 0 for b, c in enumerate(self.code.T)])
        high = np.array([expected[c < 0, b].max() if (c < 0).any() else 0 for b, c in enumerate(self.code.T)])
        self.middle, self.scale = (low + high) / 2, np.maximum((low - high) / 2, 1e-3)
        self.trust = self.scale / self.scale.sum()

    def losses(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for buckets in grams(text):
            total += self.weights[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        margin = (total / max(n, 1) - self.middle) / self.scale
        return np.logaddexp(0, -2 * self.code * margin) @ self.trust

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if text is None or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(text)
        best, second = np.argsort(loss, kind="stable")[:2]
        odds = np.exp(-4 * (loss - loss[best]))
        return self.languages[best], float(odds[best] / odds.sum()), bool(loss[second] - loss[best] < NARROW * loss[second])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows of ``docs(doc_id, text, lang)`` outside the held-out fold."""
    ship_package(docs.sparkSession)
    rows = columns(docs, "doc_id", "text", "lang").where(
        ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    # a hash of doc_id under a bound that lets about `sample` rows of each language pass
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20))
    bound = F.lit(0)
    for lang in languages:
        bound = F.when(F.col("lang") == lang, F.lit(min(1 << 20, sample * (1 << 20) // sizes[lang]))).otherwise(bound)
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(number[lang], np.zeros(BUCKETS, np.int64))
                for buckets in grams(text):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])],
                names=["lang", "bucket", "n"],
            )

    counts = np.zeros((len(languages), BUCKETS))
    chosen = rows.where(place < bound).select("lang", F.col("text").cast("string").alias("text"))
    summed = chosen.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for frame in [summed.toPandas()] if languages else []:
        counts[frame["lang"].to_numpy(int), frame["bucket"].to_numpy(int)] = frame["n"].to_numpy(float)
    return Model(languages, counts)


def identify(
    docs: DataFrame, model: Model, *keep: str, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")
) -> DataFrame:
    """``keep``, ``lang_pred``, ``score``, ``ambiguous`` (under ``names``) of every row of ``docs``; no shuffle."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and BUCKETS x bits numbers
    keep = keep or ("doc_id",)
    if clash := set(keep) & set(names):
        raise ValueError(f"columns {sorted(clash)} are results")
    numbered = [f"k{i}" for i in range(len(keep))]  # kept columns may have any name
    kept = [F.col(f"`{k}`").alias(n) for k, n in zip(keep, numbered)]
    narrow = docs.select(*kept, F.col("`text`").cast("string").alias("_text"))
    types = [docs.schema[k].dataType.simpleString() for k in keep]
    schema = ", ".join([f"{n} {t}" for n, t in zip(numbered, types)] + ["_lang string, _score double, _unclear boolean"])

    def run(batches):
        model = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            said = [model.predict(t) for t in table.column("_text").to_pylist()]
            lang, score, unclear = zip(*said) if said else ((), (), ())
            out = table.select(numbered).append_column("_lang", pa.array(lang, pa.string()))
            out = out.append_column("_score", pa.array(score, pa.float64()))
            yield from out.append_column("_unclear", pa.array(unclear, pa.bool_())).to_batches()

    return narrow.mapInArrow(run, schema).toDF(*keep, *names)
