"""Language identification by error-correcting output codes.

Every language has a codeword; for each of its bits a binary classifier over hashed character n-grams tells the languages
with a one from those with a zero. Decoding is loss-weighted: the codeword with the least loss wins, each bit counting as
much as its classifier is worth for that language. All weights follow from one table: n-gram counts by language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, in_batches, text_of

#: Hash buckets of n-grams of one, two and three characters; characters that are scored at once (a bound of memory).
BUCKETS, ORDERS, CHUNK = 1 << 13, 3, 1 << 20
#: Losses nearer than this share of the bits' weight are flagged as ambiguous.
AMBIGUOUS = 0.02

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _buckets(chars: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that begins at each character, by order; whether each character is a letter."""
    a = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[a]
    a = np.where(letter, a, np.uint32(32))
    h, seen, grams = a * np.uint32(0x9E3779B1), letter.copy(), []
    for order in range(ORDERS):
        if order:
            h = h[:-1] * np.uint32(0x85EBCA6B) + a[order:] * np.uint32(0xC2B2AE35)
            seen = seen[:-1] | letter[order:]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = (mixed >> np.uint32(32 - 13)).astype(np.int32)
        # n-grams without a letter say nothing; they and the ends fall into a bucket of their own
        grams.append(np.pad(np.where(seen, bucket, BUCKETS), (0, order), constant_values=BUCKETS))
    return np.stack(grams), letter


def _grams(texts: list[str], chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(first text, texts, bucket of each n-gram, where each text's begin, letters of each text, whether the text goes on).

    Letters are lower-cased, anything else reads as a blank. Blanks go in front of each text, inside its own stretch, and
    after the last one: no n-gram has letters of two texts, and a text has the same n-grams alone as among others. A text of
    more than ``chunk`` characters comes in stretches of so many, and each of its n-grams in one of them.
    """
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + len(texts[last]) < chunk):
            chars += len(texts[last])
            last += 1
        own = [t.lower() for t in texts[first:last]]
        if len(own) == 1 and len(own[0]) > chunk:
            whole, n = "\0" * ORDERS + own[0] + "\0" * ORDERS, len(own[0]) + ORDERS
            for p in range(0, n, chunk):
                q = min(n, p + chunk)
                grams, letter = _buckets(whole[p : q + ORDERS])
                yield first, 1, grams[:, : q - p], np.zeros(1, np.int64), letter[: q - p].sum(keepdims=True), q < n
        else:
            starts = np.concatenate([[0], np.cumsum([len(t) + ORDERS for t in own])[:-1]]).astype(np.int64)
            grams, letter = _buckets("".join("\0" * ORDERS + t for t in [*own, ""]))
            yield first, last - first, grams, starts, np.add.reduceat(letter, starts, dtype=np.int64), False
        first = last


def training(id_col: str = "doc_id") -> Column:
    """The rows to learn from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: the exhaustive code up to seven classes, then the most spread of seeded random codes."""
    if n <= 7:
        bits = (1 << (n - 1)) - 1
        # column j tells the classes in the binary form of j from the rest; class 0 always reads 1
        return np.array([[1 if i == 0 or not (j >> (i - 1)) & 1 else -1 for j in range(1, bits + 1)] for i in range(n)], dtype=np.int8).reshape(n, bits)
    rng, best, far = np.random.default_rng(1), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, 10 * int(np.ceil(np.log2(n)))))
        apart = ((code.shape[1] - code.astype(int) @ code.T) // 2 + code.shape[1] * np.eye(n, dtype=int)).min()
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # (buckets + 1) x bits: log odds; the last row is zero
    worth: np.ndarray  # languages x bits: mean margin of the language's own n-grams, at least a little

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, score, unclear = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        bits, counts, held = self.code.shape[1], None, 0
        # what is gathered at once is weights of bits x characters, so more bits mean fewer characters
        for first, n, grams, starts, letters, more in _grams(texts, min(CHUNK, (1 << 23) // max(bits, 1))):
            if more or counts is not None:  # a stretch of a long text: its n-grams are counted, whatever its length
                seen = np.bincount(grams.ravel(), minlength=BUCKETS + 1)
                counts, held = (seen, int(letters[0])) if counts is None else (counts + seen, held + int(letters[0]))
                if more:
                    continue
                margin, letters = (counts @ self.weights / max(1, counts[:BUCKETS].sum()))[None], np.array([held])
                counts, held = None, 0
            elif bits:
                total = sum(np.add.reduceat(self.weights[g], starts, axis=0, dtype=np.float64) for g in grams)
                margin = total / np.maximum(1, sum(np.add.reduceat(g < BUCKETS, starts, dtype=np.int64) for g in grams))[:, None]
            else:
                margin = np.zeros((n, 0))
            for k in range(n):
                if letters[k] and self.languages:
                    share = self.worth / max(self.worth.sum(), 1e-9) * len(self.languages)
                    loss = (share * np.log1p(np.exp(-8 * self.code * margin[k]))).sum(1)
                    p = np.exp(-12 * (loss - loss.min()))
                    order = np.argsort(loss, kind="stable")
                    names[first + k], score[first + k] = self.languages[order[0]], float(1 / p.sum())
                    unclear[first + k] = len(order) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUOUS
        return names, score, unclear


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn from the rows given: those with a language. What reaches the driver is one count by language and bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                own = total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for _, _, grams, *_ in _grams(texts.tolist()):
                    for g in grams:
                        own += np.bincount(g, minlength=BUCKETS + 1)
        for lang, own in total.items():
            at = np.flatnonzero(own[:BUCKETS])
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_of(text_col).alias("text"))
    counts = in_batches(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    by = np.zeros((len(languages), BUCKETS))
    by[counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
    by = (by + 0.5) / (by + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages)) if languages else np.zeros((0, 0), np.int8)
    weights = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    for j in range(code.shape[1]):
        weights[:BUCKETS, j] = np.log(by[code[:, j] > 0].mean(0)) - np.log(by[code[:, j] < 0].mean(0))
    worth = np.maximum((by @ weights[:BUCKETS]) * code, 1e-3) if code.size else np.zeros(code.shape)
    return Model(languages, code, weights, worth)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, lang_pred, score (0 to 1), ambiguous.

    Null text, or text without a letter: ``und``, score 0. So is all text if nothing could be learned. Whole texts count;
    other columns are ignored; repeated rows give repeated results; ids of any type come back as they are, null ones too.
    """

    def run(batch: dict[str, list], _: int) -> Iterator[tuple[None, dict]]:
        names, score, unclear = model.predict(batch["text"])
        yield None, {"lang_pred": names, "score": score, "ambiguous": unclear}

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return in_arrow(rows, run, "lang_pred string, score double, ambiguous boolean", ["doc_id"])
