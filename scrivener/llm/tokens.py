"""Token counts with a digest cache, and the encoder that packing shares with it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialize, shared_root, text_of

#: Words that an encoder remembers before it starts afresh.
REMEMBERED = 600_000
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼½¾"
#: The split of byte-level BPE for the code points in _PLAIN, whose classes all Unicode versions agree on; longer ones go whole to the library.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_STRANGE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ–—‘’“”•…€]")


class Encoder:
    """ids of whole texts by ``tokenizers``, without added special tokens; special strings inside texts as its default.

    The library splits a text into words and encodes each by itself. For texts of well-known code points we split, and ask
    the library once for each distinct word; any other text, and any text that holds an added token, goes to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        split = self.library.pre_tokenizer
        self.by_word = self.library.normalizer is None and isinstance(split, ByteLevel) and not split.add_prefix_space and split.use_regex
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or _STRANGE.search(text) or any(t in text for t in self.added):
            return self._ask([text])[0]
        words = _SPLIT.findall(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            self._learn([w for w in dict.fromkeys(words) if w not in known])
            return b"".join([known[w] for w in words])

    def _learn(self, new: list[str]) -> None:
        """Words of a blank and letters stay words when joined, so one call encodes them all."""
        import numpy as np

        alike = [w for w in new if w[0] == " " and w[1:].isalpha()]
        if alike:
            got = self.library.encode("".join(alike), add_special_tokens=False)
            ids, word = np.array(got.ids, dtype="<u4").tobytes(), np.array(got.word_ids)
            ends = [*np.flatnonzero(np.diff(word)) + 1, len(word)]
            if len(ends) == len(alike):
                begin = 0
                for w, end in zip(alike, ends, strict=True):
                    self.known[w] = ids[4 * begin : 4 * end]
                    begin = end
                new = [w for w in new if w not in self.known]
        self.known.update(zip(new, self._ask(new), strict=True))

    def _ask(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces_counter(path: str):
    """sentencepiece models: begin and end signs are not added by default."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text))


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import hashlib
    from importlib.metadata import version

    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{kind} {version(kind)}".encode()).hexdigest()[:32]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


CACHE_SCHEMA = "digest string, n_tokens long, tokenizer string"


def new_cache(spark: SparkSession) -> str:
    """Path of an empty cache in the shared folder."""
    import uuid

    return f"{shared_root(spark)}/token-cache-{uuid.uuid4().hex}"


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """digest, n_tokens, tokenizer; a filter on the tokenizer version reads that folder alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), digest.

    The content is normalised only by reading null as the empty text, as anything more would change counts. Contents are
    known by 128 bits of SHA-256. Digests that the cache lacks for this tokenizer version are encoded, each once, and
    appended to its folder; a second call encodes nothing. What is asked is found by digests alone: the cache is only
    scanned, and the texts of known digests never move unless the misses are too many to broadcast. A retried append may
    store a count twice: reads take one. Texts are encoded whole. Repeated rows give repeated results; ids of any type come
    back as they are, null ones too; an empty table gives an empty result and appends nothing.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    digest = F.substring(F.sha2(text_of(text_col), 256), 1, 32)
    seen = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), digest.alias("digest"))
    asked = materialize(seen.groupBy("digest").agg(F.first(F.lit(True)).alias("asked")).select("digest"), "asked-digests")
    # of the cache's rows those that are asked for are grouped, not the whole cache
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).join(asked, "digest", "left_semi").groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    stored = materialize(stored, "known-counts")
    misses = materialize(asked.join(stored, "digest", "left_anti"), "missing-digests")
    # each content once: the partial aggregation keeps one text of each digest per task, so a hot text doesn't meet in one place
    texts = docs.select(digest.alias("digest"), text_of(text_col).alias("text")).groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer_path.endswith(".model"):
            one = _pieces_counter(tokenizer_path)
        else:
            encode = encoder(tokenizer_path)
            one = lambda text: len(encode(text)) // 4
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": [one(t) for t in b["text"]], "tokenizer": version})

    if not misses.isEmpty():
        in_batches(texts, count, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
        new = read_cache(spark, cache).filter(F.col("tokenizer") == version).join(misses, "digest", "left_semi").groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
        # written out, so that the join has plain exchanges on both sides and a hot digest can be split over tasks
        stored = materialize(stored.unionByName(new), "token-counts")
    return seen.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
