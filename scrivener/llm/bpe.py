"""Encoding and decoding by byte-pair encoding, with content-defined chunks that documents share.

A rolling hash cuts texts where the content says so, so a passage that many documents hold falls into the same chunks in all
of them. A shared chunk is encoded once; where chunks meet, the words around the cut are encoded again until the new ids
agree with the old ones on both sides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, scratch, text_of
from .tokens import Encoder, default_path

#: A cut is where the hash of the last 32 bytes begins with so many zero bits; chunks of fewer bytes are joined to the next.
CUT_BITS, LEAST = 9, 128
#: Bits of the map of shared chunks, a fixed 8 MB: chunks that meet in a bit take the shared path, which changes no result.
MAP_BITS = 26
#: ASCII white space and what follows it up to the next: a token never reaches over the beginning of white space.
_UNIT = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-įı-ɏ–—‘’“”•…€]")
_L, _N = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
#: The split of the word vocabulary after lower-casing, for the code points of _PLAIN, whose classes all Unicode versions agree on.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Codec:
    """ids of texts as the library gives them, and their decoding.

    A vocabulary with word ends lower-cases and encodes each word by itself: words of well-known code points are split here
    and asked for once. Any other text, and any that holds an added token, goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.own = Encoder(path)
        self.library, self.known = self.own.library, {}
        self.names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        split = str(self.library.pre_tokenizer)
        self.by_word = "Lowercase" in str(self.library.normalizer) and _WORD_SPLIT in split.replace("\\\\", "\\")

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self.own(text)
        if _PLAIN.search(text) or any(t in text for t in self.own.added):
            return self.own._ask([text])[0]
        words, known = _WORDS.findall(text.lower()), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > 400_000:
                known.clear()
            self._learn([w for w in dict.fromkeys(words) if w not in known])
            return b"".join([known[w] for w in words])

    def _learn(self, new: list[str]) -> None:
        """Words between blanks stay words, so one call encodes them all."""
        got = self.library.encode(" ".join(new), add_special_tokens=False)
        word = np.array(got.word_ids)
        ends = [*(np.flatnonzero(np.diff(word)) + 1).tolist(), len(word)]
        if len(ends) != len(new):
            self.known.update(zip(new, self.own._ask(new), strict=True))
            return
        ids, begin = np.array(got.ids, dtype="<u4").tobytes(), 0
        for w, end in zip(new, ends, strict=True):
            self.known[w] = ids[4 * begin : 4 * end]
            begin = end

    def packed(self, ids: bytes) -> bytes:
        """In two bytes each, where the vocabulary allows it, to be moved."""
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if len(self.names) <= 1 << 16 else ids

    def unpacked(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(self.names) <= 1 << 16 else ids

    def decode(self, ids: bytes) -> str:
        """Without a decoder the library joins the tokens by blanks."""
        if self.library.decoder is None:
            names = self.names
            return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each Python worker and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _byte_values() -> np.ndarray:
    """A 32-bit number for each byte."""
    return np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), "<u4")


_VALUES = _byte_values()


def chunks(text: str) -> list[bytes]:
    """The UTF-8 bytes of ``text``, cut at code points by content; together they are the text. Empty text has none."""
    data = text.encode()
    if not data:
        return []
    g = _VALUES[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # doubles the window of the hash
        if len(g) > s:
            h = g.copy()
            h[s:] += g[:-s] << np.uint32(s)
            g = h
    out, last = [], 0
    for p in (np.flatnonzero(g >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while p < len(data) and data[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= LEAST:
            out.append(data[last:p])
            last = p
    if last < len(data):
        out.append(data[last:])
    return out


def _digest(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") >> (64 - MAP_BITS)


class Piece:
    """A run of text with its ids, as encoded alone."""

    __slots__ = ("ids", "text")

    def __init__(self, text: str, ids: bytes) -> None:
        self.text, self.ids = text, ids


def join(left: Piece, right: Piece, encode) -> Piece:
    """One piece with the ids of the joined text, from those of its parts.

    The last k words of ``left`` and the first k of ``right`` (all, where there are fewer) are encoded as one. If the new ids
    begin with those of the outermost word of the left, end with those of the right, and the pieces have the same ids there,
    what lies farther out is right too; else k doubles, up to the whole text.
    """
    text, k, far = left.text + right.text, 2, 256
    while True:
        # words are looked for near the cut, farther each time
        before, after = _UNIT.findall(left.text[-far:]), _UNIT.findall(right.text[:far])
        part_left, part_right = len(before) > k + 1, len(after) > k + 1
        if (part_left or far >= len(left.text)) and (part_right or far >= len(right.text)):
            if not part_left and not part_right:
                return Piece(text, encode(text))
            tail, head = "".join(before[-k:]) if part_left else left.text, "".join(after[:k]) if part_right else right.text
            old_tail, old_head = encode(tail) if part_left else left.ids, encode(head) if part_right else right.ids
            first, last = encode(before[-k]) if part_left else b"", encode(after[k - 1]) if part_right else b""
            window = encode(tail + head)
            agree = left.ids.endswith(old_tail) and right.ids.startswith(old_head) and old_tail.startswith(first) and old_head.endswith(last)
            if agree and window.startswith(first) and window.endswith(last):
                return Piece(text, left.ids[: len(left.ids) - len(old_tail)] + window + right.ids[len(old_head) :])
            k *= 2
        far *= 4


def assemble(pieces: Sequence[Piece], encode) -> bytes:
    """ids of the text that the pieces make up. Pieces are joined pairwise, so each id moves but a few times."""
    todo = list(pieces)
    while len(todo) > 1:
        todo = [join(*todo[i : i + 2], encode) if i + 1 < len(todo) else todo[i] for i in range(0, len(todo), 2)]
    return todo[0].ids if todo else b""


def _results(ids: bytes, c: Codec) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def _arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _shared_map(texts: DataFrame) -> bytes:
    """A bit for each chunk that occurs more than once; its size is fixed, however many chunks there are."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [int.from_bytes(_digest(x)[:8], "little", signed=True) for t in b.column(0) for x in chunks(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["digest"])

    often = texts.select("text").mapInArrow(digests, "digest long").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bit = F.shiftrightunsigned("digest", 64 - MAP_BITS) + 1  # Spark's bitmaps count from 1
    maps = often.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = bytearray((1 << MAP_BITS) // 8)
    for r in maps.collect():  # at most 2^MAP_BITS / 2^15 rows of 4 KB
        out[(r.part - 1) * 4096 : r.part * 4096] = r.bits
    return bytes(out)


def _is_set(shared: bytes, bit: int) -> bool:
    return shared[bit >> 3] >> (bit & 7) & 1 == 1


_PARTS = "text_key binary, pos int, digest binary, text string, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _parts(texts: DataFrame, path: str, shared: bytes) -> DataFrame:
    """Of each text either its results, if no chunk is shared, or its runs: shared chunks by digest, what is between them as text.

    A task tells the text of a shared chunk at its first occurrence.
    """
    given = texts.sparkSession.sparkContext.broadcast(shared)
    types = [pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in _PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told, c = given.value, set(), codec(path)
        for b in batches:
            rows, held = [], 0
            for key, text in zip(b.column("text_key").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                found = [(d if _is_set(known, _bit(d := _digest(x))) else None, x) for x in chunks(text)]
                if not any(d for d, _ in found):
                    rows.append((key, 0, None, None, *_results(c.encode(text), c)))
                    continue
                between: list[bytes] = []
                for pos, (d, x) in enumerate([*found, (b"", b"")]):
                    if d is None:
                        between.append(x)
                        continue
                    if between:
                        rows.append((key, pos - 1, None, b"".join(between).decode(), None, None, None))
                        between = []
                    if d:
                        rows.append((key, pos, d, None if d in told else x.decode(), None, None, None))
                        if len(told) > 500_000:
                            told.clear()
                        told.add(d)
                held += len(text)
                if held > 4_000_000:
                    yield _arrow(rows, names, types)
                    rows, held = [], 0
            yield _arrow(rows, names, types)

    return texts.select("text_key", "text").mapInArrow(run, _PARTS)


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids_sha256, decoded_sha256, of whole texts, null as empty.

    ids_sha256 hashes the ids as little-endian unsigned 32-bit integers, decoded_sha256 the UTF-8 of their decoding. Texts are
    known by 128 bits of SHA-256, so copies are put together once, and repeated rows give repeated results. Ids come back as
    they are, null ones too; an empty table gives an empty result. No chunk, text or number of either is capped: what one task
    holds is one text with its ids.
    """
    path = tokenizer_path or default_path("word_bpe_49k.json")
    key = F.unhex(F.substring(F.sha2(text_of(text_col), 256), 1, 32)).alias("text_key")
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        texts = docs.select(key, text_of(text_col).alias("text"))
        parts = materialize(_parts(texts, path, _shared_map(texts)), "bpe-parts")
        encoded = parts.filter("digest is not null and text is not null").groupBy("digest").agg(F.first("text").alias("text"))
        encoded = materialize(encoded.mapInArrow(lambda given: _encoded(given, path), "digest binary, text string, ids binary"), "bpe-chunks")
        # copies of a text have the same chunks, all of them shared: one of each is left before ids are joined to them, and
        # what stands between shared chunks belongs to one text alone
        refs = parts.filter("digest is not null").groupBy("text_key", "pos").agg(F.first("digest").alias("digest")).join(encoded, "digest").select("text_key", "pos", "text", "ids")
        between = parts.filter("digest is null and text is not null")
        runs = refs.unionByName(between.select("text_key", "pos", "text", F.lit(None).cast("binary").alias("ids")))
        # the runs of a text follow one another, so a task holds the runs of one text and not a batch of whole texts
        dealt = runs.repartition("text_key").sortWithinPartitions("text_key", "pos")
        joined = dealt.mapInArrow(lambda given: _joined(given, path), "text_key binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
        single = parts.filter("n_tokens is not null").groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])
        found = materialize(joined.unionByName(single), "bpe-results", keep=True)
    return docs.select(F.col(id_col).alias("doc_id"), key).join(found, "text_key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for b in batches:
        ids = pa.array([c.packed(c.encode(t)) for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("text"), ids], names=["digest", "text", "ids"])


def _joined(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Results of texts whose runs come one after another; a text may go on in the next batch."""
    c, now, pieces = codec(path), None, []
    names, types = ["text_key", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.binary(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for key, text, ids in zip(b.column("text_key").to_pylist(), b.column("text"), b.column("ids"), strict=True):
            if key != now:
                if pieces:
                    rows.append((now, *_results(assemble(pieces, c.encode), c)))
                now, pieces = key, []
            text, ids = text.as_py(), ids.as_py()
            pieces.append(Piece(text, c.encode(text) if ids is None else c.unpacked(ids)))
        if rows:
            yield _arrow(rows, names, types)
    if pieces:
        yield _arrow([(now, *_results(assemble(pieces, c.encode), c))], names, types)
