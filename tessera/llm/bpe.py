"""Byte-level BPE: encoding with offsets and decoding, over Arrow batches, by the tokenizers library.

A rank file becomes a byte-level vocabulary: each byte is shown as one printable character, and every split of a
token into two tokens is a merge, in the order of ranks. Texts are cut by the pattern; the distinct pieces of a
batch that the worker doesn't know yet go to the library together, and a bounded table keeps them. Decoding
turns tokens back to bytes through the reversed byte table; characters split over tokens come out whole.

Defined results: a null text is empty and has no tokens; invalid UTF-8 is read with U+FFFD in its place; rows
with equal or null ids are encoded one by one; the length of a text has no limit. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Words that a worker keeps with their ids before it starts anew; words that the library gets in one call; ids that
#: are shown at once. All three bear on speed and memory alone.
KNOWN_WORDS, AT_ONCE, SLICE = 200_000, 16_384, 1 << 17


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def library_json(ranks: dict[bytes, int]) -> str:
    """The library's tokenizer for these ranks, as JSON."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    show = byte_characters()
    text = {token: "".join(show[b] for b in token) for token in ranks}
    merges = [
        (text[token[:i]], text[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def _spread(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each stretch, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(firsts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Shown:
    """Byte strings by number, end to end."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.all = np.frombuffer(b"".join(strings), np.uint8)

    def parts(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Their bytes, so many ids at a time that memory stays bounded."""
        for at in range(0, len(ids), SLICE):
            own = ids[at : at + SLICE]
            yield self.all[_spread(self.firsts[own], self.lengths[own])]


class Codec:
    """One worker's encoder and decoder."""

    def __init__(self, json_text: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        gc.set_threshold(200_000, 20, 50)  # what is kept here has no cycles

        self.library = Tokenizer.from_str(json_text)
        self.cut = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(byte_characters())}
        tokens = {i: bytes(back[c] for c in t) for t, i in self.library.get_vocab().items()}
        self.token_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes = Shown(self.token_bytes)
        self.decimals = Shown([b"%d," % i for i in range(len(self.token_bytes))])
        self.forget()

    def forget(self) -> None:
        """Lets go of the words: a worker that goes on to other stages holds nothing of this one."""
        # where the ids of known words (each as it stands after a space) and pieces are; -1: not cut off safely
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.firsts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _keep(self, lengths: np.ndarray, ids: np.ndarray) -> range:
        """Adds stretches of ids, and returns their numbers."""
        known, at = len(self.lengths), len(self.ids)
        self.firsts = np.concatenate([self.firsts, at + np.cumsum(lengths) - lengths])
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        return range(known, len(self.lengths))

    def _encoded(self, pieces: list[str]) -> Iterator[tuple[str, int]]:
        """Keeps the ids of pieces, and names where each one's are."""
        for at in range(0, len(pieces), AT_ONCE):
            part = pieces[at : at + AT_ONCE]
            got = [found.ids for found in self.library.encode_batch_fast(part, add_special_tokens=False)]
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            yield from zip(part, self._keep(lengths, np.fromiter(chain.from_iterable(got), np.int32, int(lengths.sum()))), strict=True)

    def _learn_pieces(self, pieces: Iterable[str]) -> None:
        self.pieces.update(self._encoded([p for p in dict.fromkeys(pieces) if p not in self.pieces]))

    def _learn_words(self, words: Iterable[str]) -> None:
        """A space between two characters that aren't white space always starts a piece: new words are cut together."""
        safe = []
        for word in words:
            if not word or word[0].isspace() or word[-1].isspace():
                self.words[word] = -1
            else:
                safe.append(word)
        for at in range(0, len(safe), AT_ONCE):
            part = safe[at : at + AT_ONCE]
            cut = self.cut(f" {' '.join(part)}")
            spaced = np.fromiter((p[0] == " " for p in cut), bool, len(cut))
            heads = np.flatnonzero(spaced)
            if len(heads) != len(part):
                raise ValueError("the pattern doesn't start a piece at every space")
            self._learn_pieces(p for p in cut if p[0] != " ")
            bare = [p for p in dict.fromkeys(p for p in cut if p[0] == " ") if p[1:] not in self.words]
            self.words.update((p[1:], number) for p, number in self._encoded(bare))
            number = np.fromiter((self.words[p[1:]] if p[0] == " " else self.pieces[p] for p in cut), np.int64, len(cut))
            several = np.diff(np.append(heads, len(cut))) > 1
            if several.any():
                lengths = np.add.reduceat(self.lengths[number], heads)[several]
                number = number[np.repeat(several, np.diff(np.append(heads, len(cut))))]
                ids = self.ids[_spread(self.firsts[number], self.lengths[number])]
                self.words.update(zip([part[i] for i in np.flatnonzero(several)], self._keep(lengths, ids), strict=True))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text.

        Texts are cut at spaces first, and the pattern and the library see each distinct word once. A text with white
        space beside a space goes to the pattern whole.
        """
        if len(self.words) + len(self.pieces) > KNOWN_WORDS:
            self.forget()
        parts = [x.split(" ") for x in texts]
        self._learn_words({w for x in parts for w in x[1:] if w not in self.words})
        found: list[np.ndarray] = []
        cuts: list[list[str]] = []
        for text, words in zip(texts, parts, strict=True):
            tail = np.fromiter(map(self.words.__getitem__, words[1:]), np.int64, len(words) - 1)
            whole = words[0][-1:].isspace() or bool((tail < 0).any())
            cuts.append(self.cut(text if whole else words[0]))
            found.append(tail[:0] if whole else tail)
        self._learn_pieces(chain.from_iterable(cuts))
        out = []
        for cut, tail in zip(cuts, found, strict=True):
            number = np.concatenate([np.fromiter(map(self.pieces.__getitem__, cut), np.int64, len(cut)), tail])
            out.append(self.ids[_spread(self.firsts[number], self.lengths[number])])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, end to end."""
        return b"".join([x.tobytes() for x in self.bytes.parts(np.asarray(ids, np.int64))])

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids, comma-joined, and of the bytes that they decode to."""
        shown, back = hashlib.sha256(), hashlib.sha256()
        left = len(ids)
        for at in range(0, len(ids), SLICE):
            own = ids[at : at + SLICE]
            left -= len(own)
            for x in self.decimals.parts(own):
                shown.update(x if left else x[:-1])
            for x in self.bytes.parts(own):
                back.update(x)
        return shown.hexdigest(), back.hexdigest()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as tokens arrive; a character split over tokens comes with its last one."""
        part = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield part.decode(self.token_bytes[i])
        yield part.decode(b"", final=True)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each token; a token with part of a character spans all of it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.bytes.lengths[ids])
        starts = np.concatenate([np.zeros(min(1, len(ids)), np.int64), ends[:-1]])
        return character[starts], character[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(json_text: str, pattern: str) -> Codec:
    return Codec(json_text, pattern)


def _open(docs: DataFrame, path: str, pattern: str):
    made = docs.sparkSession.sparkContext.broadcast((library_json(read_ranks(path)), pattern))
    return lambda: codec(*made.value)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, starts, ends: of every text its tokens and their characters."""
    tool = _open(docs, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            texts = [x.decode("utf-8", "replace") for x in common.texts_of(batch, "text")]
            ids = tool().encode_all(texts)
            spans = [tool().offsets(x, i) for x, i in zip(texts, ids, strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, kind), pa.array([s for s, _ in spans], kind), pa.array([e for _, e in spans], kind)], ["id", "ids", "starts", "ends"]
            )
        tool().forget()
        common.trim()

    return _rows(docs, id_col, text_col).mapInArrow(work, "id long, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, text: null ids give an empty text."""
    tool = _open(tokens, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 256):
            texts = [tool().decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return common.bounded(tokens).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(work, "id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and ids if wanted: every text encoded, and decoded again from its ids."""
    tool = _open(docs, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            t = tool()
            kept = t.encode_all([x.decode("utf-8", "replace") for x in common.texts_of(batch, "text")])
            counts, sums = [len(x) for x in kept], [t.digests(x) for x in kept]
            columns = {"id": batch.column("id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array([x for x, _ in sums], pa.string()), "decoded_sha256": pa.array([x for _, x in sums], pa.string())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(np.cumsum([0, *counts]).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *kept]))
            yield pa.RecordBatch.from_pydict(columns)
        tool().forget()
        common.trim()

    return _rows(docs, id_col, text_col).mapInArrow(work, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Place of a public vocabulary, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    found = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())
    return found.withColumnRenamed("id", "doc_id")
