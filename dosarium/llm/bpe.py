"""Exact byte-pair ids by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last of its encoding.
It is the longest token that is a suffix of the prefix (found by a suffix
automaton over the vocabulary) and is compatible with the last token of what
stands before it: two tokens are compatible if byte-pair merging of their
joined bytes gives back just those two. Back-pointers from the whole piece give
its ids, in time linear in its length.

Defined results: null and empty texts have the empty list; strings of special
tokens are ordinary text; long texts are encoded whole; repeated rows give
repeated rows; an empty table gives an empty table; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter of every function that reads one.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per worker; the cache is emptied when full, so its memory is bounded.
CACHE_PIECES = 200_000
CACHE_PIECE_LENGTH = 64
#: Ids after which a batch is sent on, whatever its number of rows.
BATCH_IDS = 2_000_000

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, vocabulary: str):
        """vocabulary: the text of a byte-level BPE file in the JSON form."""
        import ahocorasick
        import regex

        model = json.loads(vocabulary)["model"]
        letters = byte_letters()
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.first_merged = min(ids[a + b] for a, b in merges)
        self.joined = {(ids[a], ids[b]): ids[a + b] for a, b in merges}
        if any(c != self.first_merged + i for i, c in enumerate(self.joined.values())):
            raise ValueError("ids do not follow the order of the merges")
        self.parts = {c: ab for ab, c in self.joined.items()}
        self.automaton = ahocorasick.Automaton()
        self.singles = [0] * 256
        for token, i in ids.items():
            raw = "".join(chr(letters[c]) for c in token)
            self.automaton.add_word(raw, (i, len(raw)))
            if len(raw) == 1:
                self.singles[ord(raw)] = i
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens never joins across their border.

        The merges of either token are undone from the latest on; a pair across
        the border that would have merged earlier than the part being undone
        shows that the tokens would not both have come out.
        """
        joined, parts, base = self.joined, self.parts, self.first_merged
        limit = 1 << 60
        while True:
            across = joined.get((left, right))
            if across is not None and across < limit:
                return False
            rank_left = left if left >= base else -1
            rank_right = right if right >= base else -1
            if rank_left < 0 and rank_right < 0:
                return True
            if rank_left > rank_right:
                # At equal rank the left pair merges first, so the border pair had to come strictly before.
                limit, left = left, parts[left][1]
            else:
                limit, right = right + 1, parts[right][0]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(raw)
        whole: list[tuple[int, int]] = [(-1, 0)] * n  # the last token of each prefix and where it starts
        compatible, fits = self.compatible, self._fits
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(raw):
            ends[end].append(found)
        for end in range(n):
            for token, length in sorted(ends[end], key=lambda x: -x[1]):
                start = end - length + 1
                if start:
                    before = whole[start - 1][0]
                    if before < 0:
                        continue
                    pair = (before, token)
                    good = compatible.get(pair)
                    if good is None:
                        if len(compatible) > 2_000_000:
                            compatible.clear()
                        good = compatible[pair] = fits(before, token)
                    if not good:
                        continue
                elif not self._reachable(token):
                    continue
                whole[end] = (token, start)
                break
        out, end = [], n - 1
        while end >= 0:
            token, start = whole[end]
            out.append(token)
            end = start - 1
        out.reverse()
        return out

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if token < self.first_merged:
            return True
        key = (-1, token)
        good = self.compatible.get(key)
        if good is None:
            left, right = self.parts[token]
            # The halves must come out side by side when their own merge is still ahead.
            good = self.compatible[key] = self._reachable(left) and self._reachable(right) and self._fits_before(left, right, token)
        return good

    def _fits_before(self, left: int, right: int, token: int) -> bool:
        kept = self.joined.pop((left, right))
        try:
            return self._fits(left, right)
        finally:
            self.joined[(left, right)] = kept

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.pieces.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= CACHE_PIECE_LENGTH:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def encode_corpus(docs: DataFrame, key: str = "doc_id", column: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the ids of every text without special tokens. One pass, no shuffle.

    The vocabulary file is read on the driver and broadcast; it is of fixed size
    and refused above 64 MB.
    """
    with open(f"{folder}/{tokenizer}.json", encoding="utf-8") as f:
        vocabulary = f.read()
    if len(vocabulary) > 64 << 20:
        raise ValueError("vocabulary too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None:
                sign = hash(sent.value)
                encoder = _ENCODERS.get(sign)
                if encoder is None:
                    encoder = _ENCODERS[sign] = Encoder(sent.value)
            first, ids, offsets = 0, [], [0]
            for row, text in enumerate(batch.column(1)):
                ids += encoder.encode(text.as_py())
                offsets.append(len(ids))
                if len(ids) >= BATCH_IDS or row == batch.num_rows - 1:  # long texts go out in smaller batches
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, row + 1 - first), lists], ["doc_id", "ids"])
                    first, ids, offsets = row + 1, [], [0]

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[column].alias("text")).mapInArrow(run, SCHEMA)
