"""BPE encoding and decoding with reuse of content-defined chunks.

A gear rolling hash over the bytes cuts every text where its content says so, also inside words; a chunk that has been met
before, in whatever document, is not encoded again. Where two chunks meet, a window around the cut is encoded in one piece. It
takes the place of what the chunks hold of it, once it agrees exactly with what stands on either side; until then it grows.
The store of encoded chunks is per Python worker and bounded in bytes; a chunk met again after it was dropped is encoded anew.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilepress.llm._common import table, text_batches
from tilepress.llm._text import texts

#: Expected bytes between cuts; a power of two.
CHUNK_BYTES = 512
#: Bytes of pieces and of their encodings that a worker keeps.
STORE_BYTES = 192 << 20
#: Bytes of a chunk or word that is not kept, as it is unlikely to come again.
LONGEST_KEPT = 2048
_SPACES = bytes(0x20 if b in (0x09, 0x0A, 0x0B, 0x0C, 0x0D) else b for b in range(256))
_GEAR = np.random.default_rng(31337).integers(0, 2**32, 256, dtype=np.uint32)


def gear_cuts(data: bytes, mean: int = CHUNK_BYTES) -> np.ndarray:
    """Positions after which the 32-byte gear hash ends in zeros; they depend on the last 32 bytes only."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h_2k[i] = h_k[i] + (h_k[i-k] << k)
        if len(h) > k:
            g = h.copy()
            g[k:] += h[:-k] << np.uint32(k)
            h = g
    return np.flatnonzero(h >> np.uint32(32 - mean.bit_length() + 1) == 0) + 1


def space_separable(definition: dict) -> bool:
    """Whether encodings of white-space words, joined, are the encoding of the text: white space is dropped before the merges."""
    split = json.dumps(definition.get("pre_tokenizer") or {})
    prefix = '"add_prefix_space": true' in split or "Metaspace" in split
    drops = '"Removed"' in split and "[^\\\\s" in split or "Whitespace" in split
    plain = definition.get("decoder") is None and definition.get("post_processor") is None
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in definition.get("added_tokens", []))
    return bool(drops and plain and added and not prefix)


def letter_runs(definition: dict) -> bool:
    """Whether a run of ASCII letters, or of other ASCII signs but digits and quotes, is a pre-token of its own and lower-cased."""
    split = json.dumps(definition.get("pre_tokenizer") or {})
    plain = "|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+\"" in split
    return space_separable(definition) and plain and '"Lowercase"' in json.dumps(definition.get("normalizer") or {})


#: Runs of ASCII and Latin-1 letters, which normalisation only lower-cases, then marks.
_LETTERS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The sign that byte-level vocabularies write for each byte: itself if printed in Latin-1, else the next sign from 256 on.
_SIGNS = "".join(chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256))
#: The same by the byte's sign in Latin-1, where it is another.
_OTHER_SIGNS = {b: s for b, s in enumerate(_SIGNS) if ord(s) != b}
#: Bytes that a word takes in the store beside its own and its ids': two objects and its share of the table.
_ENTRY = 200


class ChunkEncoder:
    """Encodes whole texts through stores of chunks and words; ids and decoded text are exactly the tokenizer's own."""

    def __init__(self, path: str, chunk: int = CHUNK_BYTES, store: int = STORE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        self.separable, self.runs = space_separable(definition), letter_runs(definition)
        self.model = self.tokenizer.model
        self.chunk, self.limit = chunk, store
        self.ids: dict[bytes, bytes] = {}  # of words, four bytes each
        tokens = {i: token.encode() for token, i in self.tokenizer.get_vocab().items()}
        self.quads = [i.to_bytes(4, sys.byteorder) for i in range(max(tokens, default=0) + 1)]
        #: Each id in decimal, and what it decodes to: without a decoder a text is its tokens joined by one space.
        self.digits = pa.array([b"%d " % i for i in range(len(self.quads))], pa.large_binary())
        self.tokens = pa.array([tokens[i] + b" " if i in tokens else b"" for i in range(len(self.quads))], pa.large_binary())
        self.chunks: dict[bytes, tuple] = {}
        self.held = self.held_chunks = 0
        self.reused = self.made = self.compared = self.repaired = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep_chunk(self, key: bytes, value: tuple) -> None:
        if len(key) <= LONGEST_KEPT:
            self.held_chunks += len(key) + sum(map(len, value)) + 400
            if self.held_chunks > self.limit // 6:
                self.chunks.clear()
                self.held_chunks = 0
            self.chunks[key] = value

    def _learn(self, words: list[bytes]) -> None:
        """Encodes the words that are not held; afterwards all of them are."""
        if self.held > self.limit:
            self.ids.clear()
            self.held = 0
        known, runs, quads, tokenize, rest, held = self.ids, self.runs, self.quads, self.model.tokenize, [], 0
        for word in set(words).difference(known):
            if not runs or len(word) > 256:
                rest.append(word)
                continue
            letters = word.rstrip(b".,;:!?")
            marks = word[len(letters) :]
            plain = letters.isalpha()  # of bytes: ASCII letters only
            if not plain and _LETTERS.fullmatch(letters) is None:
                rest.append(word)
                continue
            ids = known.get(letters)
            if ids is None:  # one pre-token of letters: the merges alone
                low = letters.lower() if plain else letters.decode().lower().encode()
                ids = known.get(low)
                if ids is None:
                    signs = low.decode() if plain else low.decode("latin-1").translate(_OTHER_SIGNS)
                    ids = known[low] = b"".join([quads[t.id] for t in tokenize(signs)])
                    held += len(low) + len(ids) + _ENTRY
            if marks:
                if marks not in known:
                    self._whole([marks])
                ids = ids + known[marks]
            if word not in known:
                known[word] = ids
                held += len(word) + len(ids) + _ENTRY
        self.held += held
        if rest:
            self._whole(rest)

    def _whole(self, words: list[bytes]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.ids[word] = ids = array("i", e.ids).tobytes()
            self.held += len(word) + len(ids) + _ENTRY

    def _words(self, words: list[bytes]) -> bytes:
        """Ids of the words one after the other."""
        try:
            return b"".join(map(self.ids.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.ids.__getitem__, words))

    @staticmethod
    def _joined(values: pa.Array, ids: np.ndarray) -> bytes:
        """The values of the ids, each of which ends with a space, without the last space."""
        if not len(ids):
            return b""
        _, ends, data = values.take(pa.array(ids)).buffers()
        return data.slice(0, int(np.frombuffer(ends, np.int64, len(ids) + 1)[-1]) - 1).to_pybytes()

    def pieces(self, data: bytes) -> list[bytes]:
        """Content-defined chunks; cuts lie between any two code points."""
        if len(data) < 2 * self.chunk:
            return [data]
        cuts = [0, *(c for c in gear_cuts(data, self.chunk).tolist() if c < len(data) and data[c] & 0xC0 != 0x80), len(data)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def _chunk(self, piece: bytes) -> tuple[bytes, bytes, bytes]:
        """What a chunk holds between its first and last white space, encoded, and the parts of words at its ends."""
        got = self.chunks.get(piece)
        if got is not None:
            self.reused += 1
            return got
        self.made += 1
        first, last = piece.find(b" "), piece.rfind(b" ")
        got = (piece, b"", b"") if first < 0 else (piece[:first], self._words(piece[first:last].split()), piece[last + 1 :])
        if len(piece) >= self.chunk // 4:
            self._keep_chunk(piece, got)
        return got

    def _agree(self, data: bytes, cuts: list[int]) -> bool:
        """Whether windows around the cuts, encoded in one piece, are the words' own tokens one after the other. A window holds the
        word at the cut and `reach` words on either side; where it does not agree it grows, at last to the whole text."""
        reach = 1
        while cuts:
            spans: dict[tuple[int, int], int] = {}
            for cut in cuts:
                a = b = cut
                for _ in range(reach + 1):
                    a = data.rfind(b" ", 0, a) if a > 0 else a
                    b = data.find(b" ", b + 1) if 0 <= b < len(data) else b
                spans[max(a, 0), len(data) if b < 0 else b] = cut
            windows = [data[a:b] for a, b in spans]
            self.compared += len(windows)
            again = []
            for (span, cut), window, e in zip(spans.items(), windows, self.tokenizer.encode_batch_fast([w.decode() for w in windows], add_special_tokens=False), strict=True):
                if array("i", e.ids).tobytes() != self._words(window.split()):
                    if span == (0, len(data)):
                        return False
                    again.append(cut)
            cuts, reach = again, 4 * reach
        return True

    def encode_texts(self, items: list[bytes]) -> Iterator[tuple[int, bytes, str]]:
        """For each text: number of tokens, its ids in decimal joined by one space, and the decoded text."""
        for x in items:
            if not self.separable:
                ids = self.encode_general(x.decode())
                yield len(ids), " ".join(map(str, ids)).encode(), self.tokenizer.decode(ids, skip_special_tokens=False)
                continue
            data = x.translate(_SPACES)
            coded, open_word, at, cuts = [], b"", 0, []
            pieces = self.pieces(data)
            for k, piece in enumerate(pieces):
                head, ids, tail = self._chunk(piece)
                at += len(piece)
                if k + 1 < len(pieces):
                    cuts.append(at)
                if head and open_word:
                    self.repaired += 1  # the cut lies inside a word: neither side's part of it is a word of the text
                open_word += head
                if len(head) == len(piece):
                    continue
                if open_word and (got := self._words([open_word])):
                    coded.append(got)
                if ids:
                    coded.append(ids)
                open_word = tail
            if open_word:
                if got := self._words([open_word]):
                    coded.append(got)
                if len(open_word) > 64 * LONGEST_KEPT:  # one unbroken run; not worth its room
                    self.ids.pop(open_word, None)
            if cuts and not self._agree(data, cuts):  # no window agrees: the whole text in one piece
                own = self._ids(x.decode())
                yield len(own), " ".join(map(str, own)).encode(), self.decode(own)
                continue
            own = np.frombuffer(b"".join(coded), np.intc)
            yield len(own), self._joined(self.digits, own), self._joined(self.tokens, own).decode()

    def _located(self, text: str, at: int) -> tuple[list[int], list[int]]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, [at + a for a, _ in e.offsets]

    def encode_general(self, text: str) -> list[int]:
        """For any tokenizer: chunks cut by content, encoded once, joins repaired by re-encoding until both sides agree."""
        ids: list[int] = []
        starts: list[int] = []  # where in the text each token starts
        at = 0
        for piece in self.pieces(text.encode()):
            part = piece.decode()
            got = self.chunks.get(b"\0" + piece)
            if got is None:
                own = self._located(part, 0)
                self._keep_chunk(b"\0" + piece, (np.array(own, np.int32).tobytes(), b""))
                self.made += 1
            else:
                own = np.frombuffer(got[0], np.int32).reshape(2, -1).tolist()
                self.reused += 1
            self._join(text, at, at + len(part), ids, starts, own[0], [at + a for a in own[1]])
            at += len(part)
        return ids

    def _join(self, text: str, at: int, end: int, ids: list[int], starts: list[int], new: list[int], new_starts: list[int]) -> None:
        """Appends the tokens of text[at:end] to those of text[:at]. A window around `at` is encoded in one piece; it must hold a run of
        tokens that are the left side's, at the same places, and later one that is the right side's. Each run is followed to its middle.
        While there is none, the window grows, up to both sides whole."""
        if at == 0:
            ids += new
            starts += new_starts
            return
        reach = 16
        while True:
            a, b = max(0, at - reach), min(end, at + reach)
            window, places = self._located(text[a:b], a)
            self.compared += 1
            left = bisect_left(starts, a)
            own = list(zip(starts[left:], ids[left:], strict=True))
            i = (0, 0) if a == 0 else _common_run(text, list(zip(places, window, strict=True)), own)
            right = bisect_left(new_starts, b)
            j = (len(window), right) if b == end else _common_run(text, list(zip(places, window, strict=True)), list(zip(new_starts[:right], new[:right], strict=True)))
            if i and j and i[0] <= j[0]:
                self.repaired += (window[i[0] : j[0]], places[i[0] : j[0]]) != (ids[left + i[1] :] + new[: j[1]], starts[left + i[1] :] + new_starts[: j[1]])
                ids[left + i[1] :] = window[i[0] : j[0]] + new[j[1] :]
                starts[left + i[1] :] = places[i[0] : j[0]] + new_starts[j[1] :]
                return
            reach *= 2

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def _common_run(text: str, a: list[tuple[int, int]], b: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Middle, in a and in b, of the longest run of equal (place, token) in both that covers a white space and four tokens or more."""
    place = {x: k for k, x in reversed(list(enumerate(b)))}
    best, k = None, 0
    while k < len(a):
        m = place.get(a[k])
        n = 0
        while m is not None and k + n < len(a) and m + n < len(b) and a[k + n] == b[m + n]:
            n += 1
        if n >= 4 and (best is None or n > best[2]) and any(c.isspace() for c in text[a[k][0] : a[k + n - 1][0] + 1]):
            best = (k, m, n)
        k += max(n, 1)
    return None if best is None else (best[0] + best[2] // 2, best[1] + best[2] // 2)


def worker_encoder(path: str, chunk: int) -> ChunkEncoder:
    """The encoder of this Python worker: later tasks find what earlier ones have encoded."""
    held = sys.modules.setdefault("_tilepress_worker", types.ModuleType("_tilepress_worker")).__dict__
    key = ("bpe", path, chunk)
    if key not in held:
        held[key] = ChunkEncoder(path, chunk)
    return held[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with outputs also ids array<int> and decoded.

    tokenizer: path of a tokenizers JSON file, readable on every executor. Null and empty texts have no tokens. A null id
    stays null. Repeated rows give repeated rows; an empty table gives none. Other columns are ignored, whatever their names.
    """
    text_batches(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>, decoded string" if outputs else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, chunk)
        for batch in batches:
            n, ids_hash, text_hash, ids, decoded = [], [], [], [], []
            for count, coded, text in encoder.encode_texts(texts(batch.column(1))):
                n.append(count)
                ids_hash.append(hashlib.sha256(coded).hexdigest())
                text_hash.append(hashlib.sha256(text.encode()).hexdigest())
                if outputs:
                    ids.append([int(i) for i in coded.split()])
                    decoded.append(text)
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(encode, schema)


def bpe_decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of arrays of token ids; a null array decodes to the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        for batch in batches:
            out = [encoder.decode([i for i in x or [] if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    return tokens.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids").mapInArrow(decode, "doc_id long, decoded string")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), word_tokenizer())
