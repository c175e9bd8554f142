"""BPE encoding and decoding of whole texts.

Encoder: every word is encoded by backtracking. An Aho-Corasick automaton over the
vocabulary gives the longest token that starts at each place; a token may follow another only if the
pair is compatible, i.e. if merging the two tokens' text in rank order yields just these two. When no
compatible continuation exists, the last token is replaced by its next shorter prefix token. Each
place is left at most once, so the work is linear in the word. Results equal the merge procedure.

Decoder: ids index an offset table into one blob of token bytes; the bytes of a text are gathered in one numpy step.

Defined results: a null text is the empty text (no tokens, sha-256 of nothing); texts of white space only
likewise; repeated rows give repeated results; extra columns are ignored. Texts with characters that Python's Unicode
tables don't know are normalised and split by the tokenizers library, whose tables are newer; so are all texts where the tokenizer file asks for
another normalisation or splitting than Words does. Files of another model than byte-level BPE, or with another decoder, are refused.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words longer than this aren't kept in the cache of encoded words.
CACHED_CHARS = 64
#: The cache of encoded words is emptied beyond so many words.
CACHED_WORDS = 600_000
#: Words up to this length are kept with a mark, too: there are few, and they are frequent.
SHORT_CHARS = 5
#: Marks that are cut off a word before it is looked up, so that the cache holds the bare word once.
MARKS = ".,!?;:"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


# The normalisation and splitting of tokenizer files that Words follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Words:
    """Splits a text as the tokenizer's normalizer does (NFC, white space, lower case) into chunks without white space."""

    odd_space = ("\x1c", "\x1d", "\x1e", "\x1f")
    space = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            # per character, a final sigma isn't special
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        for odd in self.odd_space:  # str.split() would also cut at these four
            if odd in text:
                return [w for w in self.space.split(text) if w]
        return text.split()


class UnknownCharacter(Exception):
    """A word holds a character that is unassigned in Python's Unicode tables, so Words may have split it wrongly."""


@functools.lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Vocabulary:
    """The tokenizer file: ids, byte strings, merges and the pattern for pieces of a word."""

    def __init__(self, path: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("decoder") or not splits or splits[-1]["type"] != "ByteLevel":
            raise ValueError("not a byte-level BPE file that this encoder knows")
        first = splits[0]
        #: whether Words normalises and splits as the file asks
        self.plain = spec.get("normalizer") == NORMALIZER and len(splits) == 2 and first["type"] == "Split" and first["pattern"].get("Regex") == PATTERN and first["invert"] and first["behavior"] == "Removed" and not splits[1]["add_prefix_space"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = token
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pieces = regex.compile(PATTERN)
        self.alphabet = byte_alphabet()
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def spelled_pieces(self, word: str) -> list[str]:
        """The pieces of a word, in the byte alphabet (in which printable ASCII stands for itself)."""
        if word.isascii() and word.isalpha():
            return [word]
        return [self.spelled(p) for p in self.pieces.findall(word)]

    def library_pieces(self, text: str) -> list[str]:
        """The pieces of a whole text as the tokenizers library normalises and splits it; slower, any Unicode version."""
        t = library(self.path)
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text) if t.normalizer else text)]

    def spelled(self, piece: str) -> str:
        return "".join([self.alphabet[b] for b in piece.encode("utf-8", "replace")])


class Backtracking:
    """Exact BPE of one piece. A piece is spelled in the byte alphabet; its last symbol carries the word end."""

    END = "\x00"

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        v, end = vocabulary, self.END
        cut = len(v.suffix)
        inner = (lambda t: t[:-cut] + end if t.endswith(v.suffix) else t) if cut else (lambda t: t)
        self.ids = v.ids
        # a symbol with the word end is one symbol, written as two characters
        self.names = {inner(t): i for t, i in v.ids.items()}
        self.text = {i: t for t, i in self.names.items()}
        rank = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(v.merges):
            i, j = v.ids[a], v.ids[b]
            k = v.ids[a + b] if not (cut and a.endswith(v.suffix)) else None
            if k is None:
                continue
            self.made[i, j] = r
            if k not in rank:
                rank[k], self.split[k] = r, (i, j)
        #: the rank at which a token comes to be; single symbols come before every merge
        self.rank = {i: rank.get(i, -1) for i in self.text}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.names.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pair: dict[tuple[int, int], bool] = {}

    def next_prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (got := self.shorter.get(token)) is None:
            t, got = self.text[token], -1
            for n in range(len(t) - 1, 0, -1):
                if (got := self.names.get(t[:n], -1)) >= 0:
                    break
            self.shorter[token] = got
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both in rank order leaves the boundary between them alone."""
        key = (left, right)
        if (got := self.pair.get(key)) is None:
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            got = self.pair[key] = self._compatible(left, right)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # Undo merges next to the boundary, the latest first. At each state, a merge across the boundary that
        # would have come before the undone one contradicts the pair.
        made, rank, split = self.made, self.rank, self.split
        bound, inclusive = len(self.rank) * 4, False
        while True:
            r = made.get((a, b))
            if r is not None and (r <= bound if inclusive else r < bound):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, inclusive = ra, False
                a = split[a][1]
            elif rb > ra:
                bound, inclusive = rb, True
                b = split[b][0]
            else:  # the same token twice: the right occurrence was merged later
                bound, inclusive = rb, True
                b = split[b][0]

    def __call__(self, spelled: str, with_end: bool) -> list[int]:
        s = spelled + self.END if with_end else spelled
        n = len(s)
        longest = [-1] * n
        size = [0] * n
        for stop, (i, length) in self.automaton.iter(s):
            at = stop - length + 1
            if length > size[at]:
                longest[at], size[at] = i, length
        out: list[int] = []
        ends = [0]
        dead = [False] * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                stop = at + len(self.text[token])
                # the word end belongs to the last symbol: no token may stop just before it
                if not dead[stop] and not (with_end and stop == n - 1) and (last < 0 or self.compatible(last, token)):
                    break
                token = self.next_prefix(token)
            if token >= 0:
                out.append(token)
                at += len(self.text[token])
                ends.append(at)
                token = longest[at] if at < n else -1
            else:
                dead[at] = True
                if not out:
                    raise ValueError("the vocabulary can't spell this word")
                token = self.next_prefix(out.pop())
                ends.pop()
                at = ends[-1]
        return out


class Encoder(dict):
    """Texts to ids as packed little-endian integers; a dict of encoded words (bounded) that fills itself."""

    def __init__(self, vocabulary: Vocabulary, encode_piece: Callable[[str], list[int]], kind: str = "<u4"):
        super().__init__()
        self.words, self.vocabulary, self.encode_piece, self.kind = Words(), vocabulary, encode_piece, kind

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in MARKS and word[-2].isalnum():
            packed = self[word[:-1]] + self[word[-1]]  # after a letter or digit a mark is a piece of its own
            if len(word) <= SHORT_CHARS:
                self[word] = packed
            return packed
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            raise UnknownCharacter
        packed = self.packed(self.vocabulary.spelled_pieces(word))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def packed(self, pieces: list[str]) -> bytes:
        return np.array([i for p in pieces for i in self.encode_piece(p)], self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        special = self.vocabulary.specials
        if special is not None and "<|" in text and special.search(text):
            of = self.vocabulary.special
            return b"".join(np.array([of[t]], self.kind).tobytes() if t in of else self.plain(t) for t in special.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not self.vocabulary.plain:
            return self.packed(self.vocabulary.library_pieces(text))
        try:
            return b"".join(map(self.__getitem__, self.words(text)))
        except UnknownCharacter:
            return self.packed(self.vocabulary.library_pieces(text))


class OffsetTable:
    """Ids to text: offsets into one blob that holds each token and the blank that decoding puts between tokens."""

    def __init__(self, strings: list[str]):
        pieces = [t.encode("utf-8") + b" " for t in strings]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the decoded text; long texts in blocks, so that memory stays bounded by the output."""
        out = []
        for i in range(0, len(ids), 1 << 16):
            part = ids[i : i + (1 << 16)]
            length = self.length[part]
            ends = np.cumsum(length)
            out.append(self.blob[np.repeat(self.offset[part] - ends + length, length) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: str = "<u4") -> Encoder:
    """One for each worker process and vocabulary file."""
    v = vocabulary(path)
    bpe = Backtracking(v)
    return Encoder(v, lambda piece: bpe(piece, bool(v.suffix)), kind)


@functools.lru_cache(maxsize=2)
def offset_table(path: str) -> OffsetTable:
    return OffsetTable(vocabulary(path).strings)


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """docs with token_ids (array<int>), the general form for further use."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            ids = pa.array([np.frombuffer(enc.encode(t or ""), "<u4").astype(np.int32) for t in texts.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "token_ids"])

    base = docs.drop("token_ids") if "token_ids" in docs.columns else docs
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])).select(*base.columns, F.col("token_ids"))


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(tokenizer_path), offset_table(tokenizer_path)
        for batch in batches:
            n, h, d = [], [], []
            for text in batch.column(1):
                ids = enc.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                h.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(table.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
