"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is what merging yields exactly if merging the text of each two neighbours yields these two. So a
word is encoded from the left: the longest token that matches here and agrees with the token before it is taken, and
where none agrees, the encoder backs up. Matches come from an Aho-Corasick automaton; which tokens agree is kept in a
pair-compatibility table that is filled on demand.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame

from footfall.llm.common import body, bounded_batches, map_batches, worker_value

WORD_END = "\0"  # stands for the end-of-word suffix; no byte-level character is U+0000
CACHED_WORDS = 500_000
CACHED_UNITS = 800_000
# Texts without characters from here on are split by patterns with the character classes spelled out; these classes
# and normal forms are the same in every version of Unicode. The others are split by the tokenizer's own parts.
PLAIN_LIMIT = 0x0300
_PLAIN_LEAD = 0xCB  # the largest first byte of such characters in UTF-8


def merged(symbols: list[str], rank: Callable[[str, str], int | None]) -> list[str]:
    """Merge neighbours by lowest rank, leftmost first, until nothing merges."""
    while len(symbols) > 1:
        best, place = None, -1
        for i in range(len(symbols) - 1):
            r = rank(symbols[i], symbols[i + 1])
            if r is not None and (best is None or r < best):
                best, place = r, i
        if best is None:
            break
        symbols[place : place + 2] = [symbols[place] + symbols[place + 1]]
    return symbols


class PairTable(dict):
    """Whether two tokens may follow each other: ``(left, right) -> bool``. An empty ``left`` is the word's start."""

    def __init__(self, rank: Callable[[str, str], int | None], limit: int = 1_000_000):
        super().__init__()
        self.rank, self.limit = rank, limit

    def __missing__(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        wanted = [left, right] if left else [right]
        agrees = merged(list(left + right), self.rank) == wanted
        if len(self) < self.limit:
            self[pair] = agrees
        return agrees


class BacktrackingEncoder:
    """Encodes single words, given as strings of the vocabulary's characters."""

    def __init__(self, ids: dict[str, int], ranks: dict[tuple[str, str], int]):
        self.ids = ids
        self.pairs = PairTable(lambda a, b: ranks.get((a, b)))
        self.matcher = ahocorasick.Automaton()
        for token in ids:
            self.matcher.add_word(token, len(token))
        self.matcher.make_automaton()

    def encode(self, word: str) -> list[int]:
        n = len(word)
        if word in self.ids and self.pairs["", word]:
            return [self.ids[word]]
        # The lengths of all tokens that start at each place. Matches come by their ends, so the shortest is first.
        at: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.matcher.iter(word):
            at[end + 1 - length].append(length)
        ids, pairs = self.ids, self.pairs
        tokens: list[str] = []
        left = [at[0]]  # the lengths still to try after each prefix of `tokens`
        dead = set()  # places from which the end can't be reached: each is entered once
        place = 0
        while place < n:
            choices = left[-1]
            before = tokens[-1] if tokens else ""
            while choices:
                length = choices[-1]
                choices = choices[:-1]
                token = word[place : place + length]
                if place + length not in dead and pairs[before, token]:
                    left[-1] = choices
                    tokens.append(token)
                    place += length
                    left.append(at[place] if place < n else [])
                    break
            else:
                if not tokens:
                    raise ValueError("the vocabulary can't spell a word")
                dead.add(place)
                left.pop()
                place -= len(tokens.pop())
        return [ids[t] for t in tokens]


class Decoder:
    """Token ids to text through one blob of token texts and a table of offsets into it."""

    def __init__(self, texts: list[bytes]):
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ends) or not ends[-1]:
            return b""
        moved = np.repeat(self.offset[ids] - (ends - length), length)
        return self.blob[moved + np.arange(ends[-1])].tobytes()


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return [chr(b) if b in set(prints) else chr(0x100 + others.index(b)) for b in range(256)]


def _class(wanted: Callable[[str], bool]) -> str:
    """A pattern class of the plain characters for which ``wanted`` holds."""
    return "".join(f"\\u{c:04x}" for c in range(PLAIN_LIMIT) if wanted(chr(c)))


# The white space among the plain characters, as Unicode lists it.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
_CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"


class KnownIds(dict):
    """Ids of words or units, as bytes, worked out when first asked for. Holds a bounded number of them."""

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = ids
        return ids


class TextEncoder:
    """What the tokenizers library yields for whole texts without added special tokens, truncation or padding.

    Knows byte-level BPE files of two kinds: words with a leading space, and lower-cased words with a suffix at their
    end. Anything else in the file is refused. Special tokens in a text are recognised as the library's default does.
    Words are encoded by the backtracking encoder, or else by the library's own model, and remembered.
    """

    def __init__(self, path: str, backtracking: bool = True):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is known")
        suffix = model.get("end_of_word_suffix") or ""
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = WORD_END if suffix else ""
        self.characters = _byte_characters()
        # Tokens in this module's spelling, where the suffix is one character.
        spelled = {c: c for c in self.characters} | {c + suffix: c + WORD_END for c in self.characters if suffix}
        ranks = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            spelled[a + b] = spelled[a] + spelled[b]
            ranks.setdefault((spelled[a], spelled[b]), n)
        # A last character and its end are one symbol to begin with: they merge before all else.
        if suffix:
            ranks |= {(c, WORD_END): n - 256 for n, c in enumerate(self.characters)}
        ids = {spelled[t]: i for t, i in model["vocab"].items() if t in spelled}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        encoder = BacktrackingEncoder(ids, ranks) if backtracking else None
        to_character = str.maketrans({chr(b): c for b, c in enumerate(self.characters)})

        def encode_word(word: str) -> bytes:
            spelling = word.encode().decode("latin-1").translate(to_character)
            if encoder is None:
                return np.array([t.id for t in self.library.model.tokenize(spelling)], "<u4").tobytes()
            return np.array(encoder.encode(spelling + self.suffix), "<u4").tobytes()

        self.words = KnownIds(encode_word, CACHED_WORDS)
        self.units = KnownIds(lambda unit: self._encode_unit(" " + unit), CACHED_UNITS)
        self.decode_character = {c: b for b, c in enumerate(self.characters)}
        letters = _class(lambda c: unicodedata.category(c)[0] == "L")
        numbers = _class(lambda c: unicodedata.category(c)[0] == "N")
        # Plain texts may grow a combining dot when lower-cased; it is neither letter nor number.
        if suffix:
            self.lower = True
            pattern = rf"[{letters}]+|{_CONTRACTIONS}|[{numbers}]|[^{_SPACE}{letters}{numbers}]+"
        else:
            self.lower = False
            pattern = (
                rf" ?[{letters}]+|{_CONTRACTIONS}| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+"
                rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
            )
        self.pattern = re.compile(pattern)
        size = self.library.get_vocab_size()
        self.texts = [self.library.id_to_token(i) or "" for i in range(size)]
        self.decoder = Decoder([t.encode() + b" " for t in self.texts])

    def _encode_unit(self, unit: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(unit)))

    def _encode_part(self, text: str, raw: bytes) -> bytes:
        """The ids of a text without special tokens."""
        if not raw:
            return b""
        if np.frombuffer(raw, np.uint8).max() > _PLAIN_LEAD:
            normalizer, back = self.library.normalizer, self.decode_character
            text = normalizer.normalize_str(text) if normalizer else text
            split = self.library.pre_tokenizer.pre_tokenize_str(text)
            return b"".join(self.words[bytes(map(back.__getitem__, w)).decode()] for w, _ in split)
        if self.lower:
            text = text.lower()
        elif "  " in text:
            return self._encode_unit(text)
        # Where no two spaces meet, a word begins at every space: what stands between spaces is encoded as one unit.
        first, *others = text.split(" ")
        return self._encode_unit(first) + b"".join(map(self.units.__getitem__, others))

    def encode(self, raw: bytes) -> bytes:
        """The ids of a text in UTF-8, as little-endian unsigned 32-bit integers."""
        text = raw.decode()
        if "<|" not in text:
            return self._encode_part(text, raw)
        out = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out.append(self._encode_part(part, part.encode()))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text of ids in UTF-8, for files without a decoder of their own: token texts with spaces between."""
        return self.decoder.decode(ids)[:-1]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row.

    ``path`` names a vocabulary file that every executor can read. Null and empty texts have no tokens and decode to
    the empty text. Texts of any length are taken whole. Null ids and repeated rows pass through; other columns are
    ignored; an empty table gives an empty result. No row is moved: there is no shuffle.
    """
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder: TextEncoder = worker_value(("bpe", path), lambda: TextEncoder(path))
        counts, ids_digests, decoded_digests = [], [], []
        for raw in batch.column(1):
            ids = encoder.encode(raw.as_buffer().to_pybytes())
            counts.append(len(ids) // 4)
            ids_digests.append(hashlib.sha256(ids).hexdigest())
            decoded = encoder.decode(np.frombuffer(ids, "<u4"))
            decoded_digests.append(hashlib.sha256(decoded).hexdigest())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(decoded_digests)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", body().alias("body")), run, schema)
