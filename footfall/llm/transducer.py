"""Token counts by finite-state transduction.

The merges of a piece vocabulary are compiled into a deterministic transducer over characters, on demand: its state
after a prefix holds what later characters can depend on, and every transition carries by how much the number of
tokens changes. Where a piece can't cross, the transducer begins anew. A long text is read in chunks, in different tasks: each is
reduced to a map from the states it may be entered in to the state it is left in and the tokens it adds, and the maps
are composed by a prefix scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.bpe import PairTable
from footfall.llm.common import Scratch, body, bounded_batches, map_batches, worker_value

SPACE = "▁"  # how piece vocabularies write a space
CHUNK_CHARS = 1 << 16  # longer texts are read in chunks of so many characters
CONTEXT_CHARS = 256  # of the chunk before, from which the state a chunk is entered in is guessed
KNOWN_UNITS = 700_000
KNOWN_STATES = 200_000

State = tuple[str, tuple[str, ...], tuple[int, ...]]
START: State = ("", ("",), (0,))
# Where a text stands: the last character's kind, which with the next one tells whether a unit ends, and the state in it.
Place = tuple[str, State]
BEGINNING: Place = ("\n", START)
# From the places a chunk may be entered at: where it is left, and the tokens that it adds.
ChunkMap = dict[Place, tuple[Place, int]]


class Transducer:
    """Counts the tokens that merging yields for a unit: a stretch of text that no piece crosses.

    A state is what later characters can depend on: the longest suffix read so far that begins some piece, and, at each
    place in it, the token that ends there and how many tokens fewer there are than now. Merging leaves exactly one
    token sequence for every prefix, namely the one whose neighbours agree, so exactly one token can end at the next
    character. States and transitions are made when first reached.
    """

    def __init__(self, ranks: dict[str, float], width: Callable[[str], int]):
        self.ranks, self.width = ranks, width
        self.begins = {piece[:n] for piece in ranks for n in range(1, len(piece))}
        self.pairs = PairTable(lambda a, b: ranks.get(a + b))
        self.forget()

    def forget(self) -> None:
        """Drop all states and start anew. They are remade as needed, so this bounds memory and changes no count."""
        self.states: list[State] = [START]
        self.numbers: dict[State, int] = {self.states[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def _step(self, state: int, char: str) -> tuple[int, int]:
        suffix, ends, fewer = self.states[state]
        longer = suffix + char
        n = len(longer)
        for start in range(n):
            token = longer[start:]
            if (token in self.ranks or len(token) == 1) and self.pairs[ends[start], token]:
                break
        else:
            raise ValueError("the vocabulary can't spell a unit")
        added = (self.width(token) if len(token) == 1 and token not in self.ranks else 1) - fewer[start]
        keep = next((k for k in range(n) if longer[k:] in self.begins), n)
        after: State = (longer[keep:], (*ends[keep:], token), (*(f + added for f in fewer[keep:]), 0))
        number = self._number(after)
        self.steps[state][char] = number, added
        return number, added

    def _number(self, state: State) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return number

    def run(self, unit: str, entry: State | None = None) -> tuple[State, int]:
        """The state after a stretch of text, and by how much it changes the number of tokens."""
        if len(self.states) > KNOWN_STATES:
            self.forget()
        state, total, steps = 0 if entry is None else self._number(entry), 0, self.steps
        for char in unit:
            found = steps[state].get(char)
            state, added = found if found is not None else self._step(state, char)
            total += added
        return self.states[state], total

    def count(self, unit: str) -> int:
        return self.run(unit)[1]


class TextCounter(dict):
    """Counts tokens of whole texts as the library does for the vocabulary of a piece model.

    Keys are units, values their token counts: compositions of transitions from the start state, kept for a bounded
    number of units.
    """

    def __init__(self, path: str):
        super().__init__()
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = range(library.vocab_size())
        special = (library.is_control, library.is_unknown, library.is_byte, library.is_unused)
        pieces = [i for i in normal if not any(kind(i) for kind in special)]
        ranks = {library.id_to_piece(i): -library.get_score(i) for i in pieces}
        inner = [p for p in ranks if SPACE in p.lstrip(SPACE)]
        broken = [p for p in ranks if len(p) > 1 and "\n" in p]
        if inner or broken or not library.is_byte(library.piece_to_id("<0x00>")):
            raise ValueError("pieces that cross a space or line end, and models without byte pieces, are not known")
        # A character without a piece is spelled in bytes and merges with nothing.
        self.transducer = Transducer(ranks, lambda char: len(char.encode()))
        self.units_of = re.compile(" *[^ \n]+| +|\n").findall

    def __missing__(self, unit: str) -> int:
        total = self.transducer.count(unit.replace(" ", SPACE))
        if len(self) < KNOWN_UNITS and len(unit) <= 64:
            self[unit] = total
        return total

    def _total(self, units: list[str]) -> int:
        return sum(map(self.__getitem__, units))

    def follow(self, text: str, entry: Place) -> tuple[Place, int]:
        """Read a stretch of text from a place on."""
        kind, state = entry
        units = self.units_of(text)
        if not units:
            return entry, 0
        total = 0
        if _ends(kind, text[0]):
            state = START
        elif state != START:
            # The first unit goes on with one that began before; a run of spaces may go on with a word.
            state, total = self.transducer.run(units[0].replace(" ", SPACE), state)
            if len(units) == 1:
                return (_kind(text[-1]), state), total
            units = units[1:]
            state = START
        total += self._total(units[:-1])
        state, last = self.transducer.run(units[-1].replace(" ", SPACE), state)
        return (_kind(text[-1]), state), total + last

    def chunk(self, text: str, before: str) -> ChunkMap:
        """The map of a chunk, for the place that the end of the text ``before`` it seems to leave, and for the beginning.

        Reading what stands right before from any place mostly leads to the same one. Where it did not, the scan finds no entry.
        """
        entries = {BEGINNING, self.follow(before[-CONTEXT_CHARS:], BEGINNING)[0]}
        return {entry: self.follow(text, entry) for entry in entries}

    @staticmethod
    def compose(first: ChunkMap, then: ChunkMap) -> ChunkMap:
        """The map of two chunks in a row, for the entries that it is known for. Associative."""
        out: ChunkMap = {}
        for entry, (between, tokens) in first.items():
            if (found := then.get(between)) is not None:
                out[entry] = found[0], tokens + found[1]
        return out

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefixes of a sequence of maps composed, by a prefix scan of logarithmic depth."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        odd = self.scan(pairs)
        even = [self.compose(p, m) for p, m in zip(odd, maps[2::2], strict=False)]
        out = [maps[0]]
        for n in range(1, len(maps)):
            out.append(odd[n // 2] if n % 2 else even[n // 2 - 1])
        return out

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        text = spelled(text)
        if len(text) <= chunk_chars:
            return self._total(self.units_of(text))
        chunks = [text[i : i + chunk_chars] for i in range(0, len(text), chunk_chars)]
        maps = [self.chunk(c, b) for c, b in zip(chunks, ["", *chunks], strict=False)]
        whole = self.scan(maps)[-1].get(BEGINNING)
        return whole[1] if whole is not None else self.follow(text, BEGINNING)[1]


def spelled(text: str) -> str:
    """A text as the model reads it: with a space in front, and its own sign for a space being one."""
    return " " + text.replace(SPACE, " ")


def _kind(char: str) -> str:
    return char if char in " \n" else "x"


def _ends(kind: str, char: str) -> bool:
    """Whether a unit ends between a character of this kind and the next one."""
    return char == "\n" or kind == "\n" or (kind == "x" and char == " ")


def _packed(chunk_map: ChunkMap) -> str:
    return json.dumps([[entry, left, tokens] for entry, (left, tokens) in chunk_map.items()])


def _unpacked(text: str) -> ChunkMap:
    def place(kind: str, state: list) -> Place:
        return kind, (state[0], tuple(state[1]), tuple(state[2]))

    return {place(*entry): (place(*left), tokens) for entry, left, tokens in json.loads(text)}


def _long_counts(long: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """``x, y, n_tokens`` of long texts, named by two hashes: chunks are rows, so one text is read by many tasks.

    A text that the maps do not lead through, since a state was guessed wrong, has a null count.
    """

    def cut(batches):
        for batch in batches:
            for x, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = spelled(text)
                for number, at in enumerate(range(0, len(text), chunk_chars)):
                    values = (x, y, number, text[max(0, at - CONTEXT_CHARS) : at], text[at : at + chunk_chars])
                    arrays = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["x", "y", "number", "before", "chunk"])

    def read(batches):
        counter: TextCounter = worker_value(("pieces", path), lambda: TextCounter(path))
        for batch in batches:
            if batch.num_rows:
                befores, chunks = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                maps = [_packed(counter.chunk(c, b)) for c, b in zip(chunks, befores, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(maps)], ["x", "y", "number", "map"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        counter: TextCounter = worker_value(("pieces", path), lambda: TextCounter(path))
        group = group.drop_duplicates("number").sort_values("number")  # equal texts have equal maps
        whole = counter.scan([_unpacked(m) for m in group["map"]])[-1].get(BEGINNING)
        return pd.DataFrame({"x": group["x"][:1], "y": group["y"][:1], "n_tokens": [None if whole is None else whole[1]]})

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    rows = long.select("x", "y", "body").mapInArrow(cut, "x long, y long, number long, before string, chunk string")
    maps = rows.repartition("x", "y", "number").mapInArrow(read, "x long, y long, number long, map string")
    return maps.groupBy("x", "y").applyInPandas(join, "x long, y long, n_tokens long")


def token_counts(docs: DataFrame, path: str, limit: int, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, counted over whole texts.

    ``path`` names a piece model that every executor can read. Null and empty texts have neither bytes nor tokens.
    Null ids and repeated rows pass through; other columns are ignored; an empty table gives an empty result. Texts of up to
    ``chunk_chars`` characters are one chunk, entered at the beginning, and counted where the row is, without a shuffle. Of longer
    ones the chunks are dealt over all tasks, and their maps, of some hundred bytes each, composed a text at a time.
    """
    scratch = Scratch(bounded_batches(docs.sparkSession), "token-counts")
    key = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", body().alias("body"))
    is_long = F.char_length("body") > chunk_chars

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter: TextCounter = worker_value(("pieces", path), lambda: TextCounter(path))
        found = batch.column(1).to_pylist()
        totals = [counter.count(t, len(t) + 1) for t in found]
        columns = [batch.column(0), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(totals, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    schema = f"doc_id {key}, n_bytes long, n_tokens long"
    short = map_batches(texts.filter(~is_long), run, schema)
    names = {"x": F.xxhash64("body"), "y": F.xxhash64(F.lit("text"), "body")}
    long = texts.filter(is_long).withColumns(names)
    counts = scratch.table(_long_counts(long, path, chunk_chars), "long-counts")
    light = long.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "x", "y")
    known = light.join(counts.filter("n_tokens IS NOT NULL"), ["x", "y"]).select("doc_id", "n_bytes", "n_tokens")
    every = short.unionByName(known)
    missed = counts.filter("n_tokens IS NULL")
    if not missed.isEmpty():
        unknown = long.join(missed, ["x", "y"], "left_semi").select("doc_id", "body")
        every = every.unionByName(map_batches(unknown, run, schema))
    return every.withColumn("over_limit", F.col("n_tokens") > limit)
