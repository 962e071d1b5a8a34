"""Language identification by prediction by partial matching over bytes.

For every language a variable-order context tree is counted on labelled texts and frozen. A text is scored by the exact
number of bits that each tree's predictions give it: a byte that its longest known context has not seen escapes to the
next shorter one, and at last to a uniform code.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import body, bounded_batches

ORDER = 3
SAMPLE_ROWS = 400  # labelled texts a language that the trees are counted on
SAMPLE_BYTES = 1 << 16  # of longer texts that sample has the beginning
TOTAL_BYTES = 1 << 27  # of the sample of all languages together
MODEL_BYTES = 1 << 27  # of the frozen trees of all languages together
UNKNOWN = "und"
UNIT = 128  # code lengths are kept in fractions of a bit
CHANCE = 0.5  # weight of the uniform code where a text's bytes are weighed against chance
PIECE_BYTES = 1 << 19

START = b"\xff" * ORDER  # context of a text's beginning; 0xFF is no byte of UTF-8
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Model:
    """Frozen trees of all languages, laid out for lookup.

    ``codes`` maps bytes to symbols: one for each byte met in training, one for the mark of
    beginnings, and 0 for all others. ``rows`` maps the last ``ORDER``
    symbols to a row of ``bits``, whose entry for row and next symbol has each language's code length.
    """

    languages: tuple[str, ...]
    codes: np.ndarray  # 256
    rows: np.ndarray  # base ** ORDER
    bits: np.ndarray  # (rows * base, languages)

    @property
    def base(self) -> int:
        return len(self.bits) // (int(self.rows.max()) + 1)


def _joined(pieces: list[tuple[bytes, bytes]], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of pieces in a row, each after its ``ORDER`` bytes of context, and where the pieces begin."""
    symbols = codes[np.frombuffer(b"".join(part for piece in pieces for part in piece), np.uint8)]
    ends = np.cumsum([len(piece) + ORDER for _, piece in pieces])
    return symbols, np.concatenate([[0], ends[:-1]]) + ORDER


def fit(samples: dict[str, list[bytes]], max_bytes: int = MODEL_BYTES) -> Model:
    """Count the trees of each language on its samples and freeze them.

    Where the frozen trees would take more than ``max_bytes``, every language's sample is halved until they don't; each
    keeps one text at least, and of that a few bytes.
    """
    languages = tuple(sorted(samples))
    if not languages:
        return Model((), np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.uint16))
    met = np.unique(np.frombuffer(b"".join(t for texts in samples.values() for t in texts), np.uint8))
    codes = np.zeros(256, np.uint8)
    codes[0xFF] = 1
    codes[met] = np.arange(2, len(met) + 2)
    base = len(met) + 2
    strings = {}
    for name, texts in samples.items():
        symbols, begins = _joined([(START, t) for t in texts], codes)
        own = np.ones(len(symbols), bool)
        own[(begins[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
        strings[name] = symbols, np.flatnonzero(own)

    # All contexts of any order that some language has seen. The row of a context of full length is that of its longest
    # known ending: a tree goes on from there at no cost, since a context that was never met can't escape.
    grams = {}
    for name, (symbols, places) in strings.items():
        for order in range(ORDER + 1):
            contexts = np.zeros(len(places), np.int64)
            for k in range(order, 0, -1):
                contexts = contexts * base + symbols[places - k]
            pairs, counts = np.unique(contexts * base + symbols[places], return_counts=True)
            grams[name, order] = pairs, counts
    known = [np.unique(np.concatenate([grams[n, k][0] // base for n in languages])) for k in range(ORDER + 1)]
    known[0] = np.array([0])
    first = np.concatenate([[0], np.cumsum([len(k) for k in known])])
    halves = {n: t[: len(t) // 2] if len(t) > 1 else [t[0][: max(2 * ORDER, len(t[0]) // 2)]] for n, t in samples.items()}
    if 2 * int(first[-1]) * base * len(languages) > max_bytes and halves != samples:
        return fit(halves, max_bytes)
    rows = np.zeros(base**ORDER, np.int32)
    full = np.arange(base**ORDER, dtype=np.int64)
    for order in range(ORDER + 1):
        endings = full % base**order
        place = np.minimum(np.searchsorted(known[order], endings), len(known[order]) - 1)
        found = known[order][place] == endings
        rows[found] = (first[order] + place[found]).astype(np.int32)

    bits = np.zeros((first[-1], base, len(languages)), np.uint16)
    uniform = math.log2(256)
    for n, name in enumerate(languages):
        shorter = np.full((1, base), uniform)  # what a symbol costs after escaping from the empty context
        for order in range(ORDER + 1):
            pairs, counts = grams[name, order]
            contexts = known[order]
            # A context starts from the costs of its ending that is one shorter.
            if order == 0:
                costs = shorter.copy()
            else:
                endings = contexts % base ** (order - 1)
                place = np.minimum(np.searchsorted(known[order - 1], endings), len(known[order - 1]) - 1)
                hit = known[order - 1][place] == endings
                costs = np.where(hit[:, None], shorter[place], uniform)
            row = np.searchsorted(contexts, pairs // base)
            symbol = pairs % base
            total = np.bincount(row, counts, len(contexts))
            kinds = np.bincount(row, minlength=len(contexts))
            met = total > 0
            # An escape is as likely as there are kinds of symbols (method C).
            escape = np.zeros(len(contexts))
            escape[met] = np.log2((total[met] + kinds[met]) / kinds[met])
            costs += escape[:, None]
            costs[row, symbol] = np.log2((total[row] + kinds[row]) / counts)
            bits[first[order] : first[order + 1], :, n] = np.minimum(np.rint(costs * UNIT), 65535)
            shorter = costs
    return Model(languages, codes, rows, bits.reshape(-1, len(languages)))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits per text and language under the frozen trees. Texts are worked off in pieces of bounded size."""
    out = np.zeros((len(texts), len(model.languages)))
    pieces, owners, held = [], [], 0
    for n, text in enumerate(texts):
        for first in range(0, len(text), PIECE_BYTES):
            piece = text[first : first + PIECE_BYTES]
            pieces.append((text[first - ORDER : first] if first else START, piece))
            owners.append(n)
            held += len(piece)
            if held >= PIECE_BYTES:
                np.add.at(out, owners, _spent(model, pieces))
                pieces, owners, held = [], [], 0
    if pieces:
        np.add.at(out, owners, _spent(model, pieces))
    return out


def _spent(model: Model, pieces: list[tuple[bytes, bytes]]) -> np.ndarray:
    symbols, begins = _joined(pieces, model.codes)
    base = model.base
    context = np.zeros(len(symbols) - ORDER, np.int32)
    for k in range(ORDER, 0, -1):
        context *= base
        context += symbols[ORDER - k : len(symbols) - k]
    at = model.rows[context].astype(np.int64) * base + symbols[ORDER:]
    spent = np.take(model.bits, at, axis=0)
    # Between two pieces lie the context symbols of the second, which are nobody's cost.
    begins = begins - ORDER
    ends = begins + [len(piece) for _, piece in pieces]
    bounds = np.stack([begins, ends], axis=1).ravel()[:-1]
    return np.add.reduceat(spent, bounds, axis=0, dtype=np.int64)[::2] / UNIT


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or any(map(str.isalpha, raw.decode("utf-8", "replace")))


def judge(model: Model, texts: list[bytes]) -> list[tuple[str, float, float]]:
    """For each text the language with the shortest code, how sure that is, and bits a byte.

    Sureness is the share of the best language among all, with code lengths taken per hundred bytes so that it does not
    saturate with the text's length. Ties go to the first language in alphabetical order.
    """
    if not model.languages:
        return [(UNKNOWN, 0.0, 0.0)] * len(texts)
    lengths = code_lengths(model, texts)
    out = []
    for raw, spent in zip(texts, lengths, strict=True):
        if not has_letter(raw):
            out.append((UNKNOWN, 0.0, 0.0))
            continue
        best = int(spent.argmin())
        scale = max(1.0, len(raw) / 100)
        share = 1 / float(np.exp2(-np.minimum((spent - spent[best]) / scale, 1000)).sum())
        out.append((model.languages[best], share, float(spent[best]) / len(raw)))
    return out


def hedged(model: Model) -> Model:
    """A model whose code lengths are those beyond 8 bits of a byte that is uniform with weight ``CHANCE``.

    A byte that the trees do not expect costs one bit more than without any model, whatever its escapes add up to; one that
    they do expect costs less. The sum over a text grows with it only if most of its bytes are strange.
    """
    every = np.arange(65536) / UNIT
    beyond = -np.log2((1 - CHANCE) * np.exp2(8 - every) + CHANCE)
    return replace(model, bits=np.rint(beyond * UNIT).astype(np.int16)[model.bits])


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, total: int = TOTAL_BYTES) -> Model:
    """Fit on a bounded sample of ``doc_id, text, lang``: the first ``rows`` texts of each language in a random order.

    The order is that of a hash, so the sample is the same in every run. Rows without language or text are not sampled; all
    others can be, the longest by their first ``max_bytes`` bytes. Without any labelled text the model knows no language and
    every text is ``und``. The sample, about twice ``rows`` texts a language, is all that comes to the driver; with many
    languages fewer bytes a text are taken, so that it has about ``total`` bytes at most.
    """
    draw = F.xxhash64("doc_id", "text")
    usable = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.filter("lang IS NOT NULL AND length(text) > 0")
    # One row a language, of the texts that can be drawn. Twice as many as wanted are, so that too few are hardly ever.
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    texts = counts.agg(F.sum(F.least("n", F.lit(2 * rows)))).first()[0] or 1
    most = max(1, min(int(max_bytes), total // texts))
    share = F.coalesce(F.lit(2.0 * rows) / F.col("n"), F.lit(1.0))
    # Only languages that are not drawn whole, so that rare labels, however many, are not broadcast.
    frequent = counts.filter(F.col("n") > 2 * rows)
    drawn = (
        usable.join(F.broadcast(frequent), "lang", "left")
        .filter(draw / F.lit(2.0**64) + 0.5 < share)
        .select("lang", draw.alias("draw"), F.substring(F.col("text").cast("binary"), 1, most).alias("text"))
        .distinct()
    )
    samples: dict[str, list[tuple[int, bytes]]] = {}
    for row in drawn.collect():
        whole = bytes(row.text).decode("utf-8", "ignore").encode()  # a character may have been cut
        samples.setdefault(row.lang, []).append((row.draw, whole or bytes(row.text)))
    return fit({name: [text for _, text in sorted(held)[:rows]] for name, held in samples.items()})


def identify(docs: DataFrame, model: Model, keep: list[str], strange: bool = False) -> DataFrame:
    """Predict every row's language from its whole text: the columns ``keep``, then ``lang_pred, score, bits_per_byte``.

    With ``strange`` a column of that name follows: the bits by which the text speaks against every language (``hedged``), 0
    where the best one predicts it better than chance.

    A text that is null or has no letter is ``und`` with score 0. Nothing but the text is looked at. Null ids, repeated
    rows and columns not in ``keep`` do not matter; an empty table gives an empty result. There is no shuffle. ``keep``
    must not name a result column.
    """
    spark = bounded_batches(docs.sparkSession)
    # A few MB: bounded by the symbols and the sample, not by the corpus.
    shared = spark.sparkContext.broadcast(model)
    names = [*keep, "lang_pred", "score", "bits_per_byte", *(["strange"] if strange else [])]

    def run(batches):
        weighed = None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [raw.as_buffer().to_pybytes() for raw in batch.column(len(keep))]
            found = judge(shared.value, texts)
            results = list(zip(*found, strict=True))
            kinds = (pa.string(), pa.float64(), pa.float64())
            added = [pa.array(c, k) for c, k in zip(results, kinds, strict=True)]
            if strange:
                against, dear = np.zeros(len(texts)), [n for n, x in enumerate(found) if x[2] >= 8]
                if dear:
                    weighed = weighed or hedged(shared.value)
                    against[dear] = code_lengths(weighed, [texts[n] for n in dear]).min(axis=1)
                added.append(pa.array(against))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *added], names)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    # The text to score comes last, under a name that no kept column has.
    scored = docs.select(*(F.col(f"`{c}`") for c in keep), body().alias("text to score"))
    added = "lang_pred string, score double, bits_per_byte double" + ", strange double" * strange
    return scored.mapInArrow(run, f"{schema}, {added}")


def predict_held_out(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from labelled documents outside the held-out fold and predict all: ``doc_id, held_out, lang_pred, score``.

    The fold is the CRC-32 of ``doc_id`` as text; a null id is in no fold. Every input row has a result row.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    held_out = F.coalesce(fold == held, F.lit(False))
    model = train(docs.filter(~held_out))
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
