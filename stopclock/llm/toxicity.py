"""Toxicity: a noisy-channel decoder restores disguised words, then the restored text is scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, map_batches
from stopclock.llm.words import texts_of

# The letters that a sign or digit may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
#: Symbols of the character model: a word's edge, a-z, any other letter.
EDGE, OTHER, SYMBOLS = 0, 27, 28
#: Chances of the channel: a sign that stands for a letter; a pair and a longer run of letters written for one letter, not two; a gap inside a word.
AS_LETTER, PAIR_FOR_ONE, RUN_FOR_ONE, JOINED = 0.995, 0.05, 0.6, 0.98

_CLASS = np.full(256, EDGE, np.uint8)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[0xC3:] = OTHER
_SIGNS = re.escape("".join(k for k in LEET if not k.isdigit()))
_ONE = rf"[^\W_]|[{_SIGNS}]"
#: What may be disguised: letters one by one with gaps between, a word with signs or digits in it, a word with a run of three equal letters.
SUSPECT = re.compile(
    rf"(?<![^\W_])(?:(?:(?:{_ONE})[ .\-_*]{{1,2}}){{2,}}(?:{_ONE})(?![^\W_])"
    rf"|(?:[{_SIGNS}\d]*[^\W\d_]+(?:[{_SIGNS}\d]*\d|[{_SIGNS}\d]+[^\W\d_])|[{_SIGNS}\d]+[^\W\d_])[^\W_]*(?:[{_SIGNS}]+[^\W_]+)*"
    r"|[^\W\d_]*?([^\W\d_])\1\1[^\W\d_]*)"
)
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features beside the whole word.
BEGINNINGS = (4, 5, 6)
#: Restored forms that a task keeps for words it meets again.
REMEMBERED = 1 << 16


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else OTHER


class CharacterModel:
    """Chances of a symbol after two others, from counts, with one added to each."""

    def __init__(self, counts: np.ndarray):
        triples = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 1.0
        self.log = np.log(triples / triples.sum(axis=2, keepdims=True)).tolist()

    def __reduce__(self):
        return _model_of, (np.array(self.log),)


def _model_of(log: np.ndarray) -> CharacterModel:
    model = CharacterModel.__new__(CharacterModel)
    model.log = log.tolist()
    return model


def symbol_triples(column: pa.Array) -> np.ndarray:
    """Counts of three symbols in a row in all texts, words' edges included."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    data, offsets = texts_of(column)
    for a in range(0, len(data), 1 << 20):
        # Two bytes more on either side, so that no triple is lost between pieces.
        piece = data[max(0, a - 2) : a + (1 << 20)]
        piece = _CLASS[piece[(piece < 0x80) | (piece >= 0xC0)]].astype(np.int64)
        if len(piece) > 2:
            counts += np.bincount((piece[:-2] * SYMBOLS + piece[1:-1]) * SYMBOLS + piece[2:], minlength=SYMBOLS**3)
    return counts


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a suspect the texts it may stand for, with the logs of their chances; a space is a word's edge."""
    out: list[list[tuple[str, float]]] = []
    gaps = re.fullmatch(rf"(?:(?:{_ONE})[ .\-_*]{{1,2}})+(?:{_ONE})", token) is not None
    i = 0
    while i < len(token):
        c, j = token[i], i + 1
        if gaps and c in " .-_*":
            while j < len(token) and token[j] in " .-_*":
                j += 1
            out.append([("", math.log(JOINED)), (" ", math.log(1 - JOINED))] if j == i + 1 else [(" ", 0.0)])
        else:
            while j < len(token) and token[j] == c:
                j += 1
            letters = [(x, math.log(AS_LETTER / len(LEET[c]))) for x in LEET[c]] + [(c, math.log(1 - AS_LETTER))] if c in LEET else [(c, 0.0)]
            if j == i + 1:
                out.append(letters)
            else:
                one = PAIR_FOR_ONE if j == i + 2 else RUN_FOR_ONE
                # A run stands for one or two of its letter; a run that stays a sign keeps its length.
                out.append(
                    [(x * n, p + math.log(q)) for x, p in letters for n, q in ((1, one), (2, 1 - one)) if x != c or c.isalpha()]
                    + [(x * (j - i), p) for x, p in letters if x == c and not c.isalpha()]
                )
        i = j
    return out


def restored(token: str, model: CharacterModel) -> str:
    """The likeliest text behind a suspect (Viterbi): the channel's chances times those of the character model.

    A state is the last two symbols. Where all states have come to one, what led there is settled, so long
    suspects need little memory.
    """
    log, done = model.log, []
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}

    def settle() -> None:
        _, trail = max(states.values(), key=lambda s: s[0])
        texts = []
        while trail is not None:
            trail, text = trail
            texts.append(text)
        done.extend(reversed(texts))

    for options in [*lattice(token), [("\0", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (chance, trail) in states.items():
            for text, p in options:
                x, y, total = a, b, chance + p
                for letter in text:
                    symbol = _symbol(letter) if letter.isalpha() else EDGE
                    total += log[x][y][symbol]
                    x, y = y, symbol
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, (trail, text))
        states = after
        if len(states) == 1:
            settle()
            states = {k: (0.0, None) for k in states}
    settle()
    return "".join(done).rstrip("\0")


class Restorer:
    """Replaces the suspects of texts by what they likely stand for."""

    def __init__(self, model: CharacterModel):
        self.model, self._known = model, {}

    def _one(self, match: re.Match) -> str:
        token = match.group()
        found = self._known.get(token)
        if found is None:
            found = restored(token, self.model)
            if len(token) < 64:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[token] = found
        # A space on both sides: letters that were drawn together must not run into their neighbours.
        return f" {found} "

    def __call__(self, text: str) -> str:
        return SUSPECT.sub(self._one, text.lower())


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n]


class Model:
    """Chances of the label given a word or a beginning (``abcd*``), the chance without any, and the character model."""

    def __init__(self, characters: CharacterModel, chances: dict[str, float], base: float):
        self.characters, self.chances, self.base = characters, chances, base
        self.firsts = {f.rstrip("*")[: min(BEGINNINGS)] for f in chances}

    def score(self, text: str) -> float:
        """One minus the chance that neither any word nor anything else makes the text toxic; a word counts itself, or by its best beginning."""
        clean = 1 - self.base
        for word in set(WORD.findall(text)):
            if word[: min(BEGINNINGS)] in self.firsts:
                own = self.chances.get(word)
                clean *= 1 - (own if own is not None else max((self.chances.get(f, 0.0) for f in beginnings(word)), default=0.0))
        return 1 - clean


def is_held_out(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def character_model(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """From all texts; the driver gets the sums of a fixed number of triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            counts += symbol_triples(batch.column("text"))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["triple", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = map_batches(texts, run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[found["triple"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return CharacterModel(counts)


def _chance(toxic: int, clean: int, toxic_total: int, clean_total: int, share: float) -> float:
    """The label's chance given a feature, from its rates in both classes (two clean and no toxic text added to what was seen) and the label's share."""
    a, b = share * toxic / max(1, toxic_total), (1 - share) * (clean + 0.02 * toxic) / max(1, clean_total)
    seen = toxic + clean
    return (a / (a + b) if a + b else 0.0) * seen / (seen + 1)


def fit(
    docs: DataFrame, labels: DataFrame, per_label: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sure: float = 0.01,
) -> Model:
    """Learns which words and beginnings tell of the label, and the character model.

    ``per_label`` bounds the sample: of the labelled ids that are not held out so many of each label, in the order of a
    hash of the id; equal texts count once. A word is taken when so large a part of its texts is toxic that chance would do this for any of all words with
    a probability below ``sure`` (a Chernoff bound); beginnings of the other words are then tested alike. The character model comes from all texts.
    """
    characters = character_model(docs, text_col)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.max(F.col(label_col).cast("long")) > 0).cast("int").alias("y"))
    marks = checkpointed(marks)
    totals = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    ordered = [marks.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label) for y in (0, 1)]
    # At most twice ``per_label`` rows, so they may be sent to every task.
    chosen = F.broadcast(checkpointed(ordered[0].union(ordered[1])))
    text = F.col(text_col).cast("string")
    sample = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("d"), text.alias("text")).join(chosen, F.col("d") == F.col("_id"))
    sample = checkpointed(sample.groupBy("text").agg(F.max("y").alias("y")))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean_total, toxic_total = sizes.get(0, 0), sizes.get(1, 0)

    def counted(features: Callable[[set[str]], set[str]]) -> DataFrame:
        """In how many clean and toxic texts of the sample each feature of their words is."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer, seen = Restorer(characters), (Counter(), Counter())

            def flush() -> pa.RecordBatch:
                keys = list(seen[0].keys() | seen[1].keys())
                columns = [pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)]
                for s in seen:
                    s.clear()
                return pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

            for batch in batches:
                for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                    seen[y].update(features(set(WORD.findall(restorer(text.as_py())))))
                    if len(seen[0]) + len(seen[1]) > 200_000:
                        yield flush()
            yield flush()

        found = map_batches(sample, run, "feature string, clean long, toxic long")
        return checkpointed(found.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))

    def telling(found: DataFrame) -> dict[str, float]:
        """Those whose toxic share lies so far above the sample's that chance doesn't explain it."""
        if not 0 < toxic_total < toxic_total + clean_total:
            return {}
        base, seen = toxic_total / (toxic_total + clean_total), F.col("toxic") + F.col("clean")
        part = F.col("toxic") / seen
        gain = part * F.log(part / base) + F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - base))).otherwise(0.0)
        strong = found.where((F.col("toxic") > 0) & (part > base)).where(seen * gain > math.log(found.count() / sure))
        chances = {r["feature"]: _chance(r["toxic"], r["clean"], toxic_total, clean_total, share) for r in strong.collect()}
        return {k: p for k, p in chances.items() if p >= 0.5}

    chances = telling(counted(lambda words: words))
    # A beginning speaks for the words that don't speak for themselves.
    known = set(chances)
    chances |= telling(counted(lambda words: {b for w in words - known for b in beginnings(w)}))
    model = Model(characters, chances, 0.0)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, none = Restorer(characters), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                none[y] += model.score(restorer(text.as_py())) == 0
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in none], ["clean", "toxic"])

    rest = map_batches(sample, left, "clean long, toxic long").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    clean, toxic = (rest["clean"] or 0) / max(1, clean_total) * (1 - share), (rest["toxic"] or 0) / max(1, toxic_total) * share
    # Without a sign of it a text is as likely toxic as the labelled texts without one; this alone never decides.
    model.base = min(0.5, toxic / (toxic + clean)) if toxic + clean else min(0.5, share)
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; only the text decides the score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.characters)
        for batch in batches:
            score = np.array([model.score(restorer(text.as_py() or "")) for text in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def detect_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_label: int = 10_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, learned from ``labels`` (``doc_id, toxic``).

    Documents whose ``crc32`` of the id as text leaves remainder 1 modulo 3 are held out; a null id counts as empty text.

    Words may be disguised: letters written as digits or signs, drawn out in long runs, or set apart by gaps. Every suspect becomes a
    lattice of what its places may stand for, and the Viterbi path under a model of three characters (counted over all
    texts) is the restored text. A suspect without a second reading stays as it is. Words of the restored text and their beginnings carry
    chances learned from the labels; ``score`` joins them as independent causes, ``predicted`` is 1 from ``threshold`` on.

    Null and empty texts get the score of texts without a sign, as do all where no label can be learned from. A doc with several labels is toxic if one says so; labels
    without a document, and null ones, teach nothing. Repeated rows are scored alike. Texts of any length are scored whole.
    An empty table gives no rows; other columns are ignored.
    """
    return score_toxicity(docs, fit(docs, labels, per_label), threshold)
