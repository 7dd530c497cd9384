"""Language identification by unigram piece models, summed over all segmentations of every word."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stopclock.llm.shared import Scratch, checkpointed, map_batches, own_names, plain_names
from stopclock.llm.words import mix, powers, texts_of, word_bounds, word_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pieces of more bytes aren't used, and the fit counts longer words in parts of so many bytes; scores are of whole words.
PART = 32
#: Longer words are summed one by one.
LONG = 256
#: Bytes after which sums are scaled, so that they stay above the least double.
SCALED = 16
UNKNOWN = "und"
#: Words of a text that counts for the floor of its language; how far below it a text must lie to be in none of the
#: learned languages, in nats a byte, and how much further a text of n words, in parts of the square root of n.
FULL_TEXT, BELOW, BELOW_SHORT = 20, 0.5, 3.0
#: Bytes of text whose words are scored together.
TOGETHER = 1 << 20

#: After lower-casing, words are runs of a-z and of all bytes of non-ASCII characters.
OTHERS = np.ones(256, bool)
OTHERS[97:123] = False
OTHERS[128:] = False
_SPACE = 0x20
_BASES = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_STEP = np.uint64(0xD1342543DE82EF95)


class Pieces:
    """The usable pieces of a vocabulary: one word's letters, or a space and the first letters of a word."""

    def __init__(self, lines: list[bytes]):
        found = {bytes([b]) for b in range(256) if not OTHERS[b]} | {b" "}
        for line in lines:
            piece = base64.b64decode(line.split()[0]) if line.strip() else b""
            letters = piece[1:] if piece[:1] == b" " else piece
            if letters and len(piece) <= PART and not OTHERS[np.frombuffer(letters, np.uint8)].any():
                found.add(piece)
        self.pieces = sorted(found)
        self.longest = max(map(len, self.pieces))
        hashes = np.zeros(len(self.pieces), np.uint64)
        for i, piece in enumerate(self.pieces):
            h = np.zeros(1, np.uint64)
            for b in piece:
                h = h * _STEP + _BASES[b]
            hashes[i] = mix(h)[0]
        self._powers = powers(int(_STEP), self.longest)
        self._order = np.argsort(hashes)
        self._sorted = hashes[self._order]

    def __len__(self) -> int:
        return len(self.pieces)

    def named(self, hashes: np.ndarray) -> np.ndarray:
        """The pieces with these hashes, or -1."""
        key = mix(hashes)
        at = np.minimum(np.searchsorted(self._sorted, key), len(self._sorted) - 1)
        return np.where(self._sorted[at] == key, self._order[at], -1)

    def tables(self, words: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For words of one length (rows of bytes), end by end: the piece of each size that ends there, or -1."""
        n = words.shape[1]
        values = _BASES[words]
        for end in range(n):
            h = np.zeros(len(words), np.uint64)
            found = []
            for size in range(1, min(end + 1, self.longest) + 1):
                h = h + values[:, end + 1 - size] * self._powers[size - 1]
                found.append(self.named(h))
            yield found

    def along(self, word: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """For one long word, end by end: ``(size, piece)`` of all pieces that end there."""
        for a in range(0, len(word), 1 << 14):
            b = min(len(word), a + (1 << 14))
            values = _BASES[word[max(0, a - self.longest) : b]]
            before = len(values) - (b - a)
            ends: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
            h = np.zeros(b - a, np.uint64)
            for size in range(1, self.longest + 1):
                start = before + 1 - size
                skip = max(0, -start)  # ends with fewer bytes before them
                if skip >= b - a:
                    break
                h[skip:] += values[start + skip : start + b - a] * self._powers[size - 1]
                found = self.named(h)
                for i in (np.flatnonzero(found[skip:] >= 0) + skip).tolist():
                    ends[i].append((size, int(found[i])))
            yield from ends


def load_pieces(path: str = VOCABULARY) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read().splitlines())


def _by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of words as rows of bytes of one length, with the index of each part's word; a word begins with a space."""
    sizes = ends - starts + 1
    parts = -(-sizes // PART)
    word = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = nth * PART  # counted with the space in front
    size = np.minimum(sizes[word] - begin, PART)
    for n in np.unique(size):
        chosen = np.flatnonzero(size == n)
        for some in np.array_split(chosen, max(1, len(chosen) * int(n) // (1 << 18) + 1)):
            at = starts[word[some], None] - 1 + begin[some, None] + np.arange(n)
            rows = data[np.maximum(at, 0)]
            rows[begin[some] == 0, 0] = _SPACE
            yield rows, word[some]


def _whole_by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words as rows of bytes of one length, with a space in front, and their indexes."""
    sizes = ends - starts + 1
    for n in np.unique(sizes):
        chosen = np.flatnonzero(sizes == n)
        for some in np.array_split(chosen, max(1, len(chosen) * int(n) // (1 << 18) + 1)):
            rows = data[np.maximum(starts[some, None] - 1 + np.arange(n), 0)]
            rows[:, 0] = _SPACE
            yield rows, some


def log_likelihoods(pieces: Pieces, chances: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Forward algorithm: for each word the log of its chance in each language, over all segmentations into pieces.

    Sums are scaled every few bytes, so words of any length are summed whole.
    """
    out = np.zeros((len(starts), chances.shape[1]))
    padded = np.vstack([chances, np.zeros(chances.shape[1])])  # piece -1 has no chance
    short = np.flatnonzero(ends - starts < LONG)
    for rows, word in _whole_by_length(data, starts[short], ends[short]):
        sums, logs = [np.ones((len(rows), chances.shape[1]))], np.zeros((len(rows), chances.shape[1]))
        for end, found in enumerate(pieces.tables(rows), 1):
            total = np.zeros_like(sums[0])
            for size, piece in enumerate(found, 1):
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    total[hit] += sums[-size][hit] * padded[piece[hit]]
            sums = [*sums[-pieces.longest + 1 :], total]
            if end % SCALED == 0:
                logs += np.log(total)
                sums = [x / total for x in sums]
        out[short[word]] = logs + np.log(sums[-1])
    for i in np.flatnonzero(ends - starts >= LONG):
        out[i] = _long_word(pieces, chances, np.concatenate([[_SPACE], data[starts[i] : ends[i]]]))
    return out


def _long_word(pieces: Pieces, chances: np.ndarray, word: np.ndarray) -> list[float]:
    """The same sums for one word, byte by byte."""
    languages, known = range(chances.shape[1]), {}
    sums, logs = [[1.0] * len(languages)], [0.0] * len(languages)
    for end, found in enumerate(pieces.along(word), 1):
        total = [0.0] * len(languages)
        for size, piece in found:
            chance = known.get(piece)
            if chance is None:
                chance = known[piece] = chances[piece].tolist()
            for k in languages:
                total[k] += sums[-size][k] * chance[k]
        if end % SCALED == 0:
            logs = [x + math.log(t) for x, t in zip(logs, total, strict=True)]
            sums = [[x / t for x, t in zip(row, total, strict=True)] for row in sums[-pieces.longest + 1 :]]
            total = [1.0] * len(languages)
        sums.append(total)
        if len(sums) > 4 * pieces.longest:
            del sums[: -pieces.longest]
    return [x + math.log(t) for x, t in zip(logs, sums[-1], strict=True)]


def expected_counts(pieces: Pieces, chances: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one language, words weighted by ``weight`` (one forward-backward pass)."""
    out = np.zeros(len(pieces))
    for rows, word in _by_length(data, starts, ends):
        table, n = list(pieces.tables(rows)), rows.shape[1]
        ahead = [np.ones(len(rows))]
        for end, found in enumerate(table):
            total = np.zeros(len(rows))
            for size, piece in enumerate(found, 1):
                total += np.where(piece >= 0, ahead[end + 1 - size] * chances[piece], 0)
            ahead.append(total)
        behind = [np.zeros(len(rows)) for _ in range(n)] + [np.ones(len(rows))]
        scale = weight[word] / ahead[n]
        for end in range(n - 1, -1, -1):
            for size, piece in enumerate(table[end], 1):
                hit = np.flatnonzero(piece >= 0)
                use = chances[piece[hit]] * behind[end + 1][hit]
                behind[end + 1 - size][hit] += use
                out += np.bincount(piece[hit], use * ahead[end + 1 - size][hit] * scale[hit], len(pieces))
    return out


def _slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``TOGETHER`` bytes of text, or one row."""
    _, offsets = texts_of(batch.column(batch.schema.get_field_index(text_col)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + TOGETHER, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, bounds of the distinct words, which of them each word is, and the rows' first words."""
    data, offsets = texts_of(pc.utf8_lower(column))
    starts, ends = word_bounds(data, offsets, OTHERS)
    _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return data, starts[first], ends[first], which, np.searchsorted(starts, offsets)


class Model:
    """Piece chances per language (pieces × languages) and the share of each language."""

    def __init__(self, pieces: Pieces, languages: list[str], chances: np.ndarray, shares: np.ndarray):
        self.pieces, self.languages, self.chances, self.shares = pieces, languages, chances, shares


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _teaches(id_col: str, text_col: str, lang_col: str) -> Column:
    return F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(id_col)


def fit(
    docs: DataFrame, path: str = VOCABULARY, per_language: int | None = 1000, rounds: int = 2,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model | None:
    """Fits the piece chances by expectation maximisation on labelled documents that are not held out.

    ``per_language`` bounds the sample: about so many documents of each language, chosen by a hash of id and text; without
    it the fit is on all of them.
    Their words are counted by Spark, every round sums expected uses over the distinct words, and the driver holds
    one number per piece and language. Null without labelled text.
    """
    pieces = load_pieces(path)
    labelled = docs.where(_teaches(id_col, text_col, lang_col))
    counts = {str(r[0]): r[1] for r in labelled.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    if per_language is not None:
        spark: SparkSession = docs.sparkSession
        shares = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "_l string, _share double")
        chosen = (F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / F.lit(1 << 30)) < F.col("_share")
        labelled = labelled.join(F.broadcast(shares), F.col(lang_col).cast("string") == F.col("_l")).where(chosen)
    sample = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, "text")):
            data, starts, ends, which, first = _distinct_words(batch.column("text"))
            lang = np.repeat(pc.index_in(batch.column("lang"), pa.array(languages)).to_numpy(zero_copy_only=False), np.diff(first))
            key, n = np.unique(lang.astype(np.int64) * (len(starts) + 1) + which, return_counts=True)
            word = key % (len(starts) + 1)
            # Surrogate-free transport: words are bytes.
            values = [data[a:b].tobytes() for a, b in zip(starts[word].tolist(), ends[word].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key // (len(starts) + 1), pa.int64()), pa.array(values, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    words = checkpointed(map_batches(sample, count, "lang long, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    chances = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        summed = map_batches(words, _expect(pieces, chances), "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        uses = np.full(chances.shape, 0.01)
        np.add.at(uses, (summed["piece"].to_numpy(np.int64), summed["lang"].to_numpy(np.int64)), summed["n"].to_numpy())
        chances = uses / uses.sum(axis=0)
    total = sum(counts.values())
    return Model(pieces, languages, chances, np.array([counts[k] / total for k in languages]))


def _rates(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's log-chance a byte of its words in every language, and its words."""
    data, starts, ends, which, first = _distinct_words(texts)
    logs = log_likelihoods(model.pieces, model.chances, data, starts, ends)
    summed = np.vstack([np.zeros(logs.shape[1]), np.cumsum(logs[which], axis=0)])
    size = np.concatenate([[0], np.cumsum((ends - starts + 1)[which])])
    taken = np.maximum(1, size[first[1:]] - size[first[:-1]])
    return (summed[first[1:]] - summed[first[:-1]]) / taken[:, None], np.diff(first)


def _expect(pieces: Pieces, chances: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            data = np.frombuffer(b"".join(words.to_pylist()) or b"\0", np.uint8)
            sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            lang, n = batch.column("lang").to_numpy(), batch.column("n").to_numpy()
            for k in np.unique(lang):
                own = lang == k
                found = expected_counts(pieces, chances[:, k], data, (ends - sizes)[own], ends[own], n[own])
                used = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k), pa.int64()), pa.array(used, pa.int64()), pa.array(found[used])], ["lang", "piece", "n"])

    return run


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _without_ascii_letter(texts: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Those of the marked rows that hold no letter of ASCII."""
    ascii_letter = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(rows & ~ascii_letter)


def classify(rows: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the chance of that language given the text) to every row.

    The text column alone is read. Texts that are null or without a letter are ``und`` with score 0, as is every text
    without a model. Ties go to the language first in order. Rows never move.
    """
    schema = rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, text_col)):
            texts = batch.column(batch.schema.get_field_index(text_col))
            languages = np.full(batch.num_rows, UNKNOWN, object)
            score = np.zeros(batch.num_rows)
            if model is not None:
                data, starts, ends, which, first = _distinct_words(texts)
                logs = log_likelihoods(model.pieces, model.chances, data, starts, ends)
                own = np.tile(np.log(model.shares), (batch.num_rows, 1))
                for k in range(len(model.languages)):
                    sums = np.concatenate([[0.0], np.cumsum(logs[which, k])])
                    own[:, k] += sums[first[1:]] - sums[first[:-1]]
                chance = np.exp(own - own.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                best = chance.argmax(axis=1)
                sure = first[1:] > first[:-1]
                # Words of non-ASCII characters alone may be signs without a letter.
                for i in _without_ascii_letter(texts, sure):
                    sure[i] = _has_letter(texts[int(i)].as_py())
                languages[sure] = np.array(model.languages, object)[best[sure]]
                score[sure] = chance[sure, best[sure]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return map_batches(rows, run, schema)


def identify(docs: DataFrame, path: str = VOCABULARY, per_language: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; see ``fit`` and ``classify``.

    Documents whose ``crc32`` of the id as text leaves remainder 2 modulo 4 are held out of the fit; a null id
    counts as empty text. Texts and words of any length count whole. Repeated rows are treated alike, equally likely languages
    go by name, an empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return classify(rows, fit(docs, path, per_language, id_col=id_col, text_col=text_col, lang_col=lang_col)).drop("text")


def known_language(docs: DataFrame, path: str = VOCABULARY, per_language: int | None = None) -> DataFrame:
    """The documents in a learned language, with their columns unchanged, whatever they are called.

    The model decides: a text goes if in every language its likelihood a byte lies far below that of all texts which the language
    was learned from (see ``BELOW``), or if it is null or without a letter. So all texts of the fit stay, and text of other languages
    or garbage goes when it is long enough to tell. Without a labelled text there is no model, and all documents go.

    The model is learned from all labelled documents that are not held out (or about ``per_language`` of each language), and
    every language's least likely text is looked for among all of them. Texts are scored once, and wait in the shared folder with
    their scores until that is known.
    """
    model = fit(docs, path, per_language)
    rows = plain_names(docs)
    if model is None:
        return own_names(rows.limit(0), docs.columns)
    text = f"c{docs.columns.index('text')}"
    teacher = F.when(_teaches(*[f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "lang")]), F.col(f"c{docs.columns.index('lang')}").cast("string"))
    scores = "_rates array<double>, _words long, _letter boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, text)):
            texts = batch.column(batch.schema.get_field_index(text))
            rate, words = _rates(model, texts)
            letter = words > 0
            # Words of non-ASCII characters alone may be signs without a letter.
            for i in _without_ascii_letter(texts, letter):
                letter[i] = _has_letter(texts[int(i)].as_py())
            rates = pa.ListArray.from_arrays(pa.array(np.arange(len(rate) + 1, dtype=np.int32) * rate.shape[1]), pa.array(rate.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rates, pa.array(words.astype(np.int64)), pa.array(letter)], names=[*batch.schema.names, "_rates", "_words", "_letter"])

    taught = rows.withColumn("_teacher", teacher)
    schema = StructType([*taught.schema.fields, *StructType.fromDDL(scores).fields])
    scored = Scratch(docs.sparkSession, "language").keep(map_batches(taught, run, schema))
    own = F.get("_rates", F.array_position(F.lit(model.languages), F.col("_teacher")).cast("int") - 1)
    full = scored.where(F.col("_teacher").isNotNull() & (F.col("_words") >= FULL_TEXT))
    least = {r["_teacher"]: r["floor"] for r in full.groupBy("_teacher").agg(F.min(own).alias("floor")).collect()}
    # A language without a full text has a floor that no text is below.
    floors = F.lit([float(least.get(k, -math.inf)) for k in model.languages])
    margin = F.lit(BELOW) + F.lit(BELOW_SHORT) / F.sqrt(F.greatest(F.lit(1), F.col("_words")))
    likely = F.exists(F.zip_with("_rates", floors, lambda rate, floor: rate >= floor - margin), lambda x: x)
    return own_names(scored.where(F.col("_letter") & likely), docs.columns)
