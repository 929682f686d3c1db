"""Language ID by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability per language. A word's probability is the sum, over all ways
to cut it into pieces, of the product of the pieces' probabilities: a forward algorithm. A text's score is the sum of
its words' logarithms plus the language's prior, so a text costs its distinct words and no row is shuffled.

Probabilities come from expectation maximisation over words counted in a bounded sample of labelled rows: at most about
``rows_per_lang`` whole documents of each language, drawn by a hash of their ids. The model is languages x pieces.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled rows per language from which probabilities are learned (the expected number of a hashed draw).
ROWS_PER_LANG = 400
ROUNDS = 2
#: Probability of a character that is no piece.
UNKNOWN = 1e-6
SMOOTHING = 0.01
#: Log prior of a text in no learned language: so much more than the best of them it has to explain.
LOG_UNDETERMINED = -20.0
#: Alphas are brought back to 1 after so many characters, so that no run of improbable ones comes to 0.
_RESCALED = 8
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"
#: Words up to this length, with the start mark, are scored together in numpy; longer ones one by one, rescaled.
_PADDED = (8, 16, 32, 48)
_CACHED_WORDS = 150_000
_TEXTS_AT_ONCE = 200
_WORDS_AT_ONCE = 4096


def words_of(text: str | None) -> list[str]:
    """Runs of letters of the whole text, in lower case."""
    return _WORD.findall(text.lower()) if text else []


@dataclass
class PieceModel:
    """Per-language piece probabilities: ``probs[i, g]`` for piece i of ``pieces`` and language g of ``langs``."""

    pieces: list[str]
    langs: list[str]
    probs: np.ndarray
    log_prior: np.ndarray
    index: dict[str, int] = field(init=False, repr=False)
    longest: int = field(init=False, repr=False)

    def __post_init__(self):
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "longest", "_table")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def with_undetermined(self) -> PieceModel:
        """The model with one more language, ``und``, in which all pieces are equally likely; the first, so that it wins ties."""
        if not self.langs:
            return self
        flat = np.full((len(self.pieces), 1), 1.0 / len(self.pieces))
        return PieceModel(self.pieces, ["und", *self.langs], np.hstack([flat, self.probs]), np.append(LOG_UNDETERMINED, self.log_prior))

    def edges(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, piece) of every piece in the marked word; -1 is an unknown character."""
        s = _START + word
        for i in range(len(s)):
            known = False
            for j in range(i + 1, min(i + self.longest, len(s)) + 1):
                if (p := self.index.get(s[i:j])) is not None:
                    known |= j == i + 1
                    yield i, j, p
            if not known:
                yield i, i + 1, -1

    def log_word(self, word: str) -> np.ndarray:
        """Log probability of a word in each language; alphas are rescaled, so that any length works."""
        n = len(word) + 1
        alpha = np.zeros((n + 1, len(self.langs)))
        alpha[0] = 1.0
        shift = np.zeros(len(self.langs))
        at = 0
        for i, j, p in self.edges(word):
            if i > at:
                at = i
                top = alpha[i : i + self.longest].max(axis=0)
                if (top < 1e-100).any():
                    alpha[i : i + self.longest] /= top
                    shift += np.log(top)
            alpha[j] += alpha[i] * (UNKNOWN if p < 0 else self.probs[p])
        return np.log(alpha[n]) + shift

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probabilities (words x languages) of many words."""
        out = np.empty((len(words), len(self.langs)))
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        low = 0
        for width in _PADDED:
            for at in _slices(np.flatnonzero((lengths > low) & (lengths <= width))):
                out[at] = self._padded([words[i] for i in at], lengths[at], width)
            low = width
        for i in np.flatnonzero(lengths > low):
            out[i] = self.log_word(words[i])
        return out

    def _padded(self, words: list[str], lengths: np.ndarray, width: int) -> np.ndarray:
        """The forward algorithm for words of at most ``width`` characters together."""
        alpha = np.zeros((width + 1, len(words), len(self.langs)))
        alpha[0] = 1.0
        shift, at = np.zeros(alpha.shape[1:]), 0
        for i, j, rows, piece in self._lattice(words, lengths, width):
            if i > at and not (at := i) % _RESCALED:
                live = lengths > i
                ahead = alpha[i : i + self.longest, live]
                top = ahead.max(axis=0)
                alpha[i : i + self.longest, live] = ahead / top
                shift[live] += np.log(top)
            alpha[j, rows] += alpha[i, rows] * self._known(piece)
        return np.log(alpha[lengths, np.arange(len(words))]) + shift

    def expected(self, words: list[str], n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Expected uses (pieces x languages) of each piece in words that occur ``n`` times in their language.

        Forward and backward sums of logarithms, for words of any length.
        """
        total = np.zeros(self.probs.shape)
        lengths, low = np.array([len(w) + 1 for w in words], dtype=np.int64), 0
        with np.errstate(divide="ignore"):
            log_probs = np.log(self.probs)
        for width in _PADDED:
            for at in _slices(np.flatnonzero((lengths > low) & (lengths <= width))):
                size, g = lengths[at], lang[at]
                known = lambda rows, piece: np.where(piece >= 0, log_probs[piece, g[rows]], _LOG_UNKNOWN)
                steps = [(i, j, rows, piece, known(rows, piece)) for i, j, rows, piece in self._lattice([words[k] for k in at], size, width)]
                alpha, beta = np.full((width + 1, at.size), -np.inf), np.full((width + 1, at.size), -np.inf)
                alpha[0], beta[size, np.arange(at.size)] = 0.0, 0.0
                for i, j, rows, _, q in steps:
                    alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + q)
                for i, j, rows, _, q in reversed(steps):
                    beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + q)
                whole = alpha[size, np.arange(at.size)]
                for i, j, rows, piece, q in steps:
                    used = n[at][rows] * np.exp(alpha[i, rows] + q + beta[j, rows] - whole[rows])
                    np.add.at(total, (piece[piece >= 0], g[rows[piece >= 0]]), used[piece >= 0])
            low = width
        for k in np.flatnonzero(lengths > low):
            self._expected_in_one(words[k], n[k], int(lang[k]), log_probs[:, lang[k]], total)
        return total

    def _expected_in_one(self, word: str, n: float, lang: int, log_probs: np.ndarray, total: np.ndarray) -> None:
        """The same for one long word, added to ``total``."""
        steps = [(i, j, p, _LOG_UNKNOWN if p < 0 else float(log_probs[p])) for i, j, p in self.edges(word)]
        size = len(word) + 1
        alpha, beta = [-math.inf] * (size + 1), [-math.inf] * (size + 1)
        alpha[0] = beta[size] = 0.0
        for i, j, _, q in steps:
            alpha[j] = _log_sum(alpha[j], alpha[i] + q)
        for i, j, _, q in reversed(steps):
            beta[i] = _log_sum(beta[i], beta[j] + q)
        for i, j, p, q in steps:
            if p >= 0:
                total[p, lang] += n * math.exp(alpha[i] + q + beta[j] - alpha[size])

    def _known(self, piece: np.ndarray) -> np.ndarray:
        return np.where((piece >= 0)[:, None], self.probs[piece], UNKNOWN)

    def _lattice(self, words: list[str], lengths: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces): the words that have a piece there; -1 is an unknown character."""
        chars = np.array([_START + w for w in words], dtype=f"<U{width}").view("<u4").reshape(len(words), width).astype(np.uint64)
        for i in range(width):
            live = np.flatnonzero(lengths > i)
            key = np.zeros(live.size, dtype=np.uint64)
            for j in range(i + 1, min(i + self.longest, width) + 1):
                live, key = (live, key) if (inside := lengths[live] >= j).all() else (live[inside], key[inside])
                if not live.size:
                    break
                key = key * _STEP + chars[live, j - 1] + np.uint64(1)
                piece = self._find(key)
                hit = slice(None) if j == i + 1 else np.flatnonzero(piece >= 0)
                yield i, j, live[hit], piece[hit]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of keys, -1 where there is none. Pieces with one key would stop the build."""
        if "_table" not in self.__dict__:
            own = np.array([_key(p) for p in self.pieces], dtype=np.uint64)
            if len(set(own.tolist())) < len(own):
                raise ValueError("two pieces of the vocabulary have the same key")
            order = np.argsort(_slot(own), kind="stable")
            head = np.searchsorted(_slot(own)[order], np.arange(_SLOTS + 1))
            self._table = np.append(own[order], np.uint64(0)), order, head, int(np.max(np.diff(head)))
        own, order, head, most = self._table
        slot = _slot(keys)
        at, end = head[slot], head[slot + 1]
        found = np.full(keys.shape, -1, dtype=np.int64)
        for step in range(most):
            some = np.flatnonzero(at + step < end)
            same = some[own[at[some] + step] == keys[some]]
            found[same] = order[at[same] + step]
        return found


_LOG_UNKNOWN = math.log(UNKNOWN)


def _log_sum(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _slices(at: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, at.size, _WORDS_AT_ONCE):
        yield at[k : k + _WORDS_AT_ONCE]


_SLOTS = 1 << 18


def _slot(keys: np.ndarray) -> np.ndarray:
    return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _key(piece: str) -> int:
    key = 0
    for c in piece:
        key = (key * int(_STEP) + ord(c) + 1) % (1 << 64)
    return key


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters in lower case, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i))
    good = (p for p in found if p == p.lower() and (p == _START or _WORD.fullmatch(p.removeprefix(_START))))
    return sorted(set(good))


def is_training_row(id_col: str):
    """Rows from which may be learned: crc32 of the id as text, modulo 5, is not 0. Null ids are not among them."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", vocabulary=VOCABULARY, rows_per_lang=ROWS_PER_LANG, rounds=ROUNDS) -> PieceModel:
    """Learn piece probabilities from training rows with a label. Without any such row, the model has no language."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "langid")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(is_training_row("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    pieces = load_pieces(vocabulary)
    if not langs:
        return PieceModel(pieces, [], np.zeros((len(pieces), 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, rows_per_lang / sizes[g]))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counted = (
        drawn.select("lang", "text")
        .mapInPandas(_count_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    words = scratch.put(counted.repartition(spark.sparkContext.defaultParallelism), "words")
    probs = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    prior = np.log(np.array([sizes[g] for g in langs]) / sum(sizes.values()))
    model = PieceModel(pieces, langs, probs, prior)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterable[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            yield from _expected_counts(batches, shared.value)

        sums = words.mapInPandas(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        counts = np.full(probs.shape, SMOOTHING)
        for r in sums.toLocalIterator():  # at most languages x pieces
            counts[r["piece"], r["lang"]] += r["n"]
        model = PieceModel(pieces, langs, counts / counts.sum(axis=0), prior)
        shared.unpersist()
    scratch.drop("words")
    return model


def _count_words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
        yield pd.DataFrame([(g, w, n) for (g, w), n in counts.items()], columns=["lang", "word", "n"])


def _expected_counts(batches: Iterable[pd.DataFrame], model: PieceModel) -> Iterator[pd.DataFrame]:
    """Expected number of uses of each piece in the words of each language."""
    total = np.zeros(model.probs.shape)
    number = {g: i for i, g in enumerate(model.langs)}
    for batch in batches:
        total += model.expected(list(batch["word"]), batch["n"].to_numpy(np.float64), batch["lang"].map(number).to_numpy(np.int64))
    piece, lang = np.nonzero(total)
    yield pd.DataFrame({"lang": lang, "piece": piece, "n": total[piece, lang]})


def predict(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``lang_pred`` and ``score`` (0 to 1).

    Only the text is used, all of it. Null texts and texts without letters get ``und`` and score 0; so does every text
    if the model knows no language. Ids may be null or repeated. The score is the language's posterior probability;
    of equal languages the first by name is taken. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            langs, scores = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def with_language(docs: DataFrame, model: PieceModel, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, whose text has a language with at least that score.

    Other than in ``predict`` a text may be in none of the languages: where all pieces being equally likely explains it
    far better. Short texts hold too little for that and go to the likeliest language.
    """
    model = model.with_undetermined()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accepted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            langs, scores = scorer(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([g != "und" and s >= least_score for g, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(accepted, docs.schema)


class _Scorer:
    """Scores texts with a bounded cache of word scores."""

    def __init__(self, model: PieceModel):
        self.model, self.at, self.table = model, {}, np.empty((0, len(model.langs)))

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for at in range(0, len(texts), _TEXTS_AT_ONCE):
            for out, part in zip((langs, scores), self._some(texts.slice(at, _TEXTS_AT_ONCE).to_pylist()), strict=True):
                out += part
        return langs, scores

    def _some(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts = [Counter(words_of(t)) for t in texts]
        if not self.model.langs:
            return ["und"] * len(counts), [0.0] * len(counts)
        if len(self.at) > _CACHED_WORDS:
            self.at, self.table = {}, np.empty((0, len(self.model.langs)))
        new = list({w for c in counts for w in c if w not in self.at})
        if new:
            self.at.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.log_words(new)])
        langs, scores = [], []
        for c in counts:
            if not any(ch.isalpha() for word in c for ch in word):  # a word may be a fraction or the like
                langs.append("und")
                scores.append(0.0)
                continue
            rows = np.fromiter(map(self.at.__getitem__, c), dtype=np.int64, count=len(c))
            total = np.fromiter(c.values(), dtype=np.float64, count=len(c)) @ self.table[rows] + self.model.log_prior
            best = int(np.argmax(total))
            langs.append(self.model.langs[best])
            scores.append(1.0 / float(np.exp(total - total[best]).sum()))
        return langs, scores


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the training rows of ``docs``, then predict all rows: ``doc_id, held_out, lang_pred, score``.

    A null id is not held out and not learned from.
    """
    found = predict(docs, fit(docs, **options))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
