"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed into
phrases, each the longest match that the automaton has from where the last one ended; the
language in whose automaton the fewest phrases do, as phrases x log2(automaton's text
length) / characters, wins.  All texts of a batch move through all automata in step, one
table lookup a character.

Texts are lower-cased; what isn't a letter is one space.  Whole texts are parsed.  Long ones
move as segments of ``SEGMENT`` characters, each as if a phrase began with it; then each is
parsed again from where the one before it really ended, until both parses are in one state,
from where on they are the same.

Every learned letter is a symbol of its own.  The moves by the commonest are in a dense
table, those by all others in a sorted one, so a script of thousands of letters is as exact
as one of thirty.

Learning: a bounded sample of ``SAMPLE`` labelled texts a language, those with the least hash,
and of these passages from their middle, as long as ``LEARNT`` characters a language allow.
Only the passages leave the executors.  The bounds are what a worker's tables need: states x
dense symbols x 4 bytes a language.

Cases: a null text, or one without a letter, is ``und`` with score 0.  Without any labelled
row every text is ``und``.  Ties go to the first language by code point.  Letters that no
learned text has match nothing.  Repeated rows are predicted alike.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.shared import hold, tidy

SAMPLE = 200
LEARNT = 40_000
#: Parts of a language's hashes, of each of which the least are taken first.
PARTS = 32
#: Symbols with a column in the dense table: a space, one for all letters that no learned text
#: has, and the commonest letters.
SYMBOLS = 64
SEGMENT = 4096
#: Segments that move in step.
STEP = 4096
UNKNOWN = "und"
#: Texts that are predicted together.
ROWS = 1_000


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE, length: int = LEARNT) -> list[tuple[str, str]]:
    """(language, passage) of at most so many labelled texts a language, spread by text hash;
    a passage is a text's middle, ``length`` characters at most."""
    hashed = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_h", F.xxhash64("text"))
    # copies of one text teach nothing new: they are one row before anything is dealt
    part, least = Window.partitionBy("lang", "_part").orderBy("_h"), Window.partitionBy("lang").orderBy("_h")
    first = hashed.select("lang", "_h", F.pmod("_h", F.lit(PARTS)).alias("_part")).distinct()
    for window in (part, least):  # a language's hashes are many: the least of each part first
        first = first.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= rows)
    start = F.greatest(F.lit(0), F.floor((F.length("text") - length) / 2)).cast("int") + 1
    passages = hashed.join(F.broadcast(first.select("lang", "_h")), ["lang", "_h"]).select("lang", "_h", F.substring("text", start, F.lit(length)).alias("passage"))
    found = passages.groupBy("lang", "_h").agg(F.min("passage").alias("passage")).collect()
    return [(r["lang"], r["passage"]) for r in sorted(found, key=lambda r: (r["lang"], r["_h"]))]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


class Parser:
    """Suffix automata of all languages in one table of moves.

    ``moves[state * symbols + symbol]`` is the next state times 2, plus 1 if a phrase begins:
    then the move is the one that the automaton's start makes.  Symbols from ``symbols`` on are
    rarer letters: ``rare`` has, sorted, state * all symbols + symbol of each move that there
    is, ``rare_moves`` where it leads, and ``rare_first[language, symbol - symbols]`` the move
    otherwise.
    """

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        found, counts = np.unique(codes("".join(texts.values())), return_counts=True)
        letters = [(n, c) for c, n in zip(found.tolist(), counts.tolist(), strict=True) if chr(c).isalpha()]
        often = [c for _, c in sorted(letters, key=lambda x: (-x[0], x[1]))]
        self.letters = sorted(often[: SYMBOLS - 2]) + often[SYMBOLS - 2 :]
        self.symbols = min(len(self.letters) + 2, SYMBOLS)  # 0 a space, 1 any other letter
        self.all = len(self.letters) + 2
        self.of = np.zeros(0x110000, np.min_scalar_type(self.all))
        self.of_other()
        tables, rare, self.starts, at = [], [], [], 0
        self.rare_first = np.zeros((len(self.names), self.all - self.symbols), np.int32)
        for k, name in enumerate(self.names):
            table, state, symbol, to = self.automaton(self.symbol(texts[name]).tolist())
            n = len(table) // self.symbols
            # one more state, n, where no phrase is open: a text starts there, and a symbol that
            # the language doesn't have, a phrase of its own, leads there
            first = table[: self.symbols].copy()
            first[first < 0] = n
            table = np.concatenate([table, np.full(self.symbols, -1)])
            broken = table < 0
            table[broken] = np.tile(first, n + 1)[broken]
            tables.append(((table + at) * 2 + broken).astype(np.int32))
            rare.append(((state + at) * self.all + symbol, (to + at) * 2))
            self.rare_first[k] = (at + n) * 2 + 1
            self.rare_first[k, symbol[state == 0] - self.symbols] = (to[state == 0] + at) * 2 + 1
            self.starts.append(at + n)
            at += n + 1
        self.moves = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        keys, moves = (np.concatenate(x) if rare else np.zeros(0, np.int64) for x in (zip(*rare, strict=True) if rare else ((), ())))
        order = np.argsort(keys)
        # a last key that no state has, so a search always ends at one
        self.rare = np.append(keys[order], np.iinfo(np.int64).max)
        self.rare_moves = np.append(moves[order], 0).astype(np.int32)
        self.sizes = np.array([max(2, len(texts[n])) for n in self.names], float)

    def of_other(self) -> None:
        for plane in range(0, 0x110000, 0x10000):
            self.of[plane : plane + 0x10000] = [chr(c).isalpha() for c in range(plane, plane + 0x10000)]
        for k, c in enumerate(self.letters):
            self.of[c] = k + 2

    def symbol(self, text: str) -> np.ndarray:
        """Symbols of a lower-cased text, with one space for each run of what isn't a letter."""
        s = self.of[codes(text.lower())]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep]
        return s[int(len(s) > 0 and s[0] == 0) : len(s) - int(len(s) > 1 and s[-1] == 0)]

    def automaton(self, text: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The suffix automaton's moves: the dense table, -1 where there is none, and state,
        symbol and next state of those by rarer letters."""
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(link)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(link)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(moves[q].copy())
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        size = np.fromiter(map(len, moves), np.int64, len(moves))
        total = int(size.sum())
        state = np.repeat(np.arange(len(moves)), size)
        symbol = np.fromiter((c for m in moves for c in m), np.int64, total)
        to = np.fromiter((q for m in moves for q in m.values()), np.int64, total)
        table = np.full(len(moves) * self.symbols, -1, np.int64)
        dense = symbol < self.symbols
        table[state[dense] * self.symbols + symbol[dense]] = to[dense]
        return table, state[~dense], symbol[~dense], to[~dense]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each text (its symbols) and language the number of phrases."""
        out = np.zeros((len(texts), len(self.names)))
        length = np.array([len(t) for t in texts], np.int64)
        pieces = -(-length // SEGMENT)
        if not pieces.sum():
            return out
        flat = np.concatenate([*texts, np.zeros(SEGMENT, self.of.dtype)])
        owner = np.repeat(np.arange(len(texts)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(length) - length, pieces) + place * SEGMENT
        size = np.minimum(SEGMENT, length[owner] - place * SEGMENT)
        count, end = np.zeros((len(self.names), len(owner)), np.int64), np.zeros((len(self.names), len(owner)), np.int32)
        order = np.argsort(-size, kind="stable")
        for o in range(0, len(order), STEP):
            k = order[o : o + STEP]
            count[:, k], end[:, k] = self._segments(flat, begin[k], size[k])
        by_place = np.argsort(place, kind="stable")
        bound = np.cumsum(np.bincount(place))
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            for o in range(a, b, STEP):
                self._joined(flat, by_place[o : min(b, o + STEP)], begin, size, count, end)
        for k in range(len(self.names)):
            out[:, k] = np.bincount(owner, count[k], len(texts))
        return out

    def _next(self, language, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Moves of states (times the dense symbols) by symbols; all are arrays of one length."""
        rare = np.flatnonzero(symbol >= self.symbols)
        move = self.moves.take(state + np.where(symbol < self.symbols, symbol, 0).astype(np.int32))
        if len(rare):
            key = (state[rare] // np.int32(self.symbols)).astype(np.int64) * self.all + symbol[rare]
            at = np.searchsorted(self.rare, key)
            move[rare] = np.where(self.rare[at] == key, self.rare_moves[at], self.rare_first[language[rare], symbol[rare] - self.symbols])
        return move

    def _joined(self, flat, segments, begin, size, count, end) -> None:
        """Goes on, in these segments, from where the ones before them really ended, until that
        makes no difference; counts and ends are put right."""
        language = np.repeat(np.arange(len(self.names)), len(segments))
        own = np.tile(segments, len(self.names))
        true = end[language, own - 1]
        fresh = (np.array(self.starts, np.int32) * np.int32(self.symbols))[language]
        for t in range(SEGMENT):
            over = size[own] <= t
            if over.any():
                end[language[over], own[over]] = true[over]
            apart = ~over & (true != fresh)
            language, own, true, fresh = language[apart], own[apart], true[apart], fresh[apart]
            if not len(own):
                return
            symbol = flat[begin[own] + t].astype(np.int64)
            a, b = self._next(language, true, symbol), self._next(language, fresh, symbol)
            np.add.at(count, (language, own), (a & 1) - (b & 1))
            true, fresh = (a >> 1) * np.int32(self.symbols), (b >> 1) * np.int32(self.symbols)
        end[language, own] = true

    def _segments(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each language in segments, of falling size, that begin a phrase, and the
        states in which they end."""
        languages = len(self.names)
        state = np.tile(np.array(self.starts, np.int32), (len(begin), 1)).T.copy() * np.int32(self.symbols)
        count = np.zeros((languages, len(begin)), np.int32)
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, "left")) if size[-1] <= t else len(size)  # those longer than t
            symbol = flat[begin[:n] + t].astype(np.int32)
            if self.all > self.symbols and (symbol >= self.symbols).any():
                every = np.tile(symbol.astype(np.int64), languages)
                move = self._next(np.repeat(np.arange(languages), n), state[:, :n].ravel(), every).reshape(languages, n)
            else:
                move = self.moves.take(state[:, :n] + symbol)
            count[:, :n] += move & 1
            np.right_shift(move, 1, out=move)
            np.multiply(move, np.int32(self.symbols), out=move)
            state[:, :n] = move
        return count, state

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        symbols = [self.symbol(t) if t else np.zeros(0, self.of.dtype) for t in texts]
        symbols = [s if (s > 0).any() else s[:0] for s in symbols]
        names, scores = [], []
        rates = self.phrases(symbols) * np.log2(self.sizes) if self.names else None
        for k, s in enumerate(symbols):
            if not len(s) or rates is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            rate = rates[k] / len(s)
            best = int(rate.argmin())
            names.append(self.names[best])
            # the share of the winner if each language's chance falls with its excess bits
            excess = (rate - rate[best]) * math.sqrt(len(s))
            scores.append(float(1 / np.exp2(-np.minimum(excess, 60)).sum()))
        return names, scores


_PARSERS: dict[str, Parser] = {}


def parser(texts: dict[str, str]) -> Parser:
    """This worker's parser of the learned texts, built once."""
    hold("language", _PARSERS.clear)
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(texts)
    return _PARSERS[key]


def learnt(rows: list[tuple[str, str]], length: int = LEARNT) -> dict[str, str]:
    """Of each language's rows an equal share of ``length`` characters, from each row's middle."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(" ".join(text.split()))
    out = {}
    for lang, texts in by.items():
        texts.sort(key=lambda t: (len(t), t))
        got, left = [], length
        for k, t in enumerate(texts):
            share = left // (len(texts) - k)
            start = max(0, (len(t) - share) // 2)
            got.append(t[start : start + share])
            left -= len(got[-1])
        out[lang] = " ".join(got)
    return out


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The columns of ``docs``, with lang_pred and score, predicted from its column text and
    learned from ``labelled`` (text, lang)."""
    spark = docs.sparkSession
    texts = spark.sparkContext.broadcast(learnt(sample(labelled)))  # at most LEARNT characters a language
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        # the learned texts, not the tables, travel; each worker builds its automata once
        own = parser(texts.value)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                names, scores = own.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), schema)
