"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed into the longest phrases that occur in a
language's text; the language that needs the fewest bits wins: phrases times log2 of the size of its automaton's text, per code point.

Parsing is a walk: a failed step ends a phrase and starts the next at the same code point. Automata are compiled to tables
in which a step that fails already holds where the next phrase stands, so a whole batch of texts walks at once in numpy.
Texts are cut into stretches of STRETCH code points that are parsed side by side; a phrase does not cross a stretch, and
every code point of every text is parsed.

The automata come from a bounded sample: of each language the labelled documents with the least hash of their id, whole texts, until they hold
SAMPLE_LETTERS code points (the last one may go beyond), SAMPLE_DOCS documents at most; texts over LONG_TEXT code points come last. Every letter of the sample counts: the most frequent ones
of all languages have a column in each table, the steps of the others are sorted lists (`rare`). The sample, the tables (SYMBOLS entries for
at most two states a code point) and the lists (at most three steps a code point) do not grow with the input, but with the number of languages.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows without language or id are predicted but not
learned from; equal costs go to the language that sorts first; without any labelled row everything is `und`; with one language the score of
a text is 1; repeated rows are predicted alike; an empty table gives no rows; further columns pass through `labelled` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemask.llm.common import fold_of, fresh, table

SAMPLE_DOCS, SAMPLE_LETTERS, LONG_TEXT, STRETCH, SYMBOLS = 64, 16_384, 4_096, 256, 64
# Other: a letter that no sample has; pad: after a text's end. Letters without a column are numbered from SYMBOLS on.
SPACE, OTHER, PAD = 0, SYMBOLS - 2, SYMBOLS - 1
UNKNOWN = "und"


def folded(text: str) -> np.ndarray:
    """Lower-case code points; whatever is no letter is one space."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


class Automaton:
    """The suffix automaton of a sequence of symbols, as a table of steps and, for symbols from SYMBOLS on, a sorted list of them."""

    def __init__(self, symbols: list[int]):
        nexts, links, lengths, last = [{}], [-1], [0], 0
        for s in symbols:
            here = len(nexts)
            nexts.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p >= 0 and s not in nexts[p]:
                nexts[p][s] = here
                p = links[p]
            if p >= 0:
                q = nexts[p][s]
                if lengths[p] + 1 == lengths[q]:
                    links[here] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    links[q] = links[here] = clone
                    while p >= 0 and nexts[p].get(s) == q:
                        nexts[p][s] = clone
                        p = links[p]
            last = here
        self.size = max(2, len(symbols))
        # An entry is (row of the next state) * 2 + 1 if the step ends a phrase. Rows are multiples of SYMBOLS.
        root = np.zeros(max(SYMBOLS, max(nexts[0], default=0) + 2), np.int64)  # its last entry stands for all greater symbols
        for s, to in nexts[0].items():
            root[s] = to * SYMBOLS
        steps, rare = np.tile(root[:SYMBOLS] * 2 + 1, (len(nexts), 1)), []
        for state, out in enumerate(nexts):
            for s, to in out.items():
                if s < SYMBOLS:
                    steps[state, s] = to * SYMBOLS * 2
                else:
                    rare.append((s * len(nexts) + state, to * SYMBOLS * 2))
        steps[:, PAD] = np.arange(len(nexts)) * SYMBOLS * 2
        self.steps = steps.astype(np.int32).ravel()
        self.states, self.root = len(nexts), (root * 2 + 1).astype(np.int32)
        self.rare = np.array(sorted(rare), np.int64).reshape(-1, 2).T.copy()

    def _rare_steps(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        failed = self.root[np.minimum(symbols, len(self.root) - 1)]
        keys, to = self.rare
        if not len(keys):
            return failed
        wanted = symbols.astype(np.int64) * self.states + state // SYMBOLS
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, to[at], failed).astype(np.int32)

    def phrases(self, stretches: np.ndarray) -> np.ndarray:
        """Phrases of each column of `stretches` (symbols, one row per place). The last phrase of a stretch counts."""
        state = np.zeros(stretches.shape[1], np.int32)
        count = np.zeros(stretches.shape[1], np.int32)
        wide = stretches.dtype != np.uint8 or bool((stretches >= SYMBOLS).any())
        for row in stretches:
            if wide and len(rare := np.flatnonzero(row >= SYMBOLS)):
                step = self.steps[state + np.where(row < SYMBOLS, row, OTHER).astype(np.int32)]
                step[rare] = self._rare_steps(state[rare], row[rare])
            else:
                step = self.steps[state + row.astype(np.int32)]
            count += step & 1
            state = step >> 1
        return count + (state > 0)


class Model:
    """Automata by language, over one alphabet: all letters of the sample, the most frequent ones first."""

    def __init__(self, texts: dict[str, list[str]]):
        letter = _letters()
        cleaned = {lang: [np.where(letter[c], c, 32) for c in map(folded, sample)] for lang, sample in texts.items()}
        counts = Counter(int(c) for parts in cleaned.values() for p in parts for c in p if c != 32)
        found = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        numbers = [*range(1, OTHER), *range(SYMBOLS, SYMBOLS + len(found))][: len(found)]
        self.symbol = np.where(letter, OTHER, SPACE).astype(np.min_scalar_type(max([PAD, *numbers])))
        self.symbol[found] = numbers
        self.letter = letter
        self.languages = sorted(lang for lang, parts in cleaned.items() if any(len(p) for p in parts))
        self.automata = []
        for lang in self.languages:
            joined: list[int] = []
            for p in cleaned[lang]:
                joined += [SPACE, *self.symbol[p].tolist()]
            self.automata.append(Automaton(joined))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points = [folded(t or "") for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        lettered = np.array([bool(self.letter[p].any()) for p in points], bool)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages or not lettered.any():
            return langs, scores
        # Runs of anything but letters are one space.
        parts = []
        for p in points:
            s = self.symbol[p]
            parts.append(s[np.concatenate(([True], (s[1:] != SPACE) | (s[:-1] != SPACE)))] if len(s) else s)
        lengths = np.array([len(p) for p in parts], np.int64)
        pieces = -(-lengths // STRETCH)
        grid = np.full((int(pieces.sum()), STRETCH), PAD, self.symbol.dtype)
        flat, at = grid.ravel(), 0
        for p, n in zip(parts, pieces.tolist(), strict=True):
            flat[at : at + len(p)] = p
            at += n * STRETCH
        owner = np.repeat(np.arange(len(texts)), pieces)
        columns = np.ascontiguousarray(grid.T)
        bits = np.stack([np.bincount(owner, a.phrases(columns), len(texts)) * np.log2(a.size) for a in self.automata])
        best = bits.argmin(0)
        least = bits[best, np.arange(len(texts))]
        shares = least / np.maximum(bits, 1e-9)
        for i in np.flatnonzero(lettered & (sizes > 0)).tolist():
            langs[i] = self.languages[best[i]]
            scores[i] = float(1.0 / shares[:, i].sum())
        return langs, scores


def fitted(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the bounded sample of the rows that `learn` is true for: of each language the first texts by the hash of their id, whole, until
    they hold SAMPLE_LETTERS code points, texts over LONG_TEXT last; SAMPLE_DOCS at most. A hot language's rows are ranked before they are shuffled."""
    by_hash = Window.partitionBy("lang").orderBy("long", "h", "id")
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"), (F.length(text_col) > LONG_TEXT).alias("long")
    )
    first = rows.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= SAMPLE_DOCS)
    before = F.coalesce(F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = first.withColumn("before", before).where(F.col("before") < SAMPLE_LETTERS).orderBy("lang", "place").select("lang", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sample:
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model(texts)


def labelled(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """`docs` with the predicted language and its score. Only slices of a batch are held in memory at once."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf(f"struct<{lang_out}:string,{score_out}:double>")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores, held, size = [], [], [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size > 2_000_000:
                    a, b = known.value.predict(held)
                    langs, scores, held, size = langs + a, scores + b, [], 0
            if held:
                a, b = known.value.predict(held)
                langs, scores = langs + a, scores + b
            yield pd.DataFrame({lang_out: langs, score_out: scores})

    found = fresh(docs, "found")
    return docs.withColumn(found, predicted(F.col(text_col))).select(*docs.columns, f"{found}.*")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 5)
    rows = labelled(docs.select("doc_id", "text"), fitted(docs, fold != 0))
    return rows.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op3_langid": (op3_langid, None)}
