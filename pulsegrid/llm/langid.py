"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text.  A text is parsed greedily
against each automaton: a phrase is the longest stretch that occurs in the language's sample.  The language that
needs the fewest phrases, normalised by the number of symbols and by the phrases that its own held-back sample
needs, wins.

Texts are lower-cased; a symbol is a letter of some language's sample, and runs of other characters count as one
separator.  Each language has an alphabet of its own: a letter that its sample does not have ends a phrase, and no letter of
any sample is left out.  Automata over at most ``DENSE`` symbols are tables, those over more are sorted arrays of their
transitions, so memory follows the sample, not the alphabet.  Texts are parsed in stretches of ``STRETCH`` symbols (a phrase
ends at the end of a stretch), so that many stretches advance in step, one numpy lane each; every symbol of every text
is parsed.

The sample: ``sample_chars`` characters per language of labelled texts in hash order of their ids, at most ``doc_chars``
of each and at most ``sample_docs`` texts, for the ``languages`` languages with the most labelled texts, and ``all_chars``
characters of all languages together, so the automata take at most about half a gigabyte of a worker, however many
languages there are; these bounds are parameters and do not grow with the corpus.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; documents with a null language are
never learned from; if nothing is labelled every text is ``und``; ties go to the language first by code point;
an empty table gives an empty result; repeated rows are answered alike; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import fold, id_text, slices, table

STRETCH = 2048
#: A text is in no learned language if it needs more than so many times the phrases of the nearest one's own texts.
UNLIKE = 2.5
#: Symbols up to which an automaton is a table, and languages that are parsed at once.
DENSE = 64
TOGETHER = 8
SEPARATOR = 1
OTHER = 2
FIRST = 3


class SuffixAutomaton:
    """The smallest automaton of all substrings of a sequence of symbols, as one flat array of transitions (-1: none)."""

    def __init__(self, symbols: list[int], width: int):
        flat = array("i", [-1]) * (2 * max(len(symbols), 1) * width)  # there are fewer than twice as many states as symbols
        link, length, last, states = [-1], [0], 0, 1
        for c in symbols:
            cur, states = states, states + 1
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and flat[p * width + c] < 0:
                flat[p * width + c] = cur
                p = link[p]
            if p != -1:
                q = flat[p * width + c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone, states = states, states + 1
                    flat[clone * width : (clone + 1) * width] = flat[q * width : (q + 1) * width]
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and flat[p * width + c] == q:
                        flat[p * width + c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.flat, self.width, self.states = flat, width, states

    def table(self, out: np.ndarray | None = None, base: int = 0) -> np.ndarray:
        """Flat transitions, from ``base`` on: state * width + symbol -> next state * width, or its negative complement if a new phrase begins there.

        A last row is the state before the first symbol and after one that the sample does not have: whatever follows
        begins a phrase.
        """
        n, width = self.states, self.width
        out = np.empty((n + 1) * width, dtype=np.int32) if out is None else out[: (n + 1) * width]
        own, rows = np.frombuffer(self.flat, dtype=np.int32)[: n * width].reshape(n, width), out.reshape(n + 1, width)
        first = np.where(own[0] < 0, n * width, own[0] * width).astype(out.dtype) + base
        for lo in range(0, n, 4096):
            part = own[lo : lo + 4096]
            rows[lo : lo + len(part)] = np.where(part < 0, ~first, part.astype(out.dtype) * width + base)
        rows[n] = ~first
        return out


class SparseAutomaton:
    """The same automaton as sorted arrays of its transitions, for wide alphabets."""

    def __init__(self, symbols: list[int], width: int):
        follow: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in follow[p]:
                follow[p][c] = cur
                p = link[p]
            if p != -1:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and follow[p].get(c) == q:
                        follow[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.width = width
        pairs = sorted((state * width + c, to) for state, row in enumerate(follow) for c, to in row.items())
        self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.to = np.array([t for _, t in pairs], dtype=np.int64)
        self.root = len(follow)  # before the first symbol, and after one that the sample does not have
        self.first = np.full(width, self.root, dtype=np.int64)
        for c, to in follow[0].items():
            self.first[c] = to

    def phrases(self, steps: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Phrases of each column of steps, of which the first ``live[i]`` columns go on to row i."""
        state = np.full(steps.shape[1], self.root, dtype=np.int64)
        count = np.zeros(steps.shape[1], dtype=np.int64)
        for i, m in enumerate(live):
            symbol, at = steps[i, :m], state[:m]
            after = self.first[symbol]  # a new phrase
            known = np.flatnonzero((after != self.root) & (at != self.root))
            count[:m] += 1
            if len(known):
                key = at[known] * self.width + symbol[known]
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                goes_on = self.keys[spot] == key
                after[known[goes_on]] = self.to[spot[goes_on]]
                count[known[goes_on]] -= 1
            state[:m] = after
        return count


class CrossParser:
    """Automata of all languages, each over its own alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.samples = samples
        self.languages = sorted(samples)
        letters = sorted({c for text in samples.values() for c in set(text.lower()) if c.isalpha()})
        table = np.full(0x110000, SEPARATOR, dtype=np.int32)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
        table[[ord(c) for c in letters]] = np.arange(FIRST, FIRST + len(letters))
        self.symbols = table
        self.roots = list(range(len(self.languages)))
        self.local, self.sparse, dense = [], {}, []
        for k, lang in enumerate(self.languages):
            codes = self.codes(samples[lang])
            learned = codes[: max(1, len(codes) * 9 // 10)]
            own = np.unique(learned[learned >= FIRST])
            local = np.full(FIRST + len(letters), OTHER, dtype=np.int32)
            local[SEPARATOR] = SEPARATOR
            local[own] = np.arange(FIRST, FIRST + len(own))
            self.local.append(local)
            if FIRST + len(own) <= DENSE:
                dense.append((k, local[learned], FIRST + len(own)))
            else:
                self.sparse[k] = SparseAutomaton(local[learned].tolist(), FIRST + len(own))
        most = sum((2 * max(len(codes), 1) + 1) * width for _, codes, width in dense)
        every = np.empty(most, dtype=np.int32 if most < 1 << 31 else np.int64)  # all tables in one; what is not filled is never touched
        self.starts, base = {}, 0
        for k, codes, width in dense:
            base += len(SuffixAutomaton(codes.tolist(), width).table(every[base:], base))
            self.starts[k] = base - width
        self.tables = every[:base]
        rate = []
        for k, lang in enumerate(self.languages):
            codes = self.codes(samples[lang])
            own = codes[max(1, len(codes) * 9 // 10) :]
            phrases = self._parse([own], [k])[0, 0] if len(own) else 1
            rate.append(max(phrases, 1) / max(len(own), 1))
        self.rate = np.array(rate)

    def __reduce__(self):
        return CrossParser, (self.samples,)  # workers get the samples and build the automata themselves

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text, the same for all languages; runs of separators count once."""
        out = self.symbols[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if len(out):
            keep = np.ones(len(out), dtype=bool)
            keep[1:] = (out[1:] != SEPARATOR) | (out[:-1] != SEPARATOR)
            out = out[keep]
        return out

    def _parse(self, codes: list[np.ndarray], roots: list[int]) -> np.ndarray:
        """[text, language] number of phrases, of the languages numbered in ``roots``."""
        out = np.zeros((len(codes), len(roots)), dtype=np.int64)
        pieces = [(d, c[i : i + STRETCH]) for d, c in enumerate(codes) for i in range(0, len(c), STRETCH)]
        if not pieces:
            return out
        pieces.sort(key=lambda p: -len(p[1]))
        sizes = np.array([len(p) for _, p in pieces])
        doc = np.array([d for d, _ in pieces])
        steps = np.full((int(sizes[0]), len(pieces)), OTHER, dtype=np.int32)
        for j, (_, p) in enumerate(pieces):
            steps[: len(p), j] = p
        live = np.searchsorted(-sizes, -np.arange(len(steps)), side="left")
        tabled = [(at, k) for at, k in enumerate(roots) if k in self.starts]
        for lo in range(0, len(tabled), TOGETHER):
            some = tabled[lo : lo + TOGETHER]
            phrases = self._together(np.stack([self.local[k].astype(np.uint8)[steps] for _, k in some]), [self.starts[k] for _, k in some], live)
            for (at, _), own in zip(some, phrases, strict=True):
                out[:, at] = np.bincount(doc, own, len(codes))
        for at, k in enumerate(roots):
            if k in self.sparse:
                out[:, at] = np.bincount(doc, self.sparse[k].phrases(self.local[k][steps], live), len(codes))
        return out

    def _together(self, steps: np.ndarray, starts: list[int], live: np.ndarray) -> np.ndarray:
        """[language, piece] number of phrases by the tables, from [language, symbol, piece]."""
        kind, sign = self.tables.dtype, self.tables.dtype.itemsize * 8 - 1
        state = np.repeat(np.array(starts, dtype=kind)[:, None], steps.shape[2], axis=1)
        phrases = np.zeros(state.shape, dtype=kind)
        for i, m in enumerate(live):
            step = self.tables.take(state[:, :m] + steps[:, i, :m])
            new = step >> sign  # -1 where a phrase begins
            phrases[:, :m] -= new
            np.bitwise_xor(step, new, out=state[:, :m])
        return phrases

    def predict(self, texts: list[str | None], unlike: float | None = None) -> tuple[list[str], list[float]]:
        """Language and score of each text; with ``unlike``, texts that are in none of the languages are ``und`` too.

        For that the number of phrases counts less two of its roots, so that a short text is not turned away by chance.
        """
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        codes = [self.codes(t or "") for t in texts]
        some = [i for i, c in enumerate(codes) if (c >= OTHER).any()]
        if some:
            phrases = self._parse([codes[i] for i in some], self.roots)
            size = np.array([len(codes[i]) for i in some])
            need = phrases / size[:, None] / self.rate
            best = need.argmin(axis=1)
            order = np.sort(need, axis=1)
            second = order[:, 1] if need.shape[1] > 1 else order[:, 0] * 2
            score = second / (second + order[:, 0])
            least = phrases[np.arange(len(some)), best]
            far = np.zeros(len(some), dtype=bool) if unlike is None else (least - 2 * np.sqrt(least)) / size / self.rate[best] > unlike
            for i, b, s, out in zip(some, best.tolist(), score.tolist(), far.tolist(), strict=True):
                if not out:
                    langs[i], scores[i] = self.languages[b], float(s)
        return langs, scores


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = 60_000, sample_docs: int = 400, doc_chars: int = 3_000, languages: int = 200, all_chars: int = 1_000_000) -> CrossParser:
    """Fit on a bounded, documented sample of labelled rows: many texts of each language, none of which stands for it alone."""
    rows = docs.select(id_text(id_col).alias("_id"), F.substring(F.col(text_col).cast("string"), 1, doc_chars).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.filter("_lang is not null and _text is not null").withColumn("_key", F.xxhash64("_id"))
    # A histogram of keys per language gives a cut that leaves few rows; the window then sees only those.
    counts = {r[0]: r[1] for r in rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).collect()}
    if not counts:
        return CrossParser({})
    sample_chars = min(sample_chars, max(1, all_chars // len(counts)))
    rows = rows.filter(F.col("_lang").isin(*counts))
    cut = F.lit(1.0)
    for lang, n in counts.items():
        cut = F.when(F.col("_lang") == lang, F.lit(min(1.0, 4.0 * sample_docs / n))).otherwise(cut)
    spot = (F.col("_key") / F.lit(2.0**64)) + F.lit(0.5)
    few = rows.filter(spot <= cut).withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_key", "_id", "_text")))
    few = few.filter(F.col("_n") <= sample_docs)
    # Only as many characters as are used reach the driver.
    few = few.withColumn("_before", F.sum(F.length("_text")).over(Window.partitionBy("_lang").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)))
    few = few.filter(F.coalesce(F.col("_before"), F.lit(0)) < sample_chars)
    samples: dict[str, list[str]] = {}
    for lang, _, text in sorted((r["_lang"], r["_n"], r["_text"]) for r in few.collect()):
        samples.setdefault(lang, []).append(text)
    return CrossParser({lang: "\n".join(t)[:sample_chars] for lang, t in samples.items()})


def identify(docs: DataFrame, parser: CrossParser, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, lang_pred, score) for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded: sample_chars per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                langs, scores = shared.value.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = learn(docs.filter(fold(parts=4) != 2))
    held = fold(parts=4) == 2
    return identify(docs, parser).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def filter_languages(docs: DataFrame, accepted: tuple[str, ...] | None = None, *, text_col: str = "text", unlike: float = UNLIKE) -> DataFrame:
    """The documents whose predicted language is accepted (by default any that can be learned); columns stay as they are.

    A text without a letter, or unlike all learned languages, has no language and is rejected.  Where nothing can be
    learned and no language is named, all documents stay.
    """
    parser = learn(docs)
    if accepted is None and not parser.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                langs, _ = shared.value.predict(part.column(at).to_pylist(), unlike)
                yield part.filter(pa.array([x != "und" if accepted is None else x in accepted for x in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op8_langid": op8_langid}
SQL: dict[str, str] = {}
