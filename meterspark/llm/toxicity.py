"""Toxicity scores from a lexicon that tolerates misspelling.

The lexicon is learned from labelled rows: words that toxic documents hold far
more often than others, and stems (prefixes) under which several such words
gather. A stem stands for words never seen and is matched without edits; the
learned words below it stay terms with theirs. All of them form a trie. The Levenshtein automaton of a term accepts
whatever is within one edit of it (two for long terms); running the
automata of all terms along the trie at once gives a deterministic automaton,
which is built state by state as words are read and remembered.

A hit counts by its context window: it weighs less inside quotation marks or
behind a verb of reporting, and more where it is addressed to someone or stands
among other hits. Sums over the windows are the features of a logistic
regression, fitted on the labelled rows that are not held out.

Scale: the lexicon is learned from at most ``LEXICON_ROWS`` labelled documents that
are not held out, chosen by hash, and has at most ``MAX_TERMS`` terms; the regression is
fitted on the first ``TRAIN_ROWS`` of them. Their ids are broadcast, so no text is
shuffled. Scoring is one pass over each document; a worker's word cache and automaton are bounded.
"""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.common import cut, read, rows_of

LEXICON_ROWS = 20_000       # labelled documents that the lexicon is learned from, the first by hash
TRAIN_ROWS = 6000           # the first of these, that the regression is fitted on
MAX_TERMS = 2000
MIN_TOXIC = 4               # toxic documents that hold a term
MIN_SHARE = 0.0005          # part of all toxic documents that hold it
MIN_STEM_WORDS = 4          # words of toxic documents under a stem
MIN_LIFT = 15.0             # how much more often toxic documents hold a term
STEMS = range(3, 9)
ONE_EDIT, TWO_EDITS = 5, 9  # letters from which a term may differ by so many edits
WINDOW = 10
KNOWN_WORDS = 800_000
KNOWN_LETTERS = 64          # longer words are looked up again each time
KNOWN_STATES = 100_000
THRESHOLD = 0.7

TOKEN = re.compile(r"\w+")
QUOTES = re.compile("[\"“”«»„]")
REPORTING = frozenset("said says say told called calls wrote quoted quote quotes sagte schrieb zitierte dit écrit citation dijo escribió citó".split())
ADDRESS = frozenset("you your youre u du dich dein ihr euch tu toi te vous votre tú usted ustedes tus".split())
FEATURES = 8


class Lexicon:
    """Terms as (text, is_stem, weight), and the automaton over their trie."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]      # weight of the term that ends at a node
        self.stem: list[float] = [0.0]
        self.edits: list[int] = [0]         # edits allowed for the words below a node
        self.depth: list[int] = [0]
        for text, is_stem, weight in terms:
            allowed = 0 if is_stem else (len(text) >= ONE_EDIT) + (len(text) >= TWO_EDITS)
            node, path = 0, [0]
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
                    self.edits.append(0)
                    self.depth.append(self.depth[node] + 1)
                node = self.next[node][c]
                path.append(node)
            (self.stem if is_stem else self.word)[node] = weight
            for n in path:
                self.edits[n] = max(self.edits[n], allowed)
        self.terms = [(text, 0 if is_stem else (len(text) >= ONE_EDIT) + (len(text) >= TWO_EDITS), is_stem) for text, is_stem, _ in terms]
        self.pieces: dict[int, list[tuple[int, int, int, int, frozenset]]] = {}
        self.most = KNOWN_STATES + max(self.depth)      # no word alone needs more states than the depth
        self._reset()
        self.known: dict[str, tuple[float, bool]] = {}      # words looked up before: those with a term
        self.missed: set[str] = set()                       # and those without

    # A state is (node, edits); (~node, 0) is a word that went past the stem at the node.

    def _reset(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.settled: list[bool] = []       # no more letters can change the outcome
        self.numbers: dict[frozenset, int] = {}
        self._number(self._close({(0, 0)}))

    def _close(self, states: set) -> frozenset:
        """With what can be reached by leaving out letters of a term."""
        todo, out = list(states), set(states)
        while todo:
            node, edits = todo.pop()
            if node < 0:
                continue
            for below in self.next[node].values():
                if edits < self.edits[below] and (below, edits + 1) not in out:
                    out.add((below, edits + 1))
                    todo.append((below, edits + 1))
        return frozenset(out)

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.settled.append(all(node < 0 for node, _ in states))
            self.moves.append({})
        return self.numbers[states]

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, edits in states:
            if node < 0:
                out.add((node, 0))
                continue
            if self.stem[node] and not edits:
                out.add((~node, 0))                             # a stem goes on with any letters
            for letter, below in self.next[node].items():
                if letter == c:
                    out.add((below, edits))
                elif edits < self.edits[below]:
                    out.add((below, edits + 1))                     # another letter
            if edits < self.edits[node]:
                out.add((node, edits + 1))                          # a letter too many
        return self._close(out)

    def _pieces_for(self, size: int) -> list[tuple[int, int, int, int, frozenset]]:
        """What a word of that size must hold to be within the edits of a term: places
        of two pieces, and the terms' letters there.

        Of a term in quarters, one edit spares three and two spare two at least. Pieces
        before all edits keep their distance from the word's start, those
        behind all edits that from its end, and those between two edits are moved by one place at most."""
        wanted: dict[tuple[int, int, int, int], set[str]] = {}

        def want(a: int, one: str, b: int = 0, two: str = "") -> None:
            if a >= 0 and b >= 0:
                wanted.setdefault((a, a + len(one), b, b + len(two)), set()).add(one + two)
        for text, edits, is_stem in self.terms:
            n = len(text)
            q, h, r = n // 4, n // 2, 3 * n // 4
            more = size - n
            if is_stem or not edits:
                if n <= size if is_stem else n == size:
                    want(0, text)
            elif abs(more) > edits:
                continue
            elif edits == 1:
                want(0, text[:r])
                want(0, text[:h], r + more, text[r:])
                want(0, text[:q], h + more, text[h:])
                want(q + more, text[q:])
            else:
                want(0, text[:h])
                want(h + more, text[h:])
                want(0, text[:q], r + more, text[r:])
                for moved in (-1, 0, 1):
                    want(0, text[:q], h + moved, text[h:r])
                    want(q + moved, text[q:h], r + more, text[r:])
                    want(q + moved, text[q:r])
        return [(*places, frozenset(pieces)) for places, pieces in wanted.items()]

    def may_hit(self, word: str) -> bool:
        """False for most words that have no term; the automaton decides on the others."""
        if len(word) not in self.pieces:
            if len(self.pieces) > KNOWN_LETTERS:
                self.pieces.clear()
            self.pieces[len(word)] = self._pieces_for(len(word))
        for a, b, c, d, pieces in self.pieces[len(word)]:
            if word[a:b] + word[c:d] in pieces:
                return True
        return False

    def find(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of the best term for the word, or None."""
        state = 0
        for c in word:
            move = self.moves[state]
            if c not in move:
                if len(self.sets) > self.most:
                    self._reset()
                    return self.find(word)
                move[c] = self._number(self._step(self.sets[state], c))
            state = move[c]
            if self.settled[state]:
                break
        best = None
        for node, edits in self.sets[state]:
            past = node < 0
            node = ~node if past else node
            allowed = (self.depth[node] >= ONE_EDIT) + (self.depth[node] >= TWO_EDITS)
            weight = max(self.word[node] if edits <= allowed and not past else 0.0, self.stem[node] if not edits else 0.0)
            if weight and (best is None or (not edits, weight) > (best[1], best[0])):
                best = (weight, not edits)
        return best

    def look_up(self, words: list[str]) -> list[tuple[int, float, bool]]:
        """(place, weight, exact) of the hits. Distinct words are looked up; places are worked out where there are hits."""
        if len(self.missed) + len(self.known) > KNOWN_WORDS:
            self.missed.clear()
            self.known.clear()
        found = {}
        for word in set(words) - self.missed:
            hit = self.known.get(word) or (self.find(word) if self.may_hit(word) else None)
            if hit:
                found[word] = hit
            if len(word) <= KNOWN_LETTERS:
                if hit:
                    self.known[word] = hit
                else:
                    self.missed.add(word)
        return [(i, *found[word]) for i, word in enumerate(words) if word in found] if found else []

    def features(self, text: str) -> list[float]:
        """The features of a whole text; all zero where nothing hits."""
        low = text.lower()
        words = TOKEN.findall(low)
        hits = self.look_up(words)
        if not hits:
            return [0.0] * FEATURES
        quotes = [m.start() for m in QUOTES.finditer(low)]
        starts = [m.start() for m in TOKEN.finditer(low)] if quotes else [0] * len(words)      # only to compare with quotation marks
        marks = np.searchsorted(quotes, [starts[i] for i, _, _ in hits])
        places = np.array([h[0] for h in hits])
        near = np.searchsorted(places, places + WINDOW, "right") - np.searchsorted(places, places - WINDOW) - 1
        total = top = quoted = 0.0
        for (i, weight, exact), before, company in zip(hits, marks, near):
            window = words[max(0, i - WINDOW):i + WINDOW + 1]
            inside = before % 2 == 1 and before < len(quotes) and starts[i] - quotes[before - 1] <= 12 * WINDOW
            told = not REPORTING.isdisjoint(words[max(0, i - 5):i])
            factor = (0.3 if inside else 1.0) * (0.6 if told else 1.0) * (1.0 if ADDRESS.isdisjoint(window) else 1.3) * (1 + 0.5 * min(company, 3))
            total += weight * factor * (1.0 if exact else 0.6)
            top = max(top, weight * factor)
            quoted += inside
        exact = sum(h[2] for h in hits)
        return [1.0, math.log1p(exact), math.log1p(len(hits) - exact), math.log1p(total), math.log1p(top), 100.0 * len(hits) / len(words) / 4,
                quoted / len(hits), math.log1p(len(words)) / 8]


def _term_batches(batches):
    """How many toxic and clean training documents hold each word and each stem, for a few documents at a time."""
    for batch in batches:
        for part in rows_of(batch, 64):
            counts = {True: {}, False: {}}
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = set(TOKEN.findall((text or "").lower()))
                for is_stem, own in ((False, words), (True, {w[:k] for w in words for k in STEMS if k < len(w)})):
                    held = counts[is_stem]
                    for term in own:
                        t, c = held.get(term, (0, 0))
                        held[term] = (t + label, c + 1 - label)
            for is_stem, held in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([is_stem] * len(held), pa.bool_()), pa.array([t for t, _ in held.values()], pa.int64()), pa.array([c for _, c in held.values()], pa.int64())],
                                                 ["term", "is_stem", "t", "c"])


def _shorter():
    """The stems that a term is longer than."""
    return F.explode(F.array_compact(F.array(*[F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEMS])))


def learn_lexicon(train: DataFrame) -> list[tuple[str, bool, float]]:
    """Terms from training rows (toxic, text), the shortest stem for longer
    ones; at most MAX_TERMS by support, which is the number of toxic documents.
    Words below a stem stay terms, so that they are found with edits too."""
    n = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, clean = max(1, n[0]), max(1, n[1] - n[0])
    seen = train.mapInArrow(_term_batches, "term string, is_stem boolean, t bigint, c bigint")
    counts = cut(seen.groupBy("term", "is_stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t > 0"))
    words = counts.filter(~F.col("is_stem")).select(_shorter().alias("term")).groupBy("term").agg(F.count("*").alias("words")).withColumn("is_stem", F.lit(True))
    lift = (F.col("t") / toxic) / ((F.col("c") + 0.5) / clean)
    good = cut(counts.withColumn("lift", lift).filter((F.col("t") >= max(MIN_TOXIC, MIN_SHARE * toxic)) & (F.col("lift") >= MIN_LIFT)).join(words, ["term", "is_stem"], "left")
               .filter(~F.col("is_stem") | (F.col("words") >= MIN_STEM_WORDS)))
    stems = good.filter("is_stem").select("term")
    nested = stems.select("term", _shorter().alias("shorter")).join(stems.withColumnRenamed("term", "shorter"), "shorter").select("term", F.lit(True).alias("is_stem")).distinct()
    terms = good.join(nested, ["term", "is_stem"], "left_anti").orderBy(F.desc("t"), "is_stem", "term").limit(MAX_TERMS).collect()
    return [(r["term"], r["is_stem"], math.log(r["lift"])) for r in terms]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights (the constant first) by Newton steps; a row counts ``times`` times."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (times * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (times * (y - p)) - ridge * w)
    return w


_LAST: dict[tuple, Lexicon] = {}


def shared_lexicon(terms: list[tuple[str, bool, float]]) -> Lexicon:
    """The lexicon of these terms, with what it remembers, for all tasks of a worker; one at a time."""
    key = tuple(terms)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Lexicon(terms)
    return _LAST[key]


def _feature_batches(terms, batches):
    lexicon = shared_lexicon(terms.value)
    for batch in batches:
        for part in rows_of(batch):
            found = [lexicon.features(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], ["key", "features"])


def _score_batches(terms, weights, batches):
    for batch in _feature_batches(terms, batches):
        if batch.num_rows:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))], ["doc_id", "score"])


def fold():
    """crc32 of doc_id as text, modulo 3; 1 is held out. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, lexicon_rows: int = LEXICON_ROWS) -> tuple[list, np.ndarray]:
    """(lexicon terms, weights) from labelled documents that are not held out:
    the terms from the first ``lexicon_rows`` by hash, the weights from the
    first ``train_rows``. Without any toxic or any clean one there is no lexicon and every
    score is 0."""
    usable = (labels.filter((fold() != 1) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))

    def first(n: int) -> DataFrame:
        return F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n))            # bounded by n
    own = docs.select("doc_id", "text").filter((fold() != 1) & F.col("doc_id").isNotNull())
    sample = cut(own.join(first(max(train_rows, lexicon_rows)), "doc_id"))
    terms = learn_lexicon(sample.join(first(lexicon_rows).select("doc_id"), "doc_id", "left_semi").select("toxic", "text"))
    rows = sample.join(first(train_rows).select("doc_id"), "doc_id", "left_semi").select("toxic", "text")
    found = rows.mapInArrow(partial(_feature_batches, docs.sparkSession.sparkContext.broadcast(terms)), "key int, features array<double>")
    sample = found.groupBy("key", "features").count().collect()                        # repeated rows come once, with their number
    y = np.array([r["key"] for r in sample], np.float64)
    if not terms or y.min(initial=1) == y.max(initial=0):
        return [], np.array([-30.0] + [0.0] * FEATURES)
    return terms, fit_logistic(np.array([r["features"] for r in sample]), y, times=np.array([r["count"] for r in sample], np.float64))


def score_toxicity(docs: DataFrame, model: tuple[list, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted for each input row.

    Only the text is scored; null and empty texts score as texts without a
    hit. Repeated rows and null doc_ids come out as they came in; an empty
    table gives no rows. Other columns are ignored."""
    terms, weights = model
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    scored = rows.mapInArrow(partial(_score_batches, docs.sparkSession.sparkContext.broadcast(terms), weights), "doc_id bigint, score double")
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
