"""Toxicity: a learnt lexicon, Levenshtein automata over its trie, and context windows that tell quotation from abuse.

Training reads at most ``max_toxic`` and ``max_clean`` labelled rows (the first by a hash of the id, never held-out
ones), and of each group of near-copies among them one. Terms are whole words or stems (word beginnings) whose documents are toxic far more often than chance; their
counts are made by the executors, only terms and hits reach the driver. A word is matched by running it through the
lexicon's trie and the Levenshtein automaton of each term at once: a state is a set of (trie node, edits so far),
states and their transitions are made once and kept. Words of 5 letters may differ by one edit, of 9 by two; each
(term, edits) pair has its own weight, learnt from the labelled rows, so a spelling that clean documents share with
a term counts for nothing. Each hit has a context: addressed (near a word for the reader), quoted (between two
quotation marks of a line, near a reporting verb, or right after a naming noun), both of them, or plain. What a hit in a context is worth is learnt as well: how
telling such hits are among the labelled rows against plain ones, starting from a documented prior. A logistic curve
over a document's hits, fitted on the same rows, gives the score.

Defined results: a null or empty text has no hits and gets the score of a text without hits; without toxic labels the
lexicon is empty and every score is the share of toxic labels (at most 0.49); null, repeated and unknown labels are
ignored or merged; whole texts are read; repeated rows are scored alike; only the named columns are read; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice, takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import held_out, labelled_texts
from .simhash import fingerprints, gray_rank, local_roots, near_pairs

#: A word: letters and digits, with symbols that stand in for letters only between two of them.
WORD = re.compile(r"\w(?:[\w@*$!]*\w)?")
STEMS = range(4, 9)
WINDOW = 8
#: Fixed word lists of the context windows.
REPORTING = frozenset("said says called calls wrote quote quoted dit disait sagte sagt zitat dijo dice".split())
#: Nouns that name a term only right before it, as in "the word ...".
NAMING = frozenset("word words term mot mots wort begriff palabra".split())
ADDRESS = frozenset("you your youre yourself u ur tu toi vous votre du dich dein ihr euch tú usted ustedes te".split())
#: Spans between two quotation marks of one line.
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’(?!\w)|(?<!\w)'[^'\n]*'(?!\w)")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Terms as a trie, and the deterministic product of the trie with every term's Levenshtein automaton.

    A term that ends in ``*`` is a stem: it matches as soon as the word's beginning does.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.most: list[int] = [0]
        for k, term in enumerate(terms):
            text, node, most = term.rstrip("*"), 0, edits_allowed(term.rstrip("*"))
            self.most[0] = max(self.most[0], most)
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], most)
            (self.stem_at if term.endswith("*") else self.word_at)[node] = k
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.best_stem: list[tuple[int, int] | None] = []
        self.best_word: list[tuple[int, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        """The number of the state with these nodes and edits, letters left out of the word included."""
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.most[child] and edits + 1 < nodes.get(child, 9):
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            for found, at in ((self.best_stem, self.stem_at), (self.best_word, self.word_at)):
                found.append(min(((e, at[n]) for n, e in nodes.items() if n in at and e <= edits_allowed(self.terms[at[n]].rstrip("*"))), default=None))
        return self.states[key]

    def step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            if edits + 1 <= self.most[node]:
                out[node] = min(out.get(node, 9), edits + 1)
            for letter, child in self.children[node].items():
                cost = edits + (letter != ch)
                if cost <= self.most[child] and cost < out.get(child, 9):
                    out[child] = cost
        to = self.state(out) if out else -1
        self.moves[state][ch] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the closest term, or None."""
        state, stem = self.start, None
        for ch in word:
            to = self.moves[state].get(ch)
            if to is None:
                to = self.step(state, ch)
            state = to
            if state < 0:
                return stem
            found = self.best_stem[state]
            if found and (stem is None or found < stem):
                stem = found
        whole = self.best_word[state]
        return min(stem, whole) if stem and whole else stem or whole


class Matcher:
    """Hits of whole texts; words already seen are kept, at most ``room`` of them."""

    def __init__(self, terms: list[str], room: int = 400_000, state_room: int = 60_000):
        self.terms, self.room, self.state_room = terms, room, state_room
        self.automaton = LexiconAutomaton(terms)
        self.clean: set[str] = set()
        self.hot: dict[str, tuple[int, int]] = {}

    def hits(self, text: str | None) -> Counter:
        """Counts of (term number, edits, context): context 0 plain, 1 quoted or reported, 2 addressed, 3 both between quotation
        marks and addressed (someone's words to someone else).

        A text with hits also has its number of words, under (-1, 0, 0).
        """
        out: Counter = Counter()
        if not text or not self.terms:
            return out
        lower = text.lower()
        words = set(WORD.findall(lower))
        if len(self.automaton.sets) > self.state_room:
            self.automaton = LexiconAutomaton(self.terms)
        found: dict[str, tuple[int, int]] = {}
        for word in words - self.clean:
            hit = self.hot.get(word) or self.automaton.match(word)
            if hit:
                found[word] = hit
                if len(self.hot) < self.room:
                    self.hot[word] = hit
            elif len(self.clean) < self.room:
                self.clean.add(word)
        if found:
            spans = [m.span() for m in WORD.finditer(lower)]
            said = [lower[a:b] for a, b in spans]
            out[(-1, 0, 0)] = len(said)
            quotes = [m.span() for m in QUOTED.finditer(lower)]
            opened = [a for a, _ in quotes]
            for k, word in enumerate(said):
                if word in found:
                    edits, term = found[word]
                    near = said[max(0, k - WINDOW):k] + said[k + 1:k + 1 + WINDOW]
                    span = bisect_left(opened, spans[k][0]) - 1
                    marked, addressed = span >= 0 and spans[k][1] <= quotes[span][1], not ADDRESS.isdisjoint(near)
                    reported = not REPORTING.isdisjoint(near) or not NAMING.isdisjoint(said[max(0, k - 2):k])
                    out[(term, edits, 3 if marked and addressed else 2 if addressed else 1 if marked or reported else 0)] += 1
        return out


#: Prior worth of a hit by context (plain, quoted, addressed, quoted and addressed), and how many labelled rows it counts for.
CONTEXT_PRIOR, PRIOR_ROWS = (1.0, 0.3, 1.25, 0.3), 20


@dataclass
class ToxicModel:
    """Terms, a weight for each (term, edits), and the logistic curve over a document's facts."""

    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    contexts: tuple[float, ...] = CONTEXT_PRIOR
    curve: list[float] = field(default_factory=lambda: [0.0] * 6)

    def facts(self, hits: Counter | dict) -> list[float]:
        exact = fuzzy = total = 0.0
        kinds = set()
        for (term, edits, context), n in hits.items():
            if term < 0:
                continue
            worth = self.weights.get((term, edits), 0.0) * self.contexts[context] * (1 + math.log(n))
            if worth > 0:
                kinds.add(term)
                total += n * self.contexts[context]
                if edits:
                    fuzzy += worth
                else:
                    exact += worth
        density = 100 * total / max(1, hits.get((-1, 0, 0), 0))
        return [1.0, min(exact, 20) / 5, min(fuzzy, 20) / 5, min(len(kinds), 5) / 2, math.log1p(total), math.log1p(density)]

    def score(self, hits: Counter | dict) -> float:
        at = sum(a * b for a, b in zip(self.curve, self.facts(hits), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))


def word_terms(text: str | None) -> set[str]:
    """The words of a text, and the stems that two of its words or more begin with (repeats count)."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += n
    return {w for w in words if 3 <= len(w) <= 24} | {s + "*" for s, n in stems.items() if n > 1}


def counted_terms(rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(term, n): documents with each term, summed within a partition before the shuffle."""
    wanted = set(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.update(word_terms(text) if wanted is None else wanted & word_terms(text))
        if tally:
            yield pa.RecordBatch.from_arrays([pa.array(list(tally)), pa.array(list(tally.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def evidence(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Log likelihood ratio for a term that is commoner in toxic documents; 0 if it is not."""
    n, share = toxic + clean, n_toxic / (n_toxic + n_clean)
    if n == 0 or toxic / n <= share:
        return 0.0
    return toxic * math.log(toxic / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0.0)


def log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def one_vote(rows: DataFrame) -> DataFrame:
    """The labelled rows, one of each group of near-copies in a class: copies would make all words of their text telling."""
    marked = rows.withColumn("digest", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    each = fingerprints(marked.select(F.struct("y", "digest").alias("doc_id"), "text")).select("doc_id.*", "fp").distinct().collect()  # bounded as the labels are
    chosen = []
    for y in (0, 1):
        mine = [(r["digest"], r["fp"]) for r in each if r["y"] == y]
        fps, where = np.unique(np.array([fp for _, fp in mine], np.int64).view(np.uint64), return_inverse=True)
        root, votes = local_roots(len(fps), linked(fps)), {}
        for (digest, _), k in zip(mine, where.tolist(), strict=True):
            votes[root[k]] = min(digest, votes.get(root[k], digest))
        chosen += [(y, digest) for digest in votes.values()]
    voters = rows.sparkSession.createDataFrame(chosen, "y int, digest string")
    return marked.join(F.broadcast(voters), ["y", "digest"], "left_semi").dropDuplicates(["y", "digest"]).select(*rows.columns)


def linked(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct fingerprints at few differing bits."""
    order = np.argsort(gray_rank(fps), kind="stable")
    for i, j in near_pairs(fps[order]):
        yield order[i], order[j]


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: float) -> list[str]:
    """Terms with enough evidence of their own; of nested terms, the longest that keeps nearly all documents of a shorter one."""
    good = {t: n for t, n in toxic.items()
            if evidence(n, clean.get(t, 0), n_toxic, n_clean) >= least and log_odds(n, clean.get(t, 0), n_toxic, n_clean) >= 2.5}
    names = sorted(good)
    chosen: list[str] = []
    covered: set[str] = set()
    for term in sorted(good, key=lambda t: (len(t.rstrip("*")), t)):
        text = term.rstrip("*")
        if any(text[:k] + "*" in covered for k in range(4, len(text) + 1)):
            continue
        best = term
        if term.endswith("*"):
            nested = takewhile(lambda t: t.startswith(text), islice(names, bisect_left(names, text), None))
            longer = [t for t in nested if t != term and good[t] >= 0.95 * good[term]]
            best = max(longer, key=lambda t: (len(t.rstrip("*")), not t.endswith("*")), default=term)
            covered.add(term)
        chosen.append(best)
    return sorted(set(chosen), key=lambda t: (-good[t], t))


def fit_curve(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> list[float]:
    """Logistic regression by Newton steps, with a small penalty."""
    w, n = np.zeros(x.shape[1]), len(y)
    penalty = np.diag([1e-6] + [l2] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / n + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + penalty + 1e-9 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          max_toxic: int = 3000, max_clean: int = 12_000, least: float = 8.0) -> ToxicModel:
    """Lexicon, weights and curve from the labelled rows of ``docs``, one of each group of near-copies."""
    given = labelled_texts(docs, labels, label, id_col, text_col, max_clean, max_toxic).persist()
    rows = one_vote(given).persist()
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    given.unpersist()
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        rows.unpersist()
        rate = min(0.49, max(0.01, n_toxic / max(1, n_toxic + n_clean)))
        return ToxicModel(curve=[math.log(rate / (1 - rate))] + [0.0] * 5)
    try:
        # terms in fewer documents have too little evidence even if no clean document has them
        fewest = math.ceil(least / math.log((n_toxic + n_clean) / n_toxic) - 1e-9)
        toxic = {r["term"]: r["n"] for r in counted_terms(rows.filter("y = 1")).filter(F.col("n") >= fewest).toLocalIterator()}
        clean = {r["term"]: r["n"] for r in counted_terms(rows.filter("y = 0"), list(toxic)).toLocalIterator()}
        terms = choose_terms(toxic, clean, n_toxic, n_clean, least)
        hits = document_hits(rows, terms).toPandas()
    finally:
        rows.unpersist()
    model = ToxicModel(terms)
    model.weights = fitted_weights(terms, hits, n_toxic, n_clean)
    model.contexts = fitted_contexts(model.weights, hits, n_toxic, n_clean)
    x = np.array([model.facts({(t, e, c): n for t, e, c, n in h}) for h in hits["hits"]])
    model.curve = fit_curve(x, hits["y"].to_numpy().astype(float))
    return model


def document_hits(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(y, hits) of each labelled row; a hit is [term number, edits, context, count]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            hits = [[[*k, n] for k, n in sorted(matcher.hits(t).items())] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(hits, pa.list_(pa.list_(pa.int32())))], names=["y", "hits"])

    return rows.select("text", "y").mapInArrow(run, "y int, hits array<array<int>>")


def fitted_weights(terms: list[str], hits: pd.DataFrame, n_toxic: int, n_clean: int) -> dict[tuple[int, int], float]:
    """Log odds of each (term, edits): nothing where clean documents have the spelling too often; a part of the exact
    weight for spellings that no labelled row has."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for y, row in zip(hits["y"], hits["hits"], strict=True):
        seen[y].update({(int(t), int(e)) for t, e, _, _ in row if t >= 0})
    out = {}
    for k, term in enumerate(terms):
        exact = log_odds(seen[1][(k, 0)], seen[0][(k, 0)], n_toxic, n_clean)
        for edits in range(edits_allowed(term.rstrip("*")) + 1):
            toxic, clean = seen[1][(k, edits)], seen[0][(k, edits)]
            if edits == 0 or evidence(toxic, clean, n_toxic, n_clean) >= 3:
                weight = log_odds(toxic, clean, n_toxic, n_clean)
            else:
                weight = 0.0 if clean else exact * (0.7 if edits == 1 else 0.5)
            if weight > 0:
                out[(k, edits)] = weight
    return out


def fitted_contexts(weights: dict[tuple[int, int], float], hits: pd.DataFrame, n_toxic: int, n_clean: int) -> tuple[float, ...]:
    """Worth of a hit by context: the log odds of rows whose hits all have it, as a share of those of plain ones (0 to 2),
    averaged with the prior by the number of such rows; plain hits are worth 1."""
    seen = {0: Counter(), 1: Counter()}
    for y, row in zip(hits["y"], hits["hits"], strict=True):
        found = {int(c) for t, e, c, _ in row if t >= 0 and (int(t), int(e)) in weights}
        if len(found) == 1:
            seen[y].update(found)
    plain = log_odds(seen[1][0], seen[0][0], n_toxic, n_clean)
    out = [1.0]
    for c in range(1, len(CONTEXT_PRIOR)):
        rows = seen[1][c] + seen[0][c] if plain > 0 else 0
        share = min(2.0, max(0.0, log_odds(seen[1][c], seen[0][c], n_toxic, n_clean) / plain)) if plain > 0 else 0.0
        out.append((PRIOR_ROWS * CONTEXT_PRIOR[c] + rows * share) / (PRIOR_ROWS + rows))
    return tuple(out)


def score_column(model: ToxicModel, text: Column) -> Column:
    """The toxicity of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.terms)
        for texts in batches:
            yield pd.Series([model.score(matcher.hits(t)) for t in texts], dtype=float)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns.

    Null and empty texts have no hits and stay unless most labels are toxic; a null or repeated id doesn't matter, each row
    is judged by its own text; an empty table gives an empty table.
    """
    model = train(docs, labels)
    return docs.filter(score_column(model, F.col("text")) < 0.5)
