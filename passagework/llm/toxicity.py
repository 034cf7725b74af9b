"""Toxicity by a lexicon that is learned, matched by Levenshtein automata, and weighed by its context.

Lexicon. A word is a term if it stands in toxic labelled texts ODDS times as often as in clean ones, and if chance doesn't
explain it: of the words so chosen, at most a share of FALSE would be expected without any connection (Benjamini and
Hochberg's rule on Chernoff's bound of the binomial tail). Evidence is counted in distinct contexts (the neighbouring words),
because copies of a text are one piece of evidence and not many. A term's weight is its log-odds.

Matching. The Levenshtein automata of all terms (no edit for short terms, one for longer, two for long ones; a swap of
neighbours is an edit) are intersected with the lexicon's trie into one deterministic automaton, whose states are made when
a text first asks for them. A word costs a step a letter, and most leave the automaton after three or four. Words of clean
labelled texts that lie near a term are no misspellings, and exempt.

Context. A match inside quotation marks, or after a word of reporting, within WINDOW characters counts as quoted. The
score is a ridge logistic regression on the weights and the number of the matches and on the weights of quoted ones; it is fitted on texts whose
words the lexicon in use for them hasn't seen (two halves take turns), so that it doesn't flatter itself.

The fit reads a bounded sample: SAMPLE labelled ids and MAX_BYTES of text, a class and half, by md5 of the id; scoring covers
every whole text. Labels, language, source and id are never inputs of a score.

Nulls and empty texts have no match and score as clean. Repeated rows get equal scores. Without labels the score is 0.5;
with one class only, that class's share. Of conflicting labels of an id toxic wins. An empty table gives an empty result.
Further columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, table, whole
from .quality import calibrate, fold

#: The labelled sample's bounds in each half: rows and bytes of clean and of toxic texts.
SAMPLE, MAX_BYTES = (6_000, 2_000), (12 << 20, 8 << 20)
#: A word: letters, and what stands for letters inside it.
WORD = re.compile(r"[^\W\d_]+(?:['’*@$0-9][^\W\d_]+)*")
#: The same words for Spark.
JVM_WORD = r"(\p{L}+(?:['’*@$0-9]\p{L}+)*)"
#: What a word needs to be a term: odds, the share of false terms, and toxic contexts.
ODDS, FALSE, LEAST_CONTEXTS = 20.0, 0.01, 2
#: A word's prior, in contexts of either class.
PRIOR = 0.5
#: The shortest terms that may be misspelled by one and by two edits.
ONE_EDIT, TWO_EDITS = 5, 12
#: Characters on either side of a match that are its context.
WINDOW = 80
#: States that an automaton keeps; beyond, it starts anew.
MOST_STATES = 200_000
#: Longer texts are cut at white space into blocks of about so many characters, for matching.
TEXT_BLOCK = 1 << 20

#: Opening and closing quotation marks.
QUOTES = (('"', '"'), ("«", "»"), ("»", "«"), ("“", "”"), ("„", "“"), ("‚", "‘"), ("‘", "’"), ("‹", "›"))
#: Words of reporting, in the tables' languages; fixed values.
REPORTING = re.compile(
    r"\b(?:said|says|wrote|writes|called|calls|quote|quoted|word|words|term|slur|insult|sagte|schrieb|nannte|zitat|wort|dit|écrit|appelé|citation|mot|dijo|escribió|llamó|cita|palabra)\b[^.!?]{0,20}$",
    re.IGNORECASE,
)


def edits_for(term: str) -> int:
    """How many edits a term's misspellings may have."""
    return (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)


class Automaton:
    """The Levenshtein automata of a lexicon's terms, intersected with its trie; deterministic, made as it is asked.

    A state is a set of positions: a node of the trie, the edits so far, and, halfway through a swap, the letter that is
    still to come. `match` gives the nearest term and its edits, or None.
    """

    def __init__(self, terms: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.most: list[int] = [0]  # edits that some term below a node allows
        self.weights = terms
        for term in sorted(terms):
            node = 0
            for letter in term:
                self.most[node] = max(self.most[node], edits_for(term))
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][letter]
            self.most[node] = max(self.most[node], edits_for(term))
            self.ends[node] = term
        self._forget()

    def _forget(self) -> None:
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepted: list[tuple[str, int] | None] = []
        self.start = self._number(self._closed({(0, 0, "")}))

    def _closed(self, positions: set[tuple[int, int, str]]) -> frozenset:
        """With the positions that leaving out letters of a term leads to; dominated ones go."""
        least: dict[tuple[int, str], int] = {}
        waiting = list(positions)
        while waiting:
            node, edits, swap = waiting.pop()
            if edits > self.most[node] or least.get((node, swap), 9) <= edits:
                continue
            least[node, swap] = edits
            if not swap:
                waiting.extend((child, edits + 1, "") for child in self.children[node].values())
        return frozenset((node, edits, swap) for (node, swap), edits in least.items())

    def _number(self, state: frozenset) -> int:
        """A state's number; the empty one's is -1."""
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            ends = [(edits, -self.weights[self.ends[node]], self.ends[node]) for node, edits, swap in state if not swap and self.ends[node] is not None and edits <= edits_for(self.ends[node])]
            best = min(ends, default=None)
            self.accepted.append(None if best is None else (best[2], best[0]))
        return self.numbers[state]

    def _step(self, number: int, letter: str) -> int:
        after: set[tuple[int, int, str]] = set()
        for node, edits, swap in self.states[number]:
            children = self.children[node]
            if swap:  # the letter that was jumped over
                if letter == swap:
                    after.add((node, edits, ""))
                continue
            if letter in children:
                after.add((children[letter], edits, ""))
            if edits < self.most[node]:
                after.add((node, edits + 1, ""))  # one letter too many
                for other, child in children.items():
                    if other != letter:
                        after.add((child, edits + 1, ""))  # another letter
                        if letter in self.children[child]:  # swapped with the next one
                            after.add((self.children[child][letter], edits + 1, other))
        return self._number(self._closed(after))

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.states) > MOST_STATES:
            self._forget()
        at, steps = self.start, self.steps
        for letter in word:
            after = steps[at].get(letter)
            if after is None:
                after = steps[at][letter] = self._step(at, letter)
            if after < 0:
                return None
            at = after
        return self.accepted[at]


@dataclass
class Lexicon:
    """Terms with their weights, and near words that are no misspellings."""

    terms: dict[str, float]
    exempt: frozenset[str] = frozenset()
    automaton: Automaton | None = field(default=None, repr=False)

    def __getstate__(self) -> tuple:
        return self.terms, self.exempt

    def __setstate__(self, state: tuple) -> None:
        self.terms, self.exempt = state
        self.automaton = None

    def match(self, word: str) -> tuple[float, int] | None:
        """The weight of the term that a word is, or is a misspelling of, and the edits."""
        if word in self.terms:
            return self.terms[word], 0
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        found = self.automaton.match(word)
        return None if found is None or word in self.exempt else (self.terms[found[0]], found[1])


def _quoted(text: str, start: int, stop: int) -> bool:
    """Whether a match stands in quotation marks, or after a word of reporting."""
    before, after = text[max(0, start - WINDOW) : start], text[stop : stop + WINDOW]
    for opening, closing in QUOTES:
        at = before.rfind(opening)
        if at < 0 or closing not in after:
            continue
        if opening == closing:
            if before.count(opening) % 2 == 1:
                return True
        elif closing not in before[at + 1 :]:
            return True
    return REPORTING.search(before) is not None


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Where blocks of a text start and stop; they are cut between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + TEXT_BLOCK)
        while end < len(text) and not text[end].isspace():
            end += 1
        yield at, end
        at = end


FEATURES = 3


class Matcher:
    """Features of texts under a lexicon; words are looked up once, as long as there is room to remember them."""

    ROOM = 500_000

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.known = lexicon, {}

    def hits(self, text: str) -> Iterator[tuple[int, int, float, int]]:
        """start, stop, weight, edits of every match in a text."""
        known, match = self.known, self.lexicon.match
        for start, stop in _blocks(text):
            for found in WORD.finditer(text, start, stop):
                word = found.group()
                if word in known:
                    hit = known[word]
                else:
                    if len(known) >= self.ROOM:
                        known.clear()
                    hit = known[word] = match(word.lower())
                if hit is not None:
                    yield (*found.span(), *hit)

    def features(self, text: str) -> list[float]:
        """As logarithms: the weights of the different matches, their number, and the weights of quoted ones. A misspelling
        counts as its term, divided by one more than its edits."""
        plain: dict[str, float] = {}
        quoted: dict[str, float] = {}
        n = 0.0
        for start, stop, weight, edits in self.hits(text):
            word = text[start:stop].lower()
            if _quoted(text, start, stop):
                quoted[word] = weight / (1 + edits)
            else:
                plain[word] = weight / (1 + edits)
                n += 1 / (1 + edits)
        return [math.log1p(sum(plain.values())), math.log1p(n), math.log1p(sum(quoted.values()))]


@dataclass
class Model:
    """A lexicon and the calibration: weights of (1, features), standardised."""

    lexicon: Lexicon
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def predict(texts: list[str], model: Model | float, matcher: Matcher | None = None) -> np.ndarray:
    if not isinstance(model, Model):
        return np.full(len(texts), float(model))
    matcher = matcher or Matcher(model.lexicon)
    x = np.array([matcher.features(t) for t in texts]).reshape(len(texts), FEATURES)
    z = model.weights[0] + (x - np.array(model.centre)) / np.array(model.scale) @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, half: the bounded sample, one row an id; a work table."""
    order = F.md5(F.col("doc_id").cast("string"))
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 1)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("half", (fold(F.col("doc_id")) == 2).cast("int"))
    picked = None
    for toxic in (0, 1):
        for half in (0, 1):
            some = rows.where((F.col("toxic") == toxic) & (F.col("half") == half)).orderBy(order).limit(SAMPLE[toxic])
            picked = some if picked is None else picked.unionByName(some)
    ids = table(picked.coalesce(1), "toxic-ids")  # 2 * sum(SAMPLE) rows at most
    texts = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= MAX_BYTES[1])
    texts = texts.groupBy("doc_id", "toxic", "half").agg(F.min("text").alias("text"))  # of rows that share an id the first text
    so_far = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("toxic", "half").orderBy(order, "doc_id"))
    found = table(texts.withColumn("_bytes", so_far).where(F.col("_bytes") <= F.when(F.col("toxic") == 1, MAX_BYTES[1]).otherwise(MAX_BYTES[0])).drop("_bytes"), "toxic-sample")
    drop(ids)
    return found


def word_counts(sample: DataFrame) -> DataFrame:
    """word, and by half its distinct contexts in toxic and in clean texts: toxic0, clean0, toxic1, clean1."""
    words = sample.select("toxic", "half", F.regexp_extract_all(F.lower("text"), F.lit(JVM_WORD), 1).alias("w"))
    at = F.posexplode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("near")))).alias("_i", "_w")
    each = words.select("toxic", "half", at).select("toxic", "half", "_w.word", "_w.near")
    contexts = each.groupBy("word", "near").agg(*(F.max(((F.col("toxic") == t) & (F.col("half") == h)).cast("int")).alias(f"{name}{h}") for t, name in ((0, "clean"), (1, "toxic")) for h in (0, 1)))
    return contexts.groupBy("word").agg(*(F.sum(f"{name}{h}").alias(f"{name}{h}") for name in ("toxic", "clean") for h in (0, 1)))


def lexicon_of(counts: pd.DataFrame, halves: tuple[int, ...], totals: dict[str, float]) -> Lexicon:
    """The terms of some halves of the sample, and the clean words near them, from word_counts."""
    toxic, clean = (sum(counts[f"{name}{h}"] for h in halves).to_numpy(float) for name in ("toxic", "clean"))
    all_toxic, all_clean = (sum(totals[f"{name}{h}"] for h in halves) + 1.0 for name in ("toxic", "clean"))
    odds = np.log((toxic + PRIOR) / (all_toxic - toxic + PRIOR)) - np.log((clean + PRIOR) / (all_clean - clean + PRIOR))
    n, chance = toxic + clean, all_toxic / (all_toxic + all_clean)
    share = np.clip(toxic / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    unlikely = np.where(share > chance, -n * (share * np.log(share / chance) + (1 - share) * np.log((1 - share) / (1 - chance))), 0.0)
    tested = np.sort(unlikely[n >= LEAST_CONTEXTS])
    passed = np.nonzero(tested <= np.log(FALSE * np.arange(1, len(tested) + 1) / max(1, len(tested))))[0]
    bound = tested[passed[-1]] if len(passed) else -np.inf
    words = counts["word"].to_numpy()
    chosen = (toxic >= LEAST_CONTEXTS) & (unlikely <= bound) & (odds >= math.log(ODDS))
    found = Lexicon(dict(zip(words[chosen].tolist(), odds[chosen].tolist())))
    if found.terms:
        automaton = Automaton(found.terms)
        found.exempt = frozenset(w for w in words[~chosen & (clean > 0)].tolist() if automaton.match(w) is not None)
    return found


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model of these documents and labels; folds 0 and 2 only."""
    sample = labelled_sample(docs, labels)
    shares = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        drop(sample)
        return float(next(iter(shares), 0.5))
    counts = table(word_counts(sample), "toxic-words")
    totals = counts.agg(*(F.sum(c).alias(c) for c in ("toxic0", "clean0", "toxic1", "clean1"))).first().asDict()
    # words that could be terms, and the clean ones that could lie near them
    listed = counts.where(f"toxic0 + toxic1 >= {LEAST_CONTEXTS} or clean0 + clean1 > 0").toPandas()
    whole_lexicon = lexicon_of(listed, (0, 1), totals)
    by_half = [lexicon_of(listed, (1 - h,), totals) for h in (0, 1)]  # a half's texts are read with the other's lexicon
    sent = docs.sparkSession.sparkContext.broadcast(by_half)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = [Matcher(lexicon) for lexicon in sent.value]
        for batch in batches:
            rows = [(i, y, *matchers[h].features(t)) for i, y, h, t in zip(batch.doc_id, batch.toxic, batch.half, batch.text)]
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", *(f"x{i}" for i in range(FEATURES))])

    x = sample.mapInPandas(measured, "doc_id long, toxic int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toPandas().sort_values("doc_id", kind="stable")
    w, centre, scale = calibrate(x[[f"x{i}" for i in range(FEATURES)]].to_numpy(), x.toxic.to_numpy(float))
    drop(sample, counts)
    return Model(whole_lexicon, tuple(w), tuple(centre), tuple(scale))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.value.lexicon) if isinstance(model.value, Model) else None
        for texts in batches:
            yield pd.Series(predict(texts.fillna("").tolist(), model.value, matcher))

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
