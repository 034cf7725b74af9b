"""The automaton against plain edit distances, contexts, and held-out labels."""

from __future__ import annotations

import random

import pytest

from passagework.llm import queries, toxicity
from passagework.llm.toxicity import Automaton, Lexicon, Matcher, Model, edits_for

from .test_awkward import WANT, ids


def distance(a, b):
    """Edits between two words; a swap of neighbours is one."""
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i][j] = min(table[i][j], table[i - 2][j - 2] + 1)
    return table[-1][-1]


def test_the_automaton_finds_what_distances_find(monkeypatch):
    r = random.Random(5)
    for most_states in (200_000, 3):
        monkeypatch.setattr(toxicity, "MOST_STATES", most_states)
        for _ in range(15):
            terms = {"".join(r.choice("abcd") for _ in range(r.choice([2, 4, 5, 6, 9, 12, 14]))): r.random() for _ in range(12)}
            automaton = Automaton(terms)
            for _ in range(60):
                word = list(r.choice([*terms]))
                for _ in range(r.randint(0, 3)):
                    at = r.randrange(len(word) + 1)
                    word[at : at + r.randint(0, 2)] = [r.choice("abcde") for _ in range(r.randint(0, 2))]
                word = "".join(word)
                near = [(distance(t, word), -w, t) for t, w in terms.items() if distance(t, word) <= edits_for(t)]
                best = min(near, default=None)
                assert automaton.match(word) == (None if best is None else (best[2], best[0]))


def model(terms):
    return Model(Lexicon(terms), (-4.0, 4.0, 2.0, 0.1), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


def test_misspellings_quotations_and_long_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "TEXT_BLOCK", 64)
    fitted = model({"worthless": 8.0, "idiot": 8.0, "scum": 8.0})
    clean = "a plain text about nothing at all, with words enough to fill a block or two. " * 3
    score = lambda text: float(toxicity.predict([text], fitted)[0])
    assert score(clean) < 0.1 and score("") < 0.1
    assert min(map(score, ("you idiot", "YOU IDIOT!", "you idoit", "you worthles scum", "idio7t", clean + "you idiot " + clean))) > 0.7
    assert score("he said: \"you idiot\", and left") < 0.1 and score("the word idiot is old") < 0.1 and score("«idiot», a word that she heard") < 0.1
    assert score("\"nice day\" they sang, you idiot, and \"good bye\"") > 0.7
    assert score("scun") < 0.1  # short words aren't guessed at
    assert [h[:2] for h in Matcher(fitted.lexicon).hits("an idiot, a scum")] == [(3, 8), (12, 16)]
    fitted.lexicon.exempt = frozenset(["idiom"])
    assert score("an idiom") < 0.1


@pytest.mark.parametrize("scale, recall, false", [("sf0.01", 0.7, 0.02), ("sf0.1", 0.9, 0.01)])
def test_held_out_labels(spark, scale, recall, false):
    path = f"/root/testdata/{scale}"
    found = queries.op13_levenshtein_toxicity(spark, path)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    wrong = sum(p for p, y in held if not y) / sum(1 - y for _, y in held)
    assert caught >= recall and wrong <= false


def test_held_out_labels_are_not_learned_from(spark, small):
    """Turning all held-out labels over changes no score."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda found: {r.doc_id: r.score for r in found.collect()}
    assert scores(toxicity.scored(small, labels)) == scores(toxicity.scored(small, turned))


def test_awkward_rows(awkward, empty, labels):
    found = toxicity.scored(awkward, labels)
    rows = found.collect()
    assert ids(found) == WANT and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[4] == by_id[5] == by_id[6]
    assert {r.score for r in toxicity.scored(awkward, labels.limit(0)).collect()} == {0.5}
    assert toxicity.scored(empty, labels).count() == 0
