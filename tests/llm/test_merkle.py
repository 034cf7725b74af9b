"""Proofs against a plain tree, which is built and folded in Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

from passagework.llm import merkle

from .conftest import ROWS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(digests):
    """The root, and for every leaf its runs upwards with its place in each."""
    paths, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for place, (_, members) in enumerate(run):
                for i in members:
                    paths[i].append((place, [d for d, _ in run]))
            above.append((sha("".join(d for d, _ in run)), [i for _, members in run for i in members]))
        nodes = above
    return nodes[0][0], paths


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0], sha(encoded(row)), row))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made[lang] = tree([x[1] for x in groups[lang]])
    root, tops = tree([made[lang][0] for lang in langs])
    for lang, top in zip(langs, tops):
        for (i, leaf, row), path in zip(groups[lang], made[lang][1]):
            now, steps = leaf, path + top
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and row[4] is not None:
                now = sha(encoded((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))))
            proof = sha("".join(d for place, run in steps for k, d in enumerate(run) if k != place))
            for place, run in steps:
                now = sha("".join(now if k == place else d for k, d in enumerate(run)))
            yield (i, leaf, made[lang][0], root, proof, now, now == root)


def same(df):
    rows = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
    found = merkle.tampered_proofs(df)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(map(tuple, found.collect()))
    assert found == Counter(plain(rows))
    return found


def test_the_smallest_table(small):
    found = same(small)
    assert 0 < sum(not row[-1] for row in found) < len(found) / 2


def test_awkward_rows(awkward):
    assert sum(same(awkward).values()) == len(ROWS)


def test_shapes_of_trees(spark):
    """Trees of one leaf, of full runs, of one leaf more, and more languages than a run holds."""
    rows = [(i, f"T{i}", f"l{lang:02}" if lang else None, None, None) for lang, n in enumerate((1, 8, 9, 64, 65, 1, 2, 7, 1, 130)) for i in range(n)]
    same(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4))
    one = spark.createDataFrame(rows[:1], "doc_id long, text string, lang string, source string, n_chars long")
    (found,) = same(one)
    assert found[1] == found[2] == found[3] and found[4] == sha("")


def test_levels_that_are_joined_and_not_broadcast(small, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_RUNS", 1)
    same(small)


def test_without_rows(empty):
    assert merkle.tampered_proofs(empty).count() == 0
