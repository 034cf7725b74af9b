"""The operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from passagework.llm import components, exact_dedup, fingerprints, html_text, mixing, packing, pii, queries, quality, sharding, simhash, url_filter

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# sharding


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(20_000)
    for n in (3, 16):
        before, after = [1.0] * n, [1.0] * (n + 1)
        moved = keys.select(sharding.rendezvous(F.col("id"), before).alias("a"), sharding.rendezvous(F.col("id"), after).alias("b"))
        assert moved.where(f"a <> b and b <> {n}").count() == 0
        assert abs(moved.where(f"b = {n}").count() / 20_000 - 1 / (n + 1)) < 0.02


def test_shards_follow_their_weights(spark):
    counts = dict(spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 5.0]).alias("s")).groupBy("s").count().collect())
    assert all(abs(counts[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate([1, 2, 5]))


def test_equal_texts_lie_where_their_ids_say(spark):
    """The law is `key`: a text's copies are dealt out by doc_id, and the same doc_id lies in one shard."""
    docs = spark.createDataFrame([(i % 150, "the same text" if i < 200 else f"text {i}") for i in range(300)], "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(s) == 1 for s in by_id.values()) and len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"the same text")}) > 8


# SimHash


def fingerprint(text):
    w = [x.encode() for x in words(lowered(text))]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_the_definition(spark, small):
    texts = dict(small.select("doc_id", "text").collect())
    assert all(r.fingerprint == f"{fingerprint(texts[r.doc_id]):016x}" for r in queries.op2_simhash_pivots(spark, SF).collect())


def test_a_text_in_blocks_has_the_fingerprint_of_the_whole(monkeypatch):
    text = " ".join(random.Random(3).choice("abcdef") for _ in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 97)
    assert simhash.fingerprint(text) == whole == fingerprint(text)


def brute_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for p in prints:
        groups[find(p)].add(p)
    return {frozenset(g) for g in groups.values()}


def linked(spark, prints):
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    roots = dict(components.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect())
    groups = defaultdict(set)
    for (p,) in signed:
        groups[roots.get(p, p)].add(p % 2**64)
    return {frozenset(g) for g in groups.values()}


def test_links_join_what_brute_force_joins(spark):
    r, prints = random.Random(5), set()
    for _ in range(60):
        p = r.getrandbits(64)
        for _ in range(r.randint(1, 9)):
            prints.add(p)
            for _ in range(r.randint(1, 4)):
                p ^= 1 << r.randrange(64)
    assert linked(spark, prints) == brute_components(prints)


def test_hot_groups_lose_no_link(spark):
    """One centre with hundreds of neighbours: far more than HOT share every coordinate group."""
    r = random.Random(6)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(700)} | {r.getrandbits(64) for _ in range(200)}
    assert linked(spark, prints) == brute_components(prints)


def test_components_of_a_long_chain(spark):
    found = components.components(spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))).collect()
    assert len(found) == 299 and {r.root for r in found} == {0}


# quality


def test_quality_holds_out_of_its_fold(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op3_compression_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    good = [r.predicted for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.97


def plain_features(text, good, bad):
    import zstandard

    data, sizes = text.encode(), []
    if not data:
        return [0.0] * 4
    for dictionary in (good, bad):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(data[i : i + 512])) for i in range(0, len(data), 512)))
    d, r = (sizes[1] - sizes[0]) / sum(sizes), math.log(sizes[0] / len(data) + 0.01)
    return [d, r, d * d, r * r]


def test_the_score_is_the_plain_computation(spark, small):
    """Compressed sizes, the differences and the calibrated score from the model's dictionaries; the calibration's
    weights are the optimum of the ridge likelihood over the tuning part, and that part excludes fold 1."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = quality.labelled_sample(small, labels)
    assert all(zlib.crc32(str(i).encode()) % 3 == 2 * p for i, p in zip(sample.doc_id, sample.part))
    model = quality.fit(sample)
    score = lambda f: 1 / (1 + math.exp(-(model.weights[0] + sum(w * (x - c) / s for w, x, c, s in zip(model.weights[1:], f, model.centre, model.scale)))))
    got = {r.doc_id: r for r in quality.scored(small, labels).collect()}
    for row in small.collect():
        assert got[row.doc_id].score == pytest.approx(score(plain_features(row.text or "", model.good, model.bad)), abs=1e-9)
        assert got[row.doc_id].held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
    tune = sample[sample.part == 1]
    x = np.array([plain_features(t, model.good, model.bad) for t in tune.text])
    a = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / (x.std(0) + 1e-9)])
    p = 1 / (1 + np.exp(-a @ np.array(model.weights)))
    assert np.allclose(x.mean(0), model.centre) and np.abs(a.T @ (tune.quality - p) - quality.RIDGE * np.array(model.weights)).max() < 1e-6


def test_scores_depend_on_the_text_alone(spark, small, labels):
    scores = defaultdict(set)
    doubled = small.unionByName(small.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("source", F.lit("x")))
    for r in quality.scored(doubled, spark.read.parquet(f"{SF}/labels.parquet")).collect():
        scores[r.doc_id % 1000].add(r.score)
    assert all(len(s) == 1 for s in scores.values())


# HTML


def test_the_field_reads_layouts_that_it_was_not_trained_on():
    field, wrong, n = html_text.trained(), 0, 0
    for blocks, labels in html_text.training_pages(300, seed=1234):
        found = field.decode(blocks)
        wrong, n = wrong + sum(a != b for a, b in zip(found, labels)), n + len(labels)
    assert wrong / n < 0.03


@pytest.mark.parametrize("family, most", [("blog", 0.12), ("news", 0.25), ("plain", 0.15), ("manual", 0.15)])
def test_a_family_of_layouts_that_was_held_out_whole(family, most):
    others = {k: v for k, v in html_text.FAMILIES.items() if k != family}
    field = html_text.train(html_text.training_pages(300, families=others))
    pages = html_text.training_pages(100, seed=1234, families={family: 1})
    wrong = sum(a != b for blocks, labels in pages for a, b in zip(field.decode(blocks), labels))
    assert wrong / sum(len(labels) for _, labels in pages) < most


BLOG = """<html><body><div id=page><div id="masthead"><h1>My Blog</h1><p>Just another weblog</p></div><div id="primary"><div class="post"><h2>Walking
 home</h2><p>It was a long way home, and we walked it all.</p><p>Then it rained.</p></div></div><div id="secondary"><h3>Recent Posts</h3><ul><li><a href=1>Walking
 home</a></li><li><a href=2>Rain</a></li></ul><h3>About</h3><p>I write about walking.</p></div><div id="colophon"><p>Proudly powered by software.</p></div></div></body></html>"""
OLD = """<html><body bgcolor="#ffffff"><table><tr><td colspan=2><font size=6>Bob's Home Page</font></td></tr><tr><td width=120><a href=a>Home</a><br><a href=b>Links</a><br><a
 href=c>Guestbook</a></td><td><h2>My trip to Rome</h2><p>We went to Rome in May. It was hot.<p>The food was very good, and we ate a lot of it.</td></tr></table><hr>
<center>Last updated 1999</center></body></html>"""


def test_pages_that_no_generator_wrote():
    field = html_text.trained()
    assert html_text.main_text(BLOG, field) == "Walking home It was a long way home, and we walked it all. Then it rained."
    assert html_text.main_text(OLD, field) == "My trip to Rome We went to Rome in May. It was hot. The food was very good, and we ate a lot of it."


def test_pages_with_clashing_columns_long_texts_and_repeated_rows(spark):
    page = "<article><h1>Title</h1>" + "<p>Many words stand here, one after the other.</p>" * 20_000 + "</article><footer>&copy; x</footer>"
    rows = [(1, "u", page, "a", 1, "b"), (1, "u", page, "a", 1, "b"), (2, "u", "<p>" + "long " * 400_000, None, None, None), (3, None, None, "", 0, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, features string")
    found = html_text.extracted(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id, r.n_chars, r.text[:5]) for r in found.collect())
    size = 5 + 20_000 * len(" Many words stand here, one after the other.")
    assert got == [(1, size, "Title"), (1, size, "Title"), (2, 1_999_999, "long "), (3, 0, "")]


def test_viterbi_is_the_best_labelling():
    field = html_text.trained()
    for blocks, _ in html_text.training_pages(12, seed=77):
        blocks = blocks[:10]
        scores, pairs = field.scores(blocks), field.pairs

        def value(labels):
            total = scores[0] * labels[0] + field.start * labels[0]
            return total + sum(pairs[a, b] + scores[i] * b for i, (a, b) in enumerate(zip(labels, labels[1:]), 1))

        best = max(value([n >> i & 1 for i in range(len(blocks))]) for n in range(2 ** len(blocks)))
        assert math.isclose(value([int(x) for x in field.decode(blocks)]), best, abs_tol=1e-9)


def test_pages_give_their_articles(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.page_id: r for r in queries.op4_html_crf(spark, "/root/testdata/sf0.01").collect()}
    for page in pages:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)
        text = re.sub(r"<[^>]*\Z", "", inside[1] if inside else "")
        text = re.sub(r"</?(?:p|h1|br)>", " ", text).replace("<b>", "")
        want = " ".join(html.unescape(text).split())
        assert found[page.page_id].text == want and found[page.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<p>a &lt;b&gt; c&nbsp;d<p>e", ["a <b> c d", "e"]), ("<p>x<script>if (a</p>) </script>y</p>z", ["xy", "z"]), ("a<!-- <p>no</p> -->b", ["ab"]), ("<p title='a>b'>t</p><br/>u", ["t", "u"]),
        ("<ul><li>1<li>2</ul>3", ["1", "2", "3"]), ("t <a href='x", ["t"]), ("1 < 2 & 3 > 2", ["1 < 2 & 3 > 2"]), ("<p>w<b>or</b>d</p>", ["word"]), ("<STYLE>p{}</style >k<template>n</template>", ["k"]),
    ],
)
def test_leaf_blocks(page, texts):
    assert [b.text for b in html_text.blocks_of(page)] == texts


# personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_spans_are_those_of_the_plain_patterns(spark):
    r = random.Random(1)
    bits = [*"0123456789" * 3, *".@-+ ()ab_%", ".", "@", "é", "😀", "\n", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+49 30 ", "255"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 120))) for _ in range(800)]
    texts += ["a" * 100_000, "1" * 100_000, "1 " * 50_000, "+" + "(" * 100_000, "x@" + "a." * 50_000 + "b", "1." * 50_000]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        spans = [f"{kind}:{m.start()}:{m.end()}" for kind, p in PATTERNS for m in re.finditer(p, texts[row.doc_id]) if passes(kind, m[0])]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in spans) for k, _ in PATTERNS]


def test_checksums_and_context(spark):
    texts = ["IBAN DE89370400440532013000.", "DE89370400440532013001 bank", 'token = "' + "ab12" * 10 + '"', "sum " + "ab12" * 10, "host 10.1.2.3", "version 10.1.2.3"]
    rows = {(r.doc_id, r.kind): r for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (0, "iban") in rows and (1, "iban") not in rows and (2, "secret") in rows and (3, "secret") not in rows
    assert rows[4, "ip"].score > rows[5, "ip"].score


# consistent weighted sampling


def generalised_jaccard(a, b):
    a, b = (Counter(words(lowered(t)) or [""]) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values())


def test_collisions_estimate_generalised_jaccard(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    found = {r.doc_id: r for r in queries.op6_consistent_sampling(spark, d).collect()}
    edited, following = [], []
    for row, after in zip(rows, [*rows[1:], rows[0]]):
        n = len(row.text) // 3
        text = row.text[: len(row.text) - n] + after.text[:n]
        got = found[row.doc_id]
        assert got.n_chars == len(row.text) and got.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        edited.append(got.near_edited - generalised_jaccard(row.text, text))
        following.append(got.near_next - generalised_jaccard(row.text, after.text))
    assert abs(np.mean(edited)) < 0.012 and np.std(edited) < 0.08 and abs(np.mean(following)) < 0.006


def plain_samples(text):
    """The fingerprint by the textbook: every word, every sample, the smallest ln a."""
    weights = Counter(w.lower() for w in re.split(r"[\x20\x09-\x0D]+", text) if w) or Counter([""])
    digits = []
    for k in range(fingerprints.SAMPLES):
        part, of = divmod(k, fingerprints.AT_ONCE)
        least = math.inf
        for word, weight in weights.items():
            bits = xx_row(xx_row_bytes(word.encode()), part, of)
            u = [((bits >> at) & ((1 << width) - 1)) * 2.0**-width + 2.0 ** -(width + 1) for at, width in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))]
            r, c, b = -math.log(u[0] * u[1]), -math.log(u[2] * u[3]), u[4]
            t = math.floor(math.log(weight) / r + b)
            least = min(least, math.log(c) - r * (t - b + 1.0))
        digits.append(least)
    return digits


def xx_row_bytes(data, seed=42):
    """xxhash64 of a string column, as Spark has it."""
    return xxhash.xxh64_intdigest(data, seed)


def xx_row(term, part, k):
    """xxhash64 of (long, int, int): each column's hash is the next one's seed."""
    seed = xxhash.xxh64_intdigest(struct.pack("<Q", term), 42)
    for number in (part, k):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", number), seed)
    return seed


def test_fingerprints_are_the_plain_samples(spark):
    texts = ["a b a c", "one", "The the THE quick brown fox " * 3, "x\ty\nz z z z", "", " word " * 50, "so many words that follow each other and are not the same at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.edited_fingerprints(docs).collect()}
    for i, text in enumerate(texts):
        # a logarithm's last bits may differ between the engines, so a sample's digits are sought around its value
        found = re.findall("....", got[i])
        near = [{f"{xxhash.xxh64_intdigest(struct.pack('<d', a + k * math.ulp(a)), 42) & 65535:04x}" for k in range(-40, 41)} for a in plain_samples(text)]
        assert len(found) == len(near) == fingerprints.SAMPLES and sum(x in some for x, some in zip(found, near)) >= fingerprints.SAMPLES - 2


def test_many_empty_texts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE_ROWS", 1000)
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "some words").otherwise("").alias("text"))
    rows = fingerprints.edited_fingerprints(docs)
    assert rows.count() == 10_000 and rows.where("doc_id % 100 <> 0 and n_chars <> 0").count() == 0
    assert rows.select("fingerprint").distinct().count() == 2


def test_likeness_is_read_off_the_fingerprints(spark):
    for r in queries.op6_consistent_sampling(spark, SF).collect():
        a, b = (re.findall("....", x) for x in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == sum(x == y for x, y in zip(a, b)) / len(a)


# mixing


def test_sources_meet_their_targets(spark):
    rows = queries.op7_fair_queue_mixing(spark, "/root/testdata/sf0.01").collect()
    sources = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect())
    taken, targets = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
        targets[sources[r.doc_id]] = (r.target, r.source_size)
    assert all(abs(taken[s] - t) <= 2 * mixing.QUANTUM and t <= 2 * size for s, (t, size) in targets.items())
    assert sum(taken.values()) == sum(math.floor(t) for t, _ in targets.values())
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6 * sum(taken.values())


def brute_mix(rows):
    """Words taken by row number, from rows of (doc_id, source, size): all packets in one sorted queue."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(sizes.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = float(2 * sizes[s]) if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    packets = []
    for number, s in enumerate(sources):
        at = 0
        mine = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (hashlib.md5(str(rows[i][0]).encode()).hexdigest(), rows[i][0], rows[i][2]))
        for _ in range(2):
            for i in mine:
                for k in range(0, rows[i][2], mixing.QUANTUM):
                    n = min(mixing.QUANTUM, rows[i][2] - k)
                    packets.append(((at + n) / target[s], number, at, i, n))
                    at += n
    budget, taken = sum(math.floor(t) for t in target.values()), Counter()
    for _, _, _, i, n in sorted(packets):
        taken[i] += min(n, budget)
        budget -= min(n, budget)
    return taken, target


def test_the_mix_is_the_sorted_queue(spark):
    """Three hundred sources, one of a tenth of the words, documents up to 3,000 words, ties of md5 and of virtual time."""
    r = random.Random(17)
    rows = [(i if i % 50 else 7, None if i % 300 == 299 else f"s{i % 300:03d}", r.choice([0, 1, 5, 40, 41, 300, 900, 3000])) for i in range(1500)]
    rows += [(5000 + i, "s000", r.randint(1, 2000)) for i in range(100)]
    taken, target = brute_mix(rows)
    docs = spark.createDataFrame([(i, s, "w " * n, j) for j, (i, s, n) in enumerate(rows)], "doc_id long, source string, text string, row int").repartition(5)
    by_id, want = defaultdict(Counter), defaultdict(Counter)
    for j, (i, s, n) in enumerate(rows):
        want[i, s, n][taken[j]] += 1
    for x in mixing.schedule(docs).collect():
        by_id[x.doc_id, x.source, x.size][x.taken] += 1
        assert x.target == pytest.approx(target[x.source])
    assert {k: sorted(v.elements()) for k, v in by_id.items()} == {k: sorted(v.elements()) for k, v in want.items()}


def test_repeated_rows_share_the_mix(spark):
    docs = spark.createDataFrame([(None, "s", "a b c", str(k % 4)) for k in range(40)] + [(1, "t", "x " * 200, "e")], "doc_id long, source string, text string, extra string")
    runs = [sorted((r.extra, r.text) for r in mixing.mix(docs.repartition(n)).collect()) for n in (2, 5)]
    assert runs[0] == runs[1]
    taken = sum(math.floor(r.taken / r.size + 0.5) for r in mixing.mix_table(docs).collect())
    assert len(runs[0]) == taken


def test_excess_is_shared_again(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), ("d", 5), (None, 400)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    weights, sizes = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, {"a": 10, "b": 1000, "c": 100, "d": 5, None: 400}
    left, open_, want = 1.5 * 1515, set(weights), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        for s in full or open_:
            want[s] = 2 * sizes[s] if full else level * weights[s]
        left -= sum(want[s] for s in full)
        open_ -= full or open_
    assert got == pytest.approx(want)


def test_mix_has_whole_documents(spark, small):
    plan = {r.doc_id: r for r in mixing.mix_table(small).collect()}
    copies = Counter(r.doc_id for r in mixing.mix(small).select("doc_id").collect())
    assert all(copies[i] == math.floor(r.taken / r.size + 0.5) for i, r in plan.items() if r.size)


# packing


def test_pieces_give_the_documents_back(spark, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    rows = queries.op8_vector_best_fit(spark, SF).collect()
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in small.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(struct.pack(f"<{len(ids[k : k + 4096])}I", *ids[k : k + 4096]))) for k in range(0, len(ids), 4096)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == want
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_sequence) <= 1.02 * math.ceil(sum(r.length for r in rows) / 4096) + 1


def coded(coder, text):
    split = packing._lowered(text).split()
    coder.learn([split])
    return coder.encode(split)


def whole_ids(coder, text):
    ids = coder.whole.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


def test_words_have_the_ids_of_their_text():
    coder = packing.WordCoder(packing.tokenizer_path())
    for text in (
        "İstanbul ΣΑΣ ÅB é ́x \x1c\x1dd it's we'll 12ab<|endoftext|> foo.%% a≮ b", "a\u0085b c​d ẞ ÿ Ÿ", "ﬁ Dž don't. '| É. <|endoftext|>| " + "z" * 300,
        "A<|ENDOFTEXT|> THE!! Å K", "T\u0308", "J\u030c THE", "H\u0331.", "W\u030a", "Y\u030a Y\u0344 T\u0323\u0308",
    ):
        assert coded(coder, text) == whole_ids(coder, text)


def test_fuzzed_texts_have_the_ids_of_the_tokenizer():
    """Combining marks after every letter, long words, special tokens, letters that change under composition or by case."""
    coder, r = packing.WordCoder(packing.tokenizer_path()), random.Random(13)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    marks = [chr(c) for c in range(0x300, 0x370)] + ["\u1ab0", "\u20d0", "\u3099", "\u0591", "\u093c"]
    bits = [*"AÅÉßẞİıſﬁΣςσ½①한글가각がか日本😀‍\u00a0\u2003\u0085\x1c\x00'’-_.,!?#%&|<>()/~0123456789", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "||", "''", " ", " ", "\n", "\t", "the", "The", "THE", "ing", "...", "%%", "x" * 70, "Q" * 65, "ÄÖÜ", "Æ" * 40]
    wrong = 0
    for _ in range(10_000):
        text = "".join(r.choice(letters) + r.choice(marks) if r.random() < 0.25 else r.choice(letters) if r.random() < 0.4 else r.choice(bits) for _ in range(r.randint(1, 30)))
        wrong += coded(coder, text) != whole_ids(coder, text)
    assert wrong == 0


def test_the_middle_table_has_the_tokenizers_ids(spark):
    d = "/root/testdata/sf0.01"
    coder = packing.WordCoder(packing.tokenizer_path())
    got = defaultdict(list)
    for r in packing.tokenised(spark.read.parquet(f"{d}/documents.parquet")).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for doc_id, text in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = whole_ids(coder, text or "") + struct.pack("<I", 1)
        assert sorted(got[doc_id]) == [(k // 4, len(ids[k : k + 16384]) // 4, zlib.crc32(ids[k : k + 16384])) for k in range(0, len(ids), 16384)]


def test_best_fit_obeys_every_constraint():
    r = random.Random(2)
    lengths = sorted((r.randint(1, 60) for _ in range(400)), reverse=True)
    placed = packing.best_fit(lengths, size=100, max_docs=4, max_cost=5000, weights=(1.0, 0.3, 0.3))
    held = defaultdict(list)
    for length, (sequence, offset) in zip(lengths, placed):
        assert offset == sum(held[sequence])
        held[sequence].append(length)
    assert all(sum(h) <= 100 and len(h) <= 4 and sum(x * x for x in h) <= 5000 for h in held.values())


def test_best_fit_takes_the_smallest_residual_norm():
    """Every choice against a search of all open sequences."""
    r = random.Random(8)
    lengths, weights = sorted((r.randint(1, 40) for _ in range(150)), reverse=True), (1.0, 0.5, 0.5)
    state = {}
    for length, (sequence, _) in zip(lengths, packing.best_fit(lengths, 64, 6, 3000, weights)):
        norms = {s: weights[0] * ((t - length) / 64) ** 2 + weights[1] * ((d - 1) / 6) ** 2 + weights[2] * ((c - length**2) / 3000) ** 2 for s, (t, d, c) in state.items() if t >= length and d >= 1 and c >= length**2}
        assert (sequence not in state) == (not norms)
        if norms:
            assert norms[sequence] == pytest.approx(min(norms.values()))
        t, d, c = state.get(sequence, (64, 6, 3000))
        state[sequence] = (t - length, d - 1, c - length**2)


# URL filters


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path, host = re.match(r"[^?#]*", rest[len(host) :])[0], lowered(host)
    fits = [(name + start, v) for v, name, start in url_filter.RULES if (host == name or host.endswith("." + name)) and path.startswith(start)]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_rules(spark):
    d = "/root/testdata/sf0.01"
    urls = dict(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect())
    for r in queries.op9_path_templates(spark, d).collect():
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


# exact dedup


def test_collisions_are_told_apart_by_bytes(spark, small, monkeypatch):
    """With a digest of a byte or so nearly every hit is a collision."""
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 1))
    strong = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(small).collect()}
    monkeypatch.setattr(exact_dedup, "digest_of", weak)
    assert {r.id: (r.keep_id, r.copies, r.kept) for r in exact_dedup.decide(small).collect()} == strong


def test_runs_merge_across_flushes(spark):
    one, two = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c")]))
    index = exact_dedup.DigestIndex(spark, keep="smallest")
    index.flush(one)
    index.compact()
    index.flush(two)
    index.compact()
    assert {(r.id, r.keep_id, r.copies, r.kept) for r in index.probe().collect()} == {(1, 1, 2, True), (3, 1, 2, False), (2, 2, 1, True), (4, 4, 1, True)}
    assert index.collisions(one.unionByName(two)).count() == 0
    found = exact_dedup.with_maybe(spark.createDataFrame([("a",), ("b",)], "text string"), exact_dedup.digest_of(F.col("text")), index.hits())
    assert {r.text: r._maybe for r in found.collect()}["a"]


def test_hot_digests(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 3)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == 60 and sum(r.kept for r in rows) == 21 and {r.keep_id for r in rows if r.group_size == 40} == {39}
