"""Operators against brute force, the public tokenizers, DuckDB, and cases planted in invented text."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from isospan.llm import decontaminate, line_dedup, lm_scoring, mixing, ngram_join, pii, quality_classifier, quality_rules, queries, substring_dedup, token_counts

WORD = r"[^\x20\x09-\x0D]+"


def invented(n, seed=1, words=400):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [" ".join(rng.choices(pool, weights, k=rng.randrange(40, 120))) for _ in range(n)], rng


def frame(spark, texts, lang="en", source="s"):
    rows = [(k, t, lang, source, len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [1024, 8])
def test_ngram_join(spark, block):
    texts, rng = invented(60)
    texts[0] = " ".join(texts[:4])
    for _ in range(80):  # near copies at similarities around the limit, many of one text
        w = texts[rng.choice([*[0] * 60, *range(60)])].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += texts[:5]
    sets = collections.defaultdict(list)
    for k, t in enumerate(texts):
        sets[shingles(t)].append(k)
    rep = {s: min(v) for s, v in sets.items()}
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            links[rep[a]].add(rep[b])
            links[rep[b]].add(rep[a])
    root = {r: r for r in rep.values()}
    for _ in root:
        root = {r: min([root[r], *(root[x] for x in links[r])]) for r in root}
    want = {k: (rep[s], root[rep[s]], len(links[rep[s]])) for s, v in sets.items() for k in v}
    docs = frame(spark, texts)
    rows = ngram_join.similar_classes(docs, block=block).collect()
    assert sum(map(len, links.values())) > 100
    assert {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in rows} == want
    if block == 8:
        kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
        assert sorted(kept) == sorted(set(root.values()))


def test_classes_without_links_within(spark, monkeypatch):
    """A large group of near copies and others that only meet it: the same classes as by all links, from a number of
    block pairs that grows with the group instead of its square."""
    texts, rng = invented(6, seed=12, words=900)
    base, texts = texts[0].split() * 2, texts[1:]
    for k in range(900):
        w = list(base)
        for _ in range(1 if k % 9 else 12):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs, asked = frame(spark, texts), []
    members = ngram_join._members
    monkeypatch.setattr(ngram_join, "_members", lambda d, placed, pairs: asked.append(pairs.where("i < j").count()) or members(d, placed, pairs))
    want = sorted({r.class_id for r in ngram_join.similar_classes(docs, block=16).collect()})
    every, asked = sum(asked), []
    monkeypatch.setattr(ngram_join, "_members", lambda d, placed, pairs: asked.append(pairs.where("i < j").count()) or members(d, placed, pairs))
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs, block=16, count=False).collect()) == want
    assert 5 < len(want) < 400 and sum(asked) < every / 4


def test_prefixes_are_shortened(spark):
    """Few trees and a deep start miss links, so matched prefixes are shortened until the target is reached."""
    texts, rng = invented(150, seed=4, words=4000)
    near = [t.split() for t in texts]
    for w in near:
        w[len(w) // 2] = "other"
    texts += [" ".join(w) for w in near]
    sets = list(map(shingles, texts))
    want = sum(5 * len(a & b) >= 4 * len(a | b) for a, b in itertools.combinations(sets, 2))
    docs = frame(spark, texts)

    def found(**how):
        got = ngram_join.join(docs, trees=4, deepest=10, floor=2, **how)
        return got.depths, sum(r.links for r in got.found.collect()) / 2

    depths, some = found(target=0.0)
    assert depths == [10] and some < 0.9 * want
    depths, most = found(target=0.98)
    assert len(depths) > 1 and depths == sorted(depths, reverse=True) and depths[-1] < 10
    assert want > 100 and 0.95 * want <= most <= want
    # With production parameters a similarity at the limit needs a shorter prefix than the deepest, others don't.
    share = lambda percent, depth: ngram_join.recall([0] * percent + [1000], ngram_join.TREES, depth, depth)
    assert share(0, ngram_join.DEEPEST) < ngram_join.TARGET_RECALL <= share(0, ngram_join.FLOOR) and share(10, ngram_join.DEEPEST) > ngram_join.TARGET_RECALL
    nodes, below = ngram_join.paths([np.arange(9, dtype=np.uint64)], 3, 2, 4)
    assert nodes.shape == below.shape == (1, 3) and below.max() < 1 << 16


def test_recall_at_the_limit(spark):
    """Pairs from just under to well over the limit of similarity: all at or over it are found."""
    texts, rng = invented(400, seed=8, words=5000)
    for t in texts[:400]:
        w = t.split()
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = list(map(shingles, texts))
    want = {k for k in range(400) if 5 * len(sets[k] & sets[k + 400]) >= 4 * len(sets[k] | sets[k + 400])}
    rows = {r.doc_id: r for r in ngram_join.similar_classes(frame(spark, texts)).collect()}
    got = {k for k in range(400) if rows[k + 400].class_id == k}
    assert len(want) > 150 and got == want


def test_lattice(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, logp = lm_scoring.read_pieces(path)
    lattice = lm_scoring.Lattice.of(pieces, logp)
    known = dict(zip(pieces, logp, strict=True))

    def total(text):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in known:
                out += math.exp(known[text[:k]]) * total(text[k:])
        if text[0] not in known:
            out += math.exp(lattice.unknown * len(text[0].encode())) * total(text[1:])
        return out

    words = ["the", "segment", "ünï", "漢x", "a"]
    got = lattice.log_probabilities([w.encode() for w in words])
    assert np.allclose(got, [math.log(total("▁" + w)) + lattice.stop for w in words])
    docs = frame(spark, invented(60)[0])
    a = lm_scoring.score_documents(docs, path).toPandas().set_index("doc_id").sort_index()
    b = lm_scoring.score_documents(docs, path, heavy=5).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(a.score, b.score) and np.allclose(a.base_score, b.base_score)
    train = collections.Counter(x for r in docs.collect() if not lm_scoring.held_out(r.doc_id) for x in [*r.text.split(), None])
    n, v = sum(train.values()), len(train)
    for r in docs.collect():
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in [*r.text.split(), None])
        assert abs(base - a.base_score[r.doc_id]) < 1e-9 and a.train_tokens[r.doc_id] == n
    # A text's score is the product over its words of the sum over all segmentations, and the end: nothing else.
    lattice = lm_scoring.train(spark, lm_scoring.count_words(docs), path)
    known, stop = dict(zip(pieces, lattice.logp, strict=True)), sum(train[x] for x in [None]) / n
    starts = sum(math.exp(x) for p, x in known.items() if p.startswith("▁"))
    inner = sum(math.exp(x) for p, x in known.items() if not p.startswith("▁"))
    assert abs(starts - 1) < 1e-9 and abs(inner + 256 * math.exp(lattice.unknown) + math.exp(lattice.stop) - 1) < 1e-9
    memo = functools.cache(total)
    for r in docs.collect():
        want = sum(math.log10((1 - stop) * memo("▁" + w) * math.exp(lattice.stop)) for w in r.text.split()) + math.log10(stop)
        assert abs(want - a.score[r.doc_id]) < 1e-6


def test_expected_uses():
    """One round of expectation maximisation against the sum over all segmentations one by one."""
    pieces, logp = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba"], np.log([0.1, 0.2, 0.1, 0.15, 0.2, 0.05, 0.2])
    lattice = lm_scoring.Lattice.of(pieces, logp)
    known = dict(zip(pieces, logp, strict=True))

    def ways(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in known:
                yield from ((text[:k], *w) for w in ways(text[k:]))

    words, times = {"ab": 3, "ba": 1, "abab": 2, "b": 5}, collections.Counter()
    for w, n in words.items():
        found = {x: math.exp(sum(known[p] for p in x)) for x in ways("▁" + w)}
        for x, p in found.items():
            for piece in x:
                times[piece] += n * p / sum(found.values())
    got = lattice.expected([w.encode() for w in words], np.array(list(words.values())))
    assert np.allclose(got, [*(times[p] for p in pieces), 0, sum(words.values())])
    better = lattice.learnt(got)
    old, new = (sum(n * x for n, x in zip(words.values(), m.log_probabilities([w.encode() for w in words]))) for m in (lattice.learnt(np.ones(9)), better))
    assert new > old


def test_quality_classifier(spark):
    texts, rng = invented(400)
    junk = [" ".join(x + "!!" for x in t.upper().split()) for t in texts[300:]]
    docs = frame(spark, texts[:300] + junk)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(250)] + [(390, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality_classifier.classify(docs, labels, quality_classifier.Sample(shard=500)).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert len(kept & set(range(300))) >= 294 and not kept & set(range(300, 400))
    chosen = [(k, True) for k in range(200)]
    own = docs.where("doc_id < 200")
    tri = quality_classifier.trigrams(own, spark.sparkContext.broadcast(quality_classifier.vocabulary(own)))
    model = quality_classifier.train(docs, spark.createDataFrame(chosen, "doc_id bigint, learn boolean"))
    # The model's sums are those of the recursion, and probabilities after a context add up to 1.
    c3 = collections.Counter()
    for t in texts[:200]:
        w = ["<1>", "<2>", *t.split(), "</>"]
        c3.update(zip(w, w[1:], w[2:]))
    c2, c1 = collections.Counter((b, c) for _, b, c in c3), collections.Counter()
    c1.update(c for _, c in c2)
    d3, d2, d1 = (discounts_of(c) for c in (c3, c2, c1))

    def p1(w):
        return max(0, c1[w] - d1[min(3, c1[w])]) / sum(c1.values()) + sum(d1[min(3, x)] for x in c1.values()) / sum(c1.values()) / (len(c1) + 1)

    def p(counts, d, context, w, lower):
        after = {k: x for k, x in counts.items() if k[:-1] == context}
        n = sum(after.values())
        if not n:
            return lower
        x = after.get((*context, w), 0)
        return max(0, x - d[min(3, x)]) / n + sum(d[min(3, y)] for y in after.values()) / n * lower

    def logp(text):
        w = ["<1>", "<2>", *text.split(), "</>"]
        return sum(math.log10(p(c3, d3, (a, b), c, p(c2, d2, (b,), c, p1(c)))) for a, b, c in zip(w, w[1:], w[2:]))

    some = [texts[0], texts[250], "never seen words", texts[1].split()[0], ""]
    _, got = quality_classifier.Scorer(model)([t.encode() for t in some])
    assert np.allclose(got, [logp(t) for t in some], atol=1e-3)
    assert sum(quality_classifier.unpack(r.n).sum() for r in tri.collect()) == sum(c3.values())


def test_thresholds_cover_all_trusted_text(spark):
    texts, _ = invented(300)
    docs = frame(spark, texts[:200]).union(frame(spark, texts[200:], lang="es").withColumn("doc_id", F.col("doc_id") + 200))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(290)], "doc_id bigint, quality int, toxic int")
    sample = quality_classifier.Sample(docs=40, calibrate=10)
    rows = quality_classifier.classify(docs, labels, sample).collect()
    learnt = {r.doc_id for r in quality_classifier.trusted(docs, labels, sample)[1].collect()}
    assert len(learnt) == 40
    for lang in ("en", "es"):
        held = [r for r in rows if r.lang == lang and r.doc_id < 290 and r.doc_id not in learnt]
        mean = sum(r.log_prob for r in held) / sum(r.n_tokens for r in held)
        smooth = [10 ** (-(r.log_prob + 20 * mean) / (r.n_tokens + 20)) for r in held]
        assert len(held) > 50
        assert np.allclose([r.threshold for r in rows if r.lang == lang], 1.05 * np.quantile(smooth, 0.995))
    # A text that doesn't fit leaves room for those after it.
    small = quality_classifier.Sample(docs=40, calibrate=10, words=1000)
    longer = docs.withColumn("text", F.when(F.col("doc_id") == min(learnt, key=lambda k: rank(spark, k)), F.repeat("text", 100)).otherwise(F.col("text")))
    assert quality_classifier.trusted(longer, labels, small)[1].count() > 3


def test_each_language_with_trusted_text_has_its_own_threshold(spark):
    texts, _ = invented(120)
    langs = ["en"] * 100 + ["fr"] * 12 + ["de"] * 8
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(112)], "doc_id bigint, quality int, toxic int")
    sample = quality_classifier.Sample(docs=40, calibrate=40)
    rows = quality_classifier.classify(docs, labels, sample).collect()
    learnt = {r.doc_id for r in quality_classifier.trusted(docs, labels, sample)[1].collect()}
    held = [r for r in rows if r.doc_id < 112 and r.doc_id not in learnt]

    def smooth(r, mean):
        return 10 ** (-(r.log_prob + 20 * mean) / (r.n_tokens + 20))

    for lang in ("en", "fr", "de"):
        own = [r for r in held if lang in ("de", r.lang)]
        assert own
        mean = sum(r.log_prob for r in own) / sum(r.n_tokens for r in own)
        limit = 1.05 * np.quantile([smooth(r, mean) for r in own], 0.995)
        for r in rows:
            if r.lang == lang:
                assert math.isclose(r.threshold, limit) and math.isclose(r.smoothed, smooth(r, mean)) and r.kept == (smooth(r, mean) <= limit)


def test_quantiles(spark):
    rng = random.Random(5)
    rows = [(k, "ab"[k % 3 == 0], rng.choice([1.0, 2.0, rng.random()])) for k in range(400)] + [(400, "one", 7.0), (401, "two", 1.0), (402, "two", 2.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, x double")
    for share in (0.0, 0.3, 0.995, 1.0):
        got = {r.lang: r.q for r in quality_classifier.quantiles(df, "lang", "x", "doc_id", share).collect()}
        assert got.keys() == {"a", "b", "one", "two"}
        assert all(math.isclose(q, np.quantile([x for _, g, x in rows if g == lang], share)) for lang, q in got.items())
    assert quality_classifier.quantiles(df.limit(0), "lang", "x", "doc_id", 0.5).count() == 0


def rank(spark, k):
    return spark.range(1).select(F.xxhash64(F.lit(k).cast("bigint"))).first()[0]


def discounts_of(counts):
    n = collections.Counter(counts.values())
    y = n[1] / (n[1] + 2 * n[2])
    return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y * k, 0.05), k - 0.05) for k in (1, 2, 3))]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    pool = "ab'tréÜß漢 \n\t 12!?<|endoftext|>aaaa\U0001f600 　"
    texts = ["".join(rng.choices(pool, k=rng.randrange(80))) for _ in range(400)] + ["a" * 5000, "x<|endoftext|> <|endoftext|>y", "it's we'll THE'S"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts), path).collect()}
    assert [got[k].n_tokens for k in range(len(texts))] == want
    assert all(got[k].n_bytes == len(t.encode()) and got[k].over_limit == (want[k] > 512) for k, t in enumerate(texts))


def test_the_last_sequence_to_merge_is_counted():
    """A pre-token that is alone in its last step and becomes one token there."""
    merges = token_counts.Merges(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = [" the", "a", " international", " w1", " responsibilities", "!!", " w59999"]
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert merges.counts([w.encode() for w in words]).tolist() == want
    assert [merges.counts([w.encode()]).tolist() for w in words] == [[n] for n in want]


def test_substring_dedup(spark):
    texts, _ = invented(40, words=4000)
    passage, line = texts[0], " ".join(f"a repeated line of twenty words {k}" for k in range(3))
    made = [texts[k] + " " + passage + " " + texts[k + 20] if k % 3 == 0 else texts[k] + "\n" + line for k in range(1, 19)]
    docs = frame(spark, [passage, line, *made])
    rows = {r.doc_id: r for r in substring_dedup.dedup_passages(docs, segments=True).collect()}
    assert rows[0].text == passage and rows[1].text == line
    for k, t in enumerate(made, 2):
        r = rows[k]
        kept, at = "", 0
        for a, b in r.removed:
            kept, at = kept + t[at:a], b
        assert kept + t[at:] == r.text and r.n_removed == len(r.removed)
        if k - 1 in range(3, 19, 3):
            gone = sum(b - a for a, b in r.removed)
            assert gone > 0.5 * len(passage)
            assert not set(texts[k - 1].split()[:10]) - set(r.text.split())
        else:
            assert line not in r.text and texts[k - 1] in r.text


def test_every_repeated_line_goes(spark):
    """Against a plain loop: lines of ten code points or more, normalised, stay in their first document and place."""
    rng = random.Random(4)
    pool = ["Read  more here", "read more\there ", "short one", "ÄÖÜ äöü ßß", "äöü ÄÖÜ ßß", "a b c d e f", "", "  ", "All rights reserved.", "x" * 10, "x" * 9, "Seite drücken"]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(1, 9)) + rng.choices(["own line %d" % k, "tiny"], k=1)) for k in range(60)]
    seen, want = set(), []
    for t in texts:
        kept = ""
        for line in t.splitlines(keepends=True):
            key = " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            if len(key) >= 10 and key in seen:
                continue
            if len(key) >= 10:
                seen.add(key)
            kept += line
        want.append(kept)
    for segments in (False, True):
        rows = {r.doc_id: r for r in substring_dedup.dedup_passages(frame(spark, texts), segments).collect()}
        for k, t in enumerate(texts):
            kept, at = "", 0
            for a, b in rows[k].removed:
                kept, at = kept + t[at:a], b
            assert kept + t[at:] == rows[k].text
            if not segments:
                assert rows[k].text == want[k]


def test_hot_units_take_the_same_way(spark, monkeypatch):
    texts, _ = invented(30, words=100)
    docs = frame(spark, [t + "\nA notice that all texts share" + "\nAnother of some" * (k % 2) for k, t in enumerate(texts)])
    rows = lambda: sorted((r.doc_id, r.text, r.n_removed) for r in substring_dedup.dedup_passages(docs, segments=True).collect())
    before = rows()
    monkeypatch.setattr(substring_dedup, "HOT", 20)
    assert rows() == before
    assert [k for k, t, _ in before if "notice" in t] == [0] and [k for k, t, _ in before if "Another" in t] == [1]


def test_passages_go_whole_but_for_their_edges(spark):
    rng = random.Random(9)
    word = iter(f"w{k}" for k in range(100_000))
    some = lambda n: [next(word) for _ in range(n)]
    passages = [some(rng.randrange(51, 151)) for _ in range(60)]
    texts = [" ".join([*some(9), *p, *some(9)]) for p in passages]
    for k, p in enumerate(passages):
        if k % 3 == 1:  # other line breaks
            p = [x + "\n" if j % 7 == 6 else x for j, x in enumerate(p)]
        texts.append(" ".join([*some(40 if k % 3 else 4), *p, *some(40)]))
    texts += [" ".join(["again"] * 39), "\n".join(texts[0].split())]
    rows = {r.doc_id: r.text for r in substring_dedup.dedup_passages(frame(spark, texts), segments=True).collect()}
    share = []
    for k, p in enumerate(passages):
        assert rows[k] == texts[k]
        left = rows[60 + k].split()
        gone = [x not in left for x in p]
        first, end = gone.index(True), len(gone) - gone[::-1].index(True)
        assert all(gone[first:end])
        assert [x for x in texts[60 + k].split() if x not in p] == [x for x in left if x not in p]
        share.append((end - first) / len(p))
        a, b = substring_dedup.Cutter.segments(np.array([substring_dedup.cut_class(x.strip().encode()) for x in p]), np.zeros(len(p), int), np.array([len(p)]))
        inside = (a > 0) & (b < len(p))
        assert first <= a[inside].min() and end >= b[inside].max()
    assert sum(share) / len(share) > 0.8
    assert rows[120] == texts[120] and not rows[121].split()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]


def test_runs_are_merged_without_a_shuffle(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300), 0, k, k // 250) for k in range(1000)]
    hashes = line_dedup.materialize(spark.createDataFrame(rows, "h1 bigint, h2 bigint, id bigint, batch int").distinct(), "batch")
    runs, plans = line_dedup.Runs(8), []
    write = runs._write
    runs._write = lambda rows: (plans.append(exchanges(rows)), write(rows))[1]
    for k in range(3):
        runs.add(hashes.where(F.col("batch") == k))
    # Each batch is shuffled once; the first two runs become one without a shuffle.
    assert [len(p) for p in plans] == [1, 1, 0, 1]
    assert len(runs.all()) == 2 and [len(x) for x in runs.levels] == [1, 1]
    for run in runs.all():
        assert len(exchanges(hashes.join(run.hint("merge"), ["h1", "h2"]))) == 1
    owner = {}
    for h, _, k, batch in sorted(rows, key=lambda r: r[2]):
        if batch < 3:
            owner.setdefault(h, k)
    got = [r for run in runs.all() for r in run.collect()]
    assert {r.h1: r.owner for r in got} == owner and len(got) == len(owner)


def test_a_later_batch_reads_the_runs(spark, monkeypatch):
    docs = frame(spark, [f"a line that many have\nand line {k % 7} of its own kind" for k in range(60)])
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, 1).collect()}
    for batches, hot in ((4, 1000), (9, 5)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, batches).collect()} == want
    assert [bool(want[k]) for k in range(60)] == [k < 7 for k in range(60)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[k] for k in at]) for r in want.fetchall())


def test_ablation(spark, sf):
    rules = quality_rules
    book = rules.ledger(queries.table(spark, sf, "documents")).cache()
    policy = rules.POLICIES["v2"]
    failed = [r.failed & policy.mask for r in book.collect()]
    rows = {r.rule: r for r in rules.ablation(book, policy).collect()}
    for name in policy.rules:
        bit = rules.BIT[name]
        assert (rows[name].failing, rows[name].alone) == (sum(f & bit > 0 for f in failed), sum(f == bit for f in failed))
        assert (rows[name].docs, rows[name].rejected) == (len(failed), sum(f > 0 for f in failed))


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits), 1)) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def account(rng, country, size):
    """An account code whose check digits hold, and the same with one digit more in the check."""
    body = "".join(rng.choice("0123456789") for _ in range(size))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    check = 98 - number % 97
    return f"{country}{check:02d}{body}", f"{country}{check % 97 + 1:02d}{body}"


def check_context(spark):
    """Whole words alone count, within 40 code points; words against a kind lower its score."""
    rng = random.Random(8)
    texts, want = [], []
    for text, spans in (
        ("syntax 123-45-6789", ""), ("taxi 123-45-6789", ""), ("tax 123-45-6789", "ssn:4:15"), ("123-45-6789 Tax", "ssn:0:11"), ("serial tax 123-45-6789", ""),
        ("tax" + " " * 37 + "123-45-6789", "ssn:40:51"), ("tax" + " " * 38 + "123-45-6789", ""), ("syntax" + "." * 37 + "123-45-6789", ""), ("." + "tax" + "." * 37 + "123-45-6789", "ssn:41:52"),
        ("123-45-6789" + "." * 37 + "tax", "ssn:0:11"), ("123-45-6789" + "." * 37 + "taxi", ""), ("123-45-6789" + "." * 37 + "tax.", "ssn:0:11"), ("123-45-6789" + "." * 38 + "tax", ""),
    ):
        texts.append(text)
        want.append(spans)
    for k in range(60):
        good, bad = account(rng, *rng.choice([("DE", 18), ("NO", 11), ("FR", 23), ("MT", 27)]))
        if k % 2:
            good, bad = (" ".join(x[j : j + 4] for j in range(0, len(x), 4)) for x in (good, bad))
        texts += [f"to {good}.", f"to {bad}."]
        want += [f"iban:3:{3 + len(good)}", ""]
    found = {r.doc_id: [x for x in r.spans.split(",") if x[:3] in ("iba", "ssn")] for r in pii.digest(pii.find_spans(frame(spark, texts))).collect()}
    assert [",".join(found[k]) for k in range(len(texts))] == want
    scored = {r.doc_id: r.scores for r in pii.digest(pii.find_spans(frame(spark, ["1.2.3.4", "host 1.2.3.4", "version 1.2.3.4", "host version 1.2.3.4"]))).collect()}
    assert scored == {0: "0.7", 1: "0.8", 2: "0.5", 3: "0.6"}


def test_pii(spark):
    rng = random.Random(5)
    some = ["4539 1488 0343 6467", "4539148803436467", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "a.b@c.d.e", "@x.y", "x@y", "a@b.c@d.e", "+49 (170) 123-4567", "+1", "é", "\U0001f600", ".", "-", " ", "12", "0", "001.002.003.004", "+", "--"]
    texts = ["".join(rng.choices(some, k=rng.randrange(1, 9))) for _ in range(1500)] + [" ".join(rng.choices(some, k=8)) for _ in range(500)]
    texts += ["x" * 3000 + "@", "1" * 5000, "GB82 WEST 1234 5698 7654 32 is my iban", "ssn 123-45-6789", "123-45-6789", " ".join(["a@b.cd"] * 3000)]
    got = {r.doc_id: r for r in pii.digest(pii.find_spans(frame(spark, texts))).collect()}
    base = ("email", "ip", "card", "phone")
    for k, t in enumerate(texts):
        assert [s for s in got[k].spans.split(",") if s.split(":")[0] in base] == base_spans(t), t
    assert [got[len(texts) - n].spans for n in (4, 3, 2)] == ["iban:0:27", "ssn:4:15", ""]
    check_context(spark)
    redacted = pii.redact(frame(spark, ["to me@x.org, 4539 1488 0343 6467!"])).first().text
    assert redacted == "to [email], [card]!"


def test_decontamination(spark):
    texts, rng = invented(60, words=4000)
    items = texts[:10]
    dirty = []
    for k in range(10):
        part = items[k].split()[3:25]
        part[7] = "changed"  # a substitution within the overlap
        dirty.append(" ".join([*texts[20 + k].split(), *(w.upper() + "," for w in part), "tail"]))
    docs, benchmark = frame(spark, dirty + texts[40:]), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = {r.doc_id: r for r in decontaminate.report(docs, benchmark).collect()}
    assert all(rows[k].contaminated and rows[k].item_ids == [k] and rows[k].most_equal >= 13 for k in range(10))
    assert not any(rows[k].contaminated for k in range(10, 30))
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == set(range(10, 30))


def test_decontamination_folds_unicode(spark):
    item = "El niño comió él «más» peñas rápidas según aquél señor, Straße ﬁnal œuvre être café crème"
    docs = frame(spark, ["antes " + item.upper().replace(" ", "\u00a0") + "… después", "¿" + "? ¡".join(item.split()) + "?", "nada de nada"])
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = {r.doc_id: r.most_equal for r in decontaminate.report(docs, benchmark).collect()}
    assert rows == {0: 16, 1: 16, 2: 0}


def test_decontamination_of_short_items(spark):
    change = lambda words, *at: " ".join(["odd"] * 5 + ["new" if k in at else w for k, w in enumerate(words)] + ["odd"] * 5)
    cases = [(18, 2, 15), (15, 2), (15, 12), (16, 1, 14), (15, 3, 7, 11), (13, 6), (13, 4, 8), (10, 3, 6), (8, 4)]
    fewer = [(18, 2, 5, 8, 11, 14), (13, 3, 6, 9), (8, 2, 5), (7,), (1,)]
    items, texts = [], []
    for k, (n, *at) in enumerate(cases + fewer):
        items.append((k, " ".join(f"item{k}word{j}" for j in range(n))))
        texts.append(change(items[-1][1].split(), *at))
    benchmark = spark.createDataFrame([*items, (90, "the"), (91, "odd odd")], "item_id bigint, text string")
    rows = {r.doc_id: (r.item_ids, r.most_equal) for r in decontaminate.report(frame(spark, texts), benchmark).collect()}
    for k, (n, *at) in enumerate(cases):
        assert rows[k] == ([k], n - len(at)), (n, at)
    assert all(rows[len(cases) + k] == ([], 0) for k in range(len(fewer)))
    left = decontaminate.clean(frame(spark, ["the odd odd ones"]), benchmark)
    assert left.count() == 1
    few = {r.item_id: r.n_tokens for r in decontaminate.unchecked(benchmark).collect()}
    assert few == {k: n for k, (n, *_) in enumerate(cases + fewer) if n < 8} | {90: 1, 91: 2}


def test_masks_miss_nothing():
    """Every placement of substitutions within the tolerance leaves a seed of the masks for that length."""
    for n in range(decontaminate.LEAST_ITEM, decontaminate.WINDOW + 1):
        masks = decontaminate.SEEDS if n == decontaminate.WINDOW else decontaminate.SHORT_SEEDS
        seeds = [int(m, 2) << k for m in masks for k in range(n - len(m) + 1)]
        for changes in range(n - decontaminate.share(n) + 1):
            for at in itertools.combinations(range(n), changes):
                assert any(not s & sum(1 << k for k in at) for s in seeds), (n, at)


def runs_of(item, text):
    """Brute force: for the item on all diagonals of the text, the most equal tokens of a run of windows."""
    wide, best = min(16, len(item)), 0
    for shift in range(1 - len(item), len(text)):
        same = [0 <= k + shift < len(text) and x == text[k + shift] for k, x in enumerate(item)]
        cover = set()
        for k in range(len(item) - wide + 1):
            if 5 * sum(same[k : k + wide]) >= 4 * wide:
                cover |= set(range(k, k + wide))
        run = 0
        for k in range(len(item)):
            run = run + same[k] if k in cover else 0
            best = max(best, run)
    return best


@pytest.mark.parametrize("rows", [10**6, 0])
def test_decontamination_against_all_diagonals(spark, monkeypatch, rows):
    """Items that share lines and windows, texts with edits of all kinds: the same as token by token everywhere."""
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    line = some(12)
    items = [some(rng.randrange(6, 40)) for _ in range(25)] + [line + some(rng.randrange(3, 20)) for _ in range(15)]
    texts = []
    for k in range(160):
        part = list(items[rng.randrange(len(items))])
        for _ in range(rng.randrange(0, 6)):
            part[rng.randrange(len(part))] = f"w{rng.randrange(60)}"
        if k % 3 == 0:
            del part[rng.randrange(len(part))]
        texts.append(some(rng.randrange(0, 20)) + part[rng.randrange(0, 3) :] + (line if k % 5 == 0 else []) + some(rng.randrange(0, 20)))
    want = {}
    for d, t in enumerate(texts):
        found = {k: runs_of(x, t) for k, x in enumerate(items) if len(x) >= 8}
        want[d] = {k: n for k, n in found.items() if n}
    docs = frame(spark, [" ".join(t) for t in texts])
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    got = collections.defaultdict(dict)
    for r in decontaminate.find_overlaps(docs, benchmark).collect():
        got[r.doc_id][r.item_id] = r.equal
    assert {d: got[d] for d in want} == want and sum(map(bool, want.values())) > 80 and not all(want.values())
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == {d for d, x in want.items() if not x}


def test_mixing(spark):
    texts, _ = invented(400)
    rows = [(k, t, "en", "big" if k % 2 else f"s{k % 10}", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    target = mixing.Target(entropy=0.98, repeats=3.0)
    got = mixing.mix_sources(docs, target).collect()
    assert {r.doc_id for r in got} == set(range(400))
    tokens, times = collections.Counter(), collections.Counter((r.doc_id, r.copy) for r in got)
    assert max(times.values()) == 1
    for r in got:
        tokens[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in got}
    total = sum(tokens.values())
    assert abs(sum(weight.values()) - 1) < 1e-6
    assert all(abs(tokens[s] / total - weight[s]) < 0.01 for s in weight)
    assert sum(-w * math.log(w) for w in weight.values()) / math.log(len(weight)) >= 0.98 - 1e-3
    again = mixing.mix_sources(docs.repartition(5), target).collect()
    assert sorted((r.doc_id, r.copy, r.mix_block, r.slot) for r in again) == sorted((r.doc_id, r.copy, r.mix_block, r.slot) for r in got)


def test_mixing_to_a_budget(spark):
    """Against a plain walk through the same draws: sources are cut down or repeated to their share of the tokens."""
    texts, _ = invented(300)
    rows = [(k, t, "en", "big" if k % 3 else f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    draw = lambda *what: int(hashlib.md5(":".join(map(str, (17, *what))).encode()).hexdigest()[:15], 16)
    size = {k: len(t.split()) for k, t, *_ in rows}
    whole = collections.Counter()
    for k, _, _, s, _ in rows:
        whole[s] += size[k]
    total = sum(whole.values())
    for tokens in (total // 3, 3 * total):
        target = mixing.Target(entropy=0.95, repeats=None, tokens=tokens)
        got = collections.defaultdict(list)
        for r in mixing.mix_sources(docs, target).collect():
            got[r.source].append((r.copy, r.doc_id, r.slot, r.weight))
        low, high = 0.0, 1.0
        measure = lambda a: -sum(w * math.log(w) for w in weights(a).values()) / math.log(len(whole))
        weights = lambda a: {s: (n / total) ** a / sum((x / total) ** a for x in whole.values()) for s, n in whole.items()}
        for _ in range(20):
            low, high = ((low + high) / 2, high) if measure((low + high) / 2) >= 0.95 else (low, (low + high) / 2)
        a = round(low, 5)
        assert abs(measure(a) - 0.95) < 1e-3
        for s, n in whole.items():
            budget, want = round(weights(a)[s] * tokens), []
            own = [k for k, _, _, x, _ in rows if x == s]
            blocks = -(-len(own) // max(64, math.sqrt(len(own)))) if len(own) > 64 else 1
            block = {k: int(draw("cell", k) % 65536 * int(blocks) / 65536) for k in own}
            for copy in range(-(-budget // n)):
                at = copy * n
                for b in sorted(set(block.values()), key=lambda b: (draw("block", copy, b), b)):
                    for k in sorted((k for k in own if block[k] == b), key=lambda k: draw("slot", copy, k)):
                        if at + size[k] <= budget or at < budget and size[k] * (draw("edge", copy, k) % 2**20) < (budget - at) * 2**20:
                            want.append((copy, k))
                        at += size[k]
            assert sorted(x[:2] for x in got[s]) == sorted(want)
            assert all(abs(x[3] - weights(a)[s]) < 1e-9 and x[2] == draw("slot", *x[:2]) for x in got[s])


def test_budgets_are_met_on_average(spark):
    """200 sources of one document of 100 words, of which each may give 35: about 70 documents, not all 200."""
    rows = [(k, " ".join(["word"] * 100), f"s{k}") for k in range(200)]
    docs = spark.createDataFrame([*rows, (200, "none", None)], "doc_id bigint, text string, source string")
    mixed = mixing.mix_sources(docs.where("doc_id < 200"), mixing.Target(entropy=1.0, repeats=None, tokens=7000))
    rows = mixing.realised(mixed).collect()
    assert 50 <= len(rows) <= 90 and all(r.n_docs == 1 and r.n_tokens == 100 and r.weight == 0.005 for r in rows)
    assert abs(sum(r.share for r in rows) - 1) < 1e-9
    all_of = {r.source: (r.n_docs, r.n_tokens, r.share) for r in mixing.realised(mixing.mix_sources(docs, mixing.Target(None, None))).collect()}
    assert all_of[None] == (1, 1, 1 / 20001) and len(all_of) == 201
    assert mixing.realised(mixed.limit(0)).count() == 0


def test_pipeline(spark, sf):
    docs = queries.table(spark, sf, "documents")
    rows, step = {r.doc_id: r for r in docs.collect()}, docs
    policy = quality_rules.POLICIES[quality_rules.CURRENT]
    texts = {k: r.text for k, r in rows.items() if not quality_rules.measure((r.text or "").encode())[-1] & policy.mask}
    keys = {k: [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)}) for x in t.split("\n")] for k, t in texts.items()}
    owner = {}
    for k in sorted(keys):
        for x in keys[k]:
            owner.setdefault(x, k)
    texts = {k: "\n".join(x for x, y in zip(t.split("\n"), keys[k], strict=True) if len(y) < 10 or owner[y] == k) for k, t in texts.items()}
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if sets[a] == sets[b] or small >= 0.8 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if r == y else r for k, r in root.items()}
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "line_dedup", "ngram_join"):
        step = stages[name](spark, step, sf)
    assert {r.doc_id: r.text for r in step.collect()} == {k: texts[k] for k in set(root.values())}
    final = corpus_pipeline.run(spark, sf)
    found = {r.doc_id for r in decontaminate.report(step, queries.table(spark, sf, "benchmark")).collect() if r.contaminated}
    assert {r.doc_id for r in final.select("doc_id").collect()} == set(root.values()) - found
