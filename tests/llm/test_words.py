"""Source audit, packing and spelling variants against brute force and the public library, also on odd tables."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isospan.llm import packing, queries, source_audit, spelling

SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHES = ("n", "p", "p0", "key", "half", "word", "near", "term", "item", "value", "all", "v")


def frame(spark, rows):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in CLASHES))


def audit(rows, least, ranks):
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, lang, source in rows]
    found = []
    for lang in {x for x, _, _ in terms}:
        own = [(s, ts) for x, s, ts in terms if x == lang]
        having = collections.Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t, k in having.items() if k >= least)
        count = collections.defaultdict(collections.Counter)
        for s, ts in own:
            count[s].update(t for t in ts if t in kept)
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(count[s]) for s in count}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s)
            more = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])
            for part, ranked in (("pair", pairs), ("term", more[:ranks])):
                found += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(ranked, 1)]
    return sorted(found)


def test_audit(spark):
    rng = random.Random(3)
    pool = ["the", "Naïve", "ÉTÉ", "été", "a", "漢字", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(k, " ".join(rng.choices(pool[: 5 + k % 20], k=rng.randrange(30))) + ".x-y", rng.choice(["en", "de", None]), f"s{rng.randrange(5)}") for k in range(120)]
    rows += [(1, None, "en", None), (2, "", "fr", "only"), (2, "rare words", "fr", "a"), (None, "1 2 3", "en", "bare")] * 2
    got = sorted(map(tuple, source_audit.audit_sources(frame(spark, rows), 8, 4).collect()))
    assert got == audit(rows, 8, 4)
    assert {r[4] for r in got if r[0] == "fr"} == {0} and any(r[1] == "bare" for r in got)
    assert source_audit.audit_sources(frame(spark, rows[:0])).count() == 0


def test_audit_has_whole_numbers_for_large_counts(spark):
    counts = spark.createDataFrame([(10**15, 10**15 + 7, 12)], "n bigint, all bigint, v bigint")
    assert counts.select(source_audit._p("n", "all")).first()[0] == 1 + 10**9 * (10**15 + 2) // (10**15 + 7 + 24)


ODD = [
    (1, "The <|endoftext|> token, <|ENDOFTEXT|> none. It's we'll don't 'S 'LL x<|endoftext|>.", "en", "a"),
    (1, "The <|endoftext|> token", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \n\t\x0b\x0c\r ", "en", "a"),
    (None, "a.b.c ... ., 1.5, 12,000. İstanbul ΑΣ. é. Å K \x1c\x85\xa0　z \U0001f600. ½. x́.", "en", "a"),
    (5, "Lorem ipsum, dolor! " * 3000, "en", "a"),
    (6, "x" * 30_000, "en", "a"),
]


@pytest.mark.parametrize("size,window", [(packing.SLICE, 4096), (50, 6)])
def test_packing(spark, monkeypatch, size, window):
    rng = random.Random(5)
    rows = ODD + [(k, " ".join(f"wörd{rng.randrange(99)}," for _ in range(rng.randrange(900))), "en", "a") for k in range(10, 110)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, _, _ in rows)
    coder = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    own = collections.Counter((i, b"".join(coder([p])[0] for p in packing.slices((t or "").encode(), size)) + b"\1\0\0\0") for i, t, _, _ in rows)
    assert own == want
    pieces = packing.pack_documents(frame(spark, rows).repartition(3), public_tokenizers.path("word_bpe_49k.json"), window=window).collect()
    got, cuts = collections.Counter(), 0
    by_doc = collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_doc[p.doc_id, p.doc_tokens].append(p)
    for (doc_id, n), own in by_doc.items():
        if doc_id == 1 or n == 1:  # repeated ids can't be told apart
            continue
        own.sort(key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at
            at += p.length
        assert at == n
        got[doc_id, b"".join(p.ids for p in own)] += 1
        cuts += len(own) - 1 - n // 2048
    assert all(want[k] == v for k, v in got.items()) and len(got) == len({(i, t) for i, t in want if i != 1 and len(t) > 4})
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    short = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
        short += at < 2048
    assert short <= 3 * 11 and sum(p.length for p in pieces) == sum(len(t) // 4 * n for (_, t), n in want.items())
    assert cuts <= len(sequences)
    assert packing.pack_documents(frame(spark, rows[:0]), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_fill_is_the_best_subset_sum():
    rng = random.Random(7)
    for _ in range(200):
        room = rng.randrange(1, 60)
        counts = np.zeros(65, np.int64)
        for _ in range(rng.randrange(1, 8)):
            counts[rng.randrange(1, 65)] += rng.randrange(1, 4)
        sums = {0}
        for length in np.flatnonzero(counts):
            for _ in range(counts[length]):
                sums |= {s + int(length) for s in sums}
        chosen = packing.fill(counts, room)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(0 < n <= counts[k] for k, n in chosen.items())


def edits(w, letters):
    near = {w[:k] + w[k + 1 :] for k in range(len(w))}
    near |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
    return (near | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}) - {w}


def variants(rows, least, count, times):
    words = collections.Counter()
    for i, t, _, _ in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            words[r if h % 31 else r[: h % len(r)] + r[h % len(r) + 1 :]] += 1
    words = {w: n for w, n in words.items() if len(w) >= least and n >= count}
    letters = {c for w in words for c in w}
    near = {w: [o for o in edits(w, letters) if o in words] for w in words}
    form = {w: min(near[w], key=lambda o: (-words[o], o)) for w in words if near[w]}
    form = {w: o for w, o in form.items() if words[o] >= times * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.mark.parametrize("least,times", [(7, 10), (2, 2)])
def test_spelling(spark, least, times):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abÉé") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    weights = [3 ** (k % 8) for k in range(60)]
    rows = [(k, " ".join(rng.choices(pool, weights, k=60)) + rng.choice(["", "-Abcdefgh", "1ÀBCDEFGh÷×"]), "en", "a") for k in range(80)]
    rows += [(90, "chainaa " * 2 + "chainab " * 6 + "chainbb " * 20 + "chainbc " * 20, "en", "a")]
    rows += [(None, "abcdefgh abcdefgh", None, None), (3, None, None, None), (4, "", None, None), (5, "x" * 5000 + " " + "x" * 5001 + " y" + "x" * 4999, None, None)] * 2
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(frame(spark, rows), least=least, times=times).collect()}
    short = [r for r in rows if r[0] != 5 or not r[1].startswith("x")]
    want = variants(short, least, 2, times)
    long = {w: v for w, v in got.items() if len(w) > 100}
    assert {w: v for w, v in got.items() if len(w) <= 100} == want
    assert any(v[0] for v in want.values()) and any(v[1] not in (w, v[0]) for w, v in want.items()) == (times == 2)
    assert len(long) == 3 and sorted(v[3] for v in long.values()) == [1, 1, 2]
    assert spelling.group_variants(frame(spark, rows[:0])).count() == 0


def test_spelling_meets_few_others(spark):
    """Anagrams of one another don't all meet: rows that are compared stay near those that are near."""
    rng = random.Random(11)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(3000)}
    keys = spelling.anagram_keys(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"))
    met = keys.groupBy("key", "half").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert keys.groupBy("word").count().agg(F.max("count")).first()[0] <= 14
    assert met < 40 * len(words)


def test_registered():
    assert {"op11_source_audit", "op12_packing", "op13_spelling"} <= queries.QUERIES.keys()
