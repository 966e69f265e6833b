"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from isospan.llm import (
    decontaminate,
    line_dedup,
    lm_scoring,
    mixing,
    ngram_join,
    pii,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_counts,
)

#: Names that the operators use themselves.
CLASHES = "id bigint, h1 bigint, h2 bigint, n bigint, word string, key bigint, weight string, copy string, kept string, failed string, n_lines string, removed string, score string, found string, root string, drops string, tokens string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"
FILL = (1, 2, 3, 4, "w", 5, *["x"] * 11)
LONG = " ".join(f"w{k}" for k in range(60_000))
TEXTS = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "One two three  four five six seven eight nine ten", None, "b"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "a"),
    (7, "x" * 100_000, "en", "a"),
    (None, "a line of more than ten\nbare", None, None),
    (None, None, None, None),
    (8, "a line of more than ten\nother\na line of more than ten", "fr", "c"),
    (9, "naïve Ünïcode 漢字 \U0001f600 mail me@example.org or +49 170 1234567", "xx", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *FILL) for i, t, lang, s in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (6, 1, 0), (None, 1, 0), (8, 1, 0), (9, 1, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight nine"), (None, None), (3, "")], "item_id bigint, text string")


def operators(labels, benchmark):
    piece, byte = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
    return {
        "mixing": mixing.mix_sources,
        "ngram_join": ngram_join.similar_classes,
        "lm_scoring": lambda d: lm_scoring.score_documents(d, piece, rounds=1),
        "quality_classifier": lambda d: quality_classifier.classify(d, labels),
        "token_counts": lambda d: token_counts.count_tokens(d, byte),
        "substring_dedup": substring_dedup.dedup_passages,
        "line_dedup": line_dedup.dedup_lines,
        "quality_rules": lambda d: quality_rules.apply_policy(quality_rules.ledger(d), quality_rules.BASE),
        "pii": lambda d: pii.digest(pii.find_spans(d)),
        "decontaminate": lambda d: decontaminate.find_overlaps(d, benchmark),
        "report": lambda d: decontaminate.report(d, benchmark),
    }


@pytest.mark.parametrize("name", ["mixing", "ngram_join", "lm_scoring", "quality_classifier", "token_counts", "substring_dedup", "line_dedup", "quality_rules", "pii", "decontaminate", "report"])
def test_odd_tables(docs, labels, benchmark, name):
    run = operators(labels, benchmark)[name]
    assert run(docs.limit(0)).count() == 0
    rows = run(docs).collect()
    ids = {r.doc_id for r in rows}
    if name == "decontaminate":
        assert sorted((r.doc_id, r.item_id, r.equal) for r in rows) == [(1, 1, 8), (1, 1, 8), (2, 1, 8)]
    elif name == "report":
        assert sorted(r.doc_id for r in rows if r.contaminated) == [1, 2] and len(rows) == 10
    elif name == "mixing":
        assert ids == {i for i, *_ in TEXTS} and len(rows) >= len(TEXTS)
    else:
        assert len(rows) == len(TEXTS) and ids == {i for i, *_ in TEXTS}
    if name == "ngram_join":
        got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in rows if r.doc_id is not None}
        assert got[1] == got[2] == (1, 1, 0) and got[3] == got[4] == got[5] == (3, 3, 0) and got[6] == (6, 6, 0)
    if name == "line_dedup":
        got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in rows}
        assert got[8, "a line of more than ten\nother\na line of more than ten"] == (3, 0) and got[None, "bare"] == (2, 1)
        assert got[None, None] == (1, 0) and got[2, TEXTS[2][1]] == (1, 0)
    if name == "lm_scoring":
        assert all(r.score < 0 and r.base_score < 0 and r.n_tokens >= 1 for r in rows)


def test_values_on_odd_tables(spark, docs, labels, benchmark):
    """What each operator says of null, empty, blank and repeated texts."""
    run = operators(labels, benchmark)
    by = lambda name: {r.doc_id: r for r in run[name](docs).collect()}
    counts = by("token_counts")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    for k, t, *_ in TEXTS:
        if k is not None:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (counts[k].n_tokens, counts[k].n_bytes, counts[k].over_limit) == (n, len((t or "").encode()), n > 512), k
    rules = by("quality_rules")
    assert {k: rules[k].n_words for k in (1, 3, 4, 5, 6, 7, 8)} == {1: 10, 3: 0, 4: 0, 5: 0, 6: 60_000, 7: 1, 8: 13}
    assert [rules[k].n_dup_lines for k in (3, 4, 8)] == [0, 0, 1] and not rules[3].kept and rules[6].kept
    pii_rows = by("pii")
    assert [pii_rows[k].spans for k in (3, 4, 6, 7)] == [""] * 4 and (pii_rows[9].n_email, pii_rows[9].n_phone) == (1, 1)
    scores = by("quality_classifier")
    assert all(scores[k].n_tokens == 1 for k in (3, 4, 5)) and scores[3].lang == "en" and scores[2].lang == ""
    assert scores[4].log_prob == scores[3].log_prob == scores[5].log_prob < 0
    passages = by("substring_dedup")
    assert all(passages[k].n_removed == 0 for k in (3, 4, 5, 6, 7, 9)) and passages[2].n_removed == 1 and passages[2].text.strip() == ""
    mixed = by("mixing")
    assert all(mixed[k].n_tokens == 1 for k in (3, 4, 5)) and mixed[6].n_tokens == 60_000
    few = sorted(((r.item_id, r.n_tokens) for r in decontaminate.unchecked(benchmark).collect()), key=str)
    assert few == [(3, 0), (None, 0)] and decontaminate.unchecked(benchmark.limit(0)).count() == 0


def test_rest_of_the_interface_on_odd_tables(docs, benchmark):
    every = len(TEXTS)
    ids = lambda rows: sorted((r.doc_id for r in rows.collect()), key=str)
    assert ids(decontaminate.clean(docs, benchmark)) == ids(docs.where("doc_id IS NULL OR doc_id > 2"))
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == every and decontaminate.clean(docs.limit(0), benchmark).count() == 0
    assert ids(quality_rules.keep(docs, quality_rules.POLICIES[quality_rules.CURRENT])) == [6]
    assert quality_rules.keep(docs.limit(0), quality_rules.BASE).count() == 0
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert redacted[9].endswith("mail [email] or [phone]") and redacted[3] in (None, "") and redacted[4] == "" and redacted[6] == LONG
    assert pii.redact(docs).count() == every and pii.redact(docs.limit(0)).count() == 0
    left = ngram_join.keep_one(docs)
    # The rows without an id are one document, of which one text is empty: a copy of 3.
    assert ids(left) == [1, 3, 6, 7, 8, 9] and left.schema == docs.schema and ngram_join.keep_one(docs.limit(0)).count() == 0


def test_stages_keep_columns(spark, docs, tmp_path):
    """Each stage on odd rows, and one on what the others leave: columns, rows and session settings."""
    spark.createDataFrame([(1, "nothing")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {
        "quality_rules": [6],
        "line_dedup": [i for i, *_ in TEXTS],
        "ngram_join": [1, 3, 6, 7, 8, 9],
        "decontamination": [i for i, *_ in TEXTS],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.schema == docs.schema and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert sorted((r.doc_id for r in left.collect()), key=str) == sorted(rows[name], key=str), name
    lines = {(r.doc_id, r.source): r for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert lines[3, None].text is None and lines[3, None].n_chars is None and lines[4, "a"].text == ""
    assert lines[1, "a"].text == TEXTS[0][1] and lines[8, "c"].text == TEXTS[10][1] and lines[None, None].doc_id is None
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked = {key: spark.conf.get(key) for key in corpus_pipeline.BATCHES}
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {key: spark.conf.get(key) for key in corpus_pipeline.BATCHES} == asked
    assert [(r.doc_id, r.text == LONG, r.weight, r["copy"], r.n_tokens) for r in mixed] == [(6, True, 1.0, 0, 60_000)]
