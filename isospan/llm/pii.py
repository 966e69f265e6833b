"""Personal data by patterns, checksums and context, in DataFrame functions alone.

A pattern proposes spans, a validator (number ranges, Luhn, mod-97) confirms them, and words near a span raise or
lower its score. Splitting a text at a pattern gives the gaps between its matches, so running sums of the lengths of
gaps and matches are the offsets, in code points.

Each pattern is written so that a search passes over a text once: possessive runs, and starts only where a run
starts or where the match before it ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_view

#: Code points on either side of a span in which whole context words count; a neighbouring match of the kind ends them.
CONTEXT = 40
#: What words that speak for a kind add to a score (more to kinds beyond the base), and what words against it take off.
FOR, FOR_OTHERS, AGAINST = 0.1, 0.3, 0.2
#: Score from which a span beyond the base kinds is reported.
LEAST_SCORE = 0.5
_CHUNK = 1024


@dataclass(frozen=True)
class Kind:
    """valid: SQL over the matched string m. prior: the score of a valid match without context words. words speak for it,
    against those for something else."""

    name: str
    guard: str
    pattern: str
    valid: str
    prior: float
    words: str
    against: str
    base: bool = True


def luhn(digits: str) -> str:
    """SQL: the digits of a string pass Luhn's test."""
    return (
        f"aggregate(sequence(1, length({digits})), 0L, (s, i) -> s + "
        f"(int(substr({digits}, -i, 1)) * (2 - i % 2)) div 10 + (int(substr({digits}, -i, 1)) * (2 - i % 2)) % 10) % 10 = 0"
    )


def mod97(code: str) -> str:
    """SQL: an account code, its first four characters moved to its end and letters read as 10 to 35, is 1 modulo 97."""
    return (
        f"aggregate(split(concat(substr({code}, 5), left({code}, 4)), ''), 0, (r, c) -> CASE WHEN c = '' THEN r "
        f"WHEN c >= 'A' THEN (r * 100 + ascii(c) - 55) % 97 ELSE (r * 10 + ascii(c) - 48) % 97 END) = 1"
    )


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_CODE = "replace(m, ' ', '')"

KINDS = (
    Kind(
        "email",
        "contains(text, '@')",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        0.9,
        "e-?mails?|mails?|contact|write|courriel|correo",
        "example|sample|noreply",
    ),
    Kind(
        "ip",
        "contains(text, '.')",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        "forall(split(m, '[.]'), p -> length(ltrim('0', p)) < 3 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))",
        0.7,
        "ip|address|host|server|adresse",
        "version|release|build|section",
    ),
    Kind(
        "card",
        "true",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        luhn(_DIGITS),
        0.8,
        "cards?|visa|credit|karte|carte|tarjeta",
        "order|isbn|tracking|serial",
    ),
    Kind(
        "phone",
        "contains(text, '+')",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        f"length({_DIGITS}) BETWEEN 8 AND 15",
        0.7,
        "phones?|call|tel|mobile|telefon|telephone",
        "order|invoice|part",
    ),
    Kind(
        "iban",
        "true",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        f"length({_CODE}) BETWEEN 15 AND 34 AND {mod97(_CODE)}",
        0.7,
        "iban|accounts?|bank|konto|compte|cuenta",
        "sample|serial|order",
        base=False,
    ),
    Kind(
        "ssn",
        "contains(text, '-')",
        r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
        "true",
        0.3,
        "ssn|social|security|tax",
        "part|model|serial|order",
        base=False,
    ),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with value by that name, found once. What a lambda reads from outside it would be found anew for each
    element, so that a text with many matches would cost their square."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _sums(array: str) -> str:
    """SQL: running sums of an array that isn't long."""
    return f"slice(aggregate({array}, array(0L), (s, x) -> concat(s, array(element_at(s, -1) + x))), 2, size({array}))"


def _running(steps: str) -> str:
    """SQL: running sums of an array, in chunks, which are short, as are their sums."""
    chunk = f"slice(steps, int(k * {_CHUNK} + 1), {_CHUNK})"
    chunks = f"transform(sequence(0L, (size(steps) - 1) div {_CHUNK}), k -> {_let('part', chunk, _sums('part'))})"
    ends = _let("ends", "transform(chunks, c -> element_at(c, -1))", _sums("ends"))
    shifted = "flatten(transform(chunks, (c, k) -> transform(c, x -> x + get(totals, k) - element_at(c, -1))))"
    return _let("steps", steps, _let("chunks", chunks, _let("totals", ends, shifted)))


def _near(words: str) -> str:
    """SQL: a whole word of these stands within CONTEXT of match i of a kind. Of a longer gap one code point more is
    seen, which tells whether the outermost word is whole."""
    word, start, end = f"(?:{words})", "(?:^|[^A-Za-z])", "(?:[^A-Za-z]|$)"
    sides = (("left", "get(gaps, i + 1)", f"{start}{word}[^A-Za-z]"), ("right", "get(gaps, i)", f"[^A-Za-z]{word}{end}"))
    return " OR ".join(
        f"IF(length({gap}) > {CONTEXT}, {cut}({gap}, {CONTEXT + 1}) RLIKE '(?i){far}', {gap} RLIKE '(?i){start}{word}{end}')" for cut, gap, far in sides
    )


def _spans(k: Kind) -> str:
    """SQL: the spans of a kind in the text."""
    gain = FOR if k.base else FOR_OTHERS
    score = f"round({k.prior}D + IF({_near(k.words)}, {gain}D, 0D) - IF({_near(k.against)}, {AGAINST}D, 0D), 2)"
    span = f"named_struct('kind', '{k.name}', 'start', get(starts, i), 'end', get(starts, i) + length(m), 'score', {score})"
    least = "" if k.base else f" AND x.score >= {LEAST_SCORE}D"
    kept = f"filter(transform(matches, (m, i) -> CASE WHEN {k.valid} THEN {span} END), x -> x IS NOT NULL{least})"
    # A match starts behind all gaps up to it and all matches before it.
    steps = "slice(zip_with(gaps, concat(array(''), matches), (g, m) -> bigint(length(g) + length(m))), 1, size(matches))"
    kept = _let("gaps", f"split(text, r'{k.pattern}', -1)", _let("starts", _running(steps), kept))
    none = "cast(array() AS array<struct<kind:string,start:bigint,end:bigint,score:double>>)"
    some = _let("matches", f"regexp_extract_all(text, r'({k.pattern})', 1)", f"IF(size(matches) = 0, {none}, {kept})")
    return f"IF({k.guard}, {some}, {none})"


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and, in ``found``, an array of (kind, start, end, score): spans by kind in the order of KINDS, then by
    start; offsets in code points, the end exclusive.

    Spans of base kinds are always in; those of other kinds from LEAST_SCORE on. A null or empty text has none; a
    null doc_id stays null; repeated rows give repeated rows; an empty table gives none. Further columns are left out.
    """
    out = doc_view(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return out.select("doc_id", F.concat(*(F.expr(_spans(k)) for k in KINDS)).alias("found"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """From find_spans(): counts of the base kinds, the SHA-256 of the base spans as text, all spans as text, and
    their scores."""
    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *(F.expr(f"bigint(size(filter(found, x -> x.kind = '{n}')))").alias(f"n_{n}") for n in base),
        F.sha2(_written(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with all columns, each confirmed match in text replaced by its kind in brackets.

    Kinds that need context words to be reported stay. Matches are replaced kind after kind, so a span inside one
    already replaced is gone. Null text stays null.
    """
    for k in KINDS:
        if k.base or k.prior >= LEAST_SCORE:
            own = docs.withColumns(
                {
                    "__matches": F.regexp_extract_all("text", F.lit(f"({k.pattern})"), F.lit(1)),
                    "__gaps": F.split("text", k.pattern, -1),
                }
            )
            marks = F.expr(f"transform(__matches, m -> IF({k.valid}, '[{k.name}]', m))")
            told = F.array_join(F.zip_with("__gaps", marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
            docs = own.withColumn("text", F.when(F.size("__matches") > 0, told).otherwise(F.col("text")))
            docs = docs.drop("__matches", "__gaps")
    return docs
