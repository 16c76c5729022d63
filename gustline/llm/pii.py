"""Personal data by patterns, checksums and context, in DataFrame functions alone.

A pattern proposes spans, a checksum or range confirms them, and words nearby
adjust their score. Where a match starts follows from the lengths of what
``split`` leaves between the matches of ``regexp_extract_all``, since both scan
a text with the same matcher.

The patterns are possessive where nothing could match after giving back, and
tied to the start of a run (or to the end of the match before) where a later
start in the run can't match either. So matches are those of the plain patterns
in the comments, but long runs cost no stack and no quadratic time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    base kinds are always kept once confirmed; others need a score of ``cut``.
    score: of a confirmed span; near: words that raise it by ``lift`` where they
    stand within ``reach`` code points before the span.
    """

    name: str
    pattern: str
    gate: str
    confirm: str
    score: float
    near: str
    lift: float = 0.2
    base: bool = True
    cut: float = 0.6


def _luhn(d: str) -> str:
    c = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    return f"(aggregate(sequence(1, greatest(length({d}), 1)), 0L, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {c} ELSE (2 * {c}) div 10 + (2 * {c}) % 10 END) % 10 = 0)"


def _mod97(s: str) -> str:
    """Characters in the order that the check wants; a letter counts as two digits, A = 10."""
    v = f"(ascii(substring({s}, i, 1)) - CASE WHEN ascii(substring({s}, i, 1)) >= 65 THEN 55 ELSE 48 END)"
    return f"(aggregate(sequence(1, greatest(length({s}), 1)), 0, (a, i) -> (a * CASE WHEN {v} > 9 THEN 100 ELSE 10 END + {v}) % 97) = 1)"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_IBAN = "replace(m, ' ', '')"
KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(__pii_text, '@')", "true", 0.8, "mail|contact|kontakt|correo|courriel"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "__pii_digits AND contains(__pii_text, '.')", f"m rlike '^{_BYTE}(?:[.]{_BYTE}){{3}}$'", 0.6, "ip|host|server|address|adresse"),
    # [0-9]([\x20-]?[0-9])+, 13 to 19 digits that pass Luhn
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "__pii_digits", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_luhn(_DIGITS)}", 0.8, "card|visa|credit|karte|tarjeta|carte"),
    # \+[0-9][\x20().0-9-]+[0-9], 9 to 15 digits
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "__pii_digits AND contains(__pii_text, '+')", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.7, "phone|call|tel|mobile|fax"),
    # country, check digits and groups of an account number; mod-97 must be 1, and a word say what it is (one in 97 passes by chance)
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "__pii_digits", f"length({_IBAN}) BETWEEN 15 AND 34 AND {_mod97(f'concat(substring({_IBAN}, 5), left({_IBAN}, 4))')}", 0.5, "iban|account|konto|cuenta|compte|bank", base=False),
    # three, two and four digits: only beside a word that says what they are
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "__pii_digits AND contains(__pii_text, '-')", "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' AND substring(m, 5, 2) <> '00' AND right(m, 4) <> '0000'", 0.4, "ssn|social security|sozialversicherung", base=False),
    # twenty or more letters and digits, both of them: only beside a word that says they are a secret
    Kind("secret", r"[A-Za-z0-9_-]{20,}+", "__pii_digits", "m rlike '[0-9]' AND m rlike '[A-Za-z]'", 0.4, "token|secret|password|passwd|api[_ -]?key", base=False),
]
REACH = 40


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_NONE = "cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)"


def _spans(k: Kind, matches: str, text: str) -> str:
    """SQL for the confirmed, scored spans of one kind."""
    # (next position, spans so far): only confirmed spans are copied from step to step
    step = _let("at", "a.pos + length(between[i])", f"struct(at + length(m) as pos, CASE WHEN {k.confirm} THEN concat(a.got, array(struct(at as start, at + length(m) as end))) ELSE a.got END as got)")
    placed = f"aggregate(sequence(0, size({matches}) - 1), struct(0 as pos, cast(array() as array<struct<start:int,end:int>>) as got), (a, i) -> {_let('m', f'{matches}[i]', step)}, a -> a.got)"
    before = f"lower(substring({text}, greatest(s.start - {REACH}, 0) + 1, least({REACH}, s.start)))"
    score = f"round(least(1.0D, {k.score}D + CASE WHEN {before} rlike '{k.near}' THEN {k.lift}D ELSE 0.0D END), 2)"
    scored = f"transform({_let('between', f'split({text}, {_literal(k.pattern)}, -1)', placed)}, s -> struct('{k.name}' as kind, s.start as start, s.end as end, {score} as score))"
    if not k.base:
        beside = f"CASE WHEN s.start > 0 THEN substring({text}, s.start, 1) ELSE '' END"
        scored = f"filter({scored}, s -> s.score >= {k.cut}D AND NOT {beside} rlike '[A-Za-z0-9]' AND NOT substring({text}, s.end + 1, 1) rlike '[A-Za-z0-9]')"
    return f"CASE WHEN size({matches}) > 0 THEN {scored} ELSE {_NONE} END"


def with_spans(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """docs with the column ``to``: an array of (kind, start, end, score), by kind as in KINDS and then by start.

    start and end count code points, end exclusive. Spans of one kind don't
    overlap; those of two kinds may. A null text has no spans; equal rows are
    searched each on their own; an empty table gives no rows; nothing is
    shuffled and all other columns stay.
    """
    own = {k.name: f"__pii_{k.name}" for k in KINDS}
    # one projection per step, so that each scan of a text runs once
    out = docs.withColumn("__pii_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = out.withColumn("__pii_digits", F.expr("__pii_text rlike '[0-9]'"))
    out = out.withColumns({own[k.name]: F.expr(f"CASE WHEN {k.gate} THEN regexp_extract_all(__pii_text, {_literal(k.pattern)}, 0) ELSE cast(array() as array<string>) END") for k in KINDS})
    out = out.withColumns({f"{own[k.name]}_s": F.expr(_spans(k, own[k.name], "__pii_text")) for k in KINDS})
    out = out.withColumn(to, F.concat(*(F.col(f"{own[k.name]}_s") for k in KINDS)))
    return out.drop("__pii_text", "__pii_digits", *own.values(), *(f"{x}_s" for x in own.values()))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: how many spans of each base kind, the hash of the base spans, all spans, and their scores in the same order.

    A null or empty text has no spans; rows with the same doc_id come each on
    their own; other columns are left out; an empty table gives no rows.
    """
    base = [k.name for k in KINDS if k.base]
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{n}'))").cast("long").alias(f"n_{n}") for n in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with each span replaced by its kind in brackets, and n_chars, if there, counted anew.

    Overlapping spans become one gap under the name of the first. A null text
    stays null; other columns stay as they are.
    """
    found = with_spans(docs, to="__pii")
    gap = "CASE WHEN s.start < a.pos THEN struct(greatest(a.pos, s.end) as pos, a.done as done) ELSE struct(s.end as pos, concat(a.done, substring(text, a.pos + 1, s.start - a.pos), '[', upper(s.kind), ']') as done) END"
    order = "array_sort(__pii, (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE y.end - x.end END)"
    clean = f"CASE WHEN size(__pii) = 0 THEN text ELSE aggregate({order}, struct(0 as pos, '' as done), (a, s) -> {gap}, a -> concat(a.done, substring(text, a.pos + 1))) END"
    out = found.withColumn("text", F.expr(clean)).drop("__pii")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
