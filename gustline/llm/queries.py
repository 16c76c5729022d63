"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm.common import table
from gustline.llm.tokens import default_tokenizer


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for toxicity, learned from the labels that are not held out."""
    from gustline.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hash, spans and scores of the personal data in every document."""
    from gustline.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


#: Pattern and confirmation of each kind in DuckDB's terms, m being the match, t the text, b and e its start and end.
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (length({_D}) - i) % 2 = 0 THEN {_D}[i]::INT ELSE 2 * {_D}[i]::INT // 10 + 2 * {_D}[i]::INT % 10 END FOR i IN range(1, length({_D}) + 1)]) % 10 = 0"
_NUMBERED = "list_aggregate([CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END FOR c IN string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), '')], 'string_agg', '')"
_OUTSIDE = "NOT regexp_matches(CASE WHEN b > 0 THEN substr(t, b, 1) ELSE '' END, '[A-Za-z0-9]') AND NOT regexp_matches(substr(t, e + 1, 1), '[A-Za-z0-9]')"
_NEAR = "lower(substr(t, greatest(b - 40, 0) + 1, least(40, b)))"
#: Kind, pattern, confirmation, score, words nearby that raise it by 0.2.
_PII = [
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true", 0.8, "mail|contact|kontakt|correo|courriel"),
    ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "list_max([try_cast(x AS HUGEINT) FOR x IN string_split(m, '.')]) <= 255", 0.6, "ip|host|server|address|adresse"),
    ("card", "[0-9]([ -]?[0-9])+", f"length({_D}) BETWEEN 13 AND 19 AND {_LUHN}", 0.8, "card|visa|credit|karte|tarjeta|carte"),
    ("phone", "\\+[0-9][ ().0-9-]+[0-9]", f"length({_D}) BETWEEN 9 AND 15", 0.7, "phone|call|tel|mobile|fax"),
    ("iban", "[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?", f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [x::INT FOR x IN string_split({_NUMBERED}, '')]), lambda p, q: (p * 10 + q) % 97) = 1 AND {_OUTSIDE}", 0.5, "iban|account|konto|cuenta|compte|bank"),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", f"substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(m, 5, 2) <> '00' AND m[-4:] <> '0000' AND {_OUTSIDE}", 0.4, "ssn|social security|sozialversicherung"),
    ("secret", "[A-Za-z0-9_-]{20,}", f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND {_OUTSIDE}", 0.4, "token|secret|password|passwd|api[_ -]?key"),
]


def _pii_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, t, {i} AS k, '{name}' AS kind, unnest(m) AS m, unnest([list_sum([length(x) FOR x IN s[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) FOR i IN range(1, len(m) + 1)])::BIGINT AS b, '{name}' AS n "
        f"FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS s FROM documents) WHERE len(m) > 0"
        for i, (name, pattern, *_) in enumerate(_PII)
    )
    confirm = " ".join(f"WHEN '{name}' THEN {c}" for name, _, c, _, _ in _PII)
    score = "CAST(CASE kind " + " ".join(f"WHEN '{name}' THEN {s} + CASE WHEN regexp_matches({_NEAR}, '{near}') THEN 0.2 ELSE 0 END" for name, _, _, s, near in _PII) + " END AS DOUBLE)"
    span = "kind || ':' || b || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in ("email", "ip", "card", "phone"))
    return (
        f"WITH found AS ({found}), placed AS (SELECT *, b + length(m) AS e FROM found), kept AS (SELECT *, round(least({score}, 1), 2) AS score FROM placed WHERE CASE kind {confirm} END AND (k < 4 OR {score} > 0.59)), "
        f"by_doc AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY k, b) FILTER (k < 4) AS base, string_agg({span}, ',' ORDER BY k, b) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, b) AS scores FROM kept GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents d LEFT JOIN by_doc USING (doc_id)"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document under the fences of its language and source."""
    from gustline.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from gustline.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document gets three edits: a word put in after a third, five code points out at half, seven replaced after two thirds."""
    from gustline.llm.edits import count_with_edits, edit

    n = F.length(F.coalesce("text", F.lit("")))
    edits = F.array(edit((n / 3).cast("long"), F.lit(0), F.lit(" edited")), edit((n / 2).cast("long"), F.lit(5), F.lit("")), edit((n * 2 / 3).cast("long"), F.lit(7), F.lit(" 42 x.")))
    return count_with_edits(table(spark, sf_dir, "documents"), edits, default_tokenizer())


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as sorted-string tables, and read back from the files."""
    from gustline.llm.sstable import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"), default_tokenizer()))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 in 100 of their three-word shingles."""
    from gustline.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of power-of-two lengths up to 1024 tokens."""
    from gustline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), most=1024, with_ids=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    from gustline.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for quality, learned from trusted positives that are not held out and unlabelled texts."""
    from gustline.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_quality_rules, op4_html_extraction, op5_token_counts, op6_sstable, op7_near_duplicates, op8_packing, op9_decontamination, op10_quality_classifier)}
SQL: dict[str, str] = {"op2_pii": _pii_sql()}
