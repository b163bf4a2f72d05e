"""Queries of selection, scores, groups and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import has_long_repetition
from ..operators import evaluation as E
from ..operators import leaderboard as L
from ..operators.selection import select_subset
from . import sql as S
from .tables import EXAMPLES_SQL, examples, table


def _partitions(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _scores(spark: SparkSession, d: str, *metrics: str) -> DataFrame:
    return E.page_scores(examples(spark, d), partitions=_partitions(spark), metrics=metrics or E.METRICS)


def subset_select(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chosen = select_subset(docs, "doc_id", language=" EN ", document_type="Src7", offset=3, limit=20, language_col="lang", type_col="source")
    return chosen.select("doc_id", "lang", "source", "n_chars")


def page_scores(spark: SparkSession, d: str) -> DataFrame:
    chars = F.length("normalized_predicted_text").alias("predicted_chars"), F.length("normalized_gold_text").alias("gold_chars")
    return _scores(spark, d, E.MAIN, "is_empty").select("example_id", F.round(E.MAIN, 9).alias(E.MAIN), "is_empty", *chars)


def bleu_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, "bleu").select("example_id", F.round("bleu", 9).alias("bleu"))


def repetition_flags(spark: SparkSession, d: str) -> DataFrame:
    """Of texts whose last hundred characters are there three times, and of the texts as they are."""
    docs = table(spark, d, "documents")
    kinds = F.explode(F.array(F.struct(F.lit("as it is").alias("kind"), F.col("text").alias("t")), F.struct(F.lit("tripled").alias("kind"), F.concat("text", F.expr("repeat(right(text, 100), 2)")).alias("t"))))
    rows = docs.select("doc_id", kinds.alias("k")).select("doc_id", "k.kind", F.col("k.t").alias("t"))
    return rows.select("doc_id", "kind", has_long_repetition(F.col("t")).alias("repetition"))


def grouped_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.grouped_scores(_scores(spark, d, E.MAIN)).withColumn("mean", F.round("mean", 6))


def type_seeded_means(spark: SparkSession, d: str) -> DataFrame:
    """Prints are called books here, so the group of prints has no page, but is there all the same."""
    rows = _scores(spark, d, E.MAIN).withColumn("document_type", F.regexp_replace("document_type", "^print$", "book"))
    return E.seeded_types(E.grouped_scores(rows)).withColumn("mean", F.round("mean", 6))


def aggregate_scores(spark: SparkSession, d: str) -> DataFrame:
    """The main score, emptiness, and a score that only texts with quotation marks have."""
    rows = _scores(spark, d, E.MAIN, "is_empty").withColumn("quoted", F.when(F.col("gold_text").contains('"'), 1.0))
    metrics = (E.MAIN, "is_empty", "quoted")
    return E.aggregate_scores(rows, metrics).select(*[F.round(m, 6).alias(m) for m in metrics], "n_pages")


def _board(spark: SparkSession, d: str) -> DataFrame:
    """The sources stand for models."""
    rows = _scores(spark, d, E.MAIN).select(F.col("dataset_id").alias("model"), "main_language", "document_type", F.col(E.MAIN).alias("score"))
    return L.pivot(rows, ["de", "en", "es", "fr"], digits=6)


def leaderboard_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d)


def leaderboard_rank(spark: SparkSession, d: str) -> DataFrame:
    return L.rank(_board(spark, d), by="handwritten:de").select("model", "handwritten:de", "rank")


def group_languages(spark: SparkSession, d: str) -> DataFrame:
    found = L.languages_by_type(examples(spark, d))
    return found.select("group", F.array_join("languages", ",").alias("languages"))


def failed_scores(spark: SparkSession, d: str) -> DataFrame:
    """All pages, as if the evaluation of each had broken off."""
    return E.failed_scores(examples(spark, d)).select("example_id", *E.METRICS, F.length("normalized_predicted_text").alias("predicted_chars"))


def call_counters(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of calls; an error has no cost."""
    calls = table(spark, d, "events").select("user_id", F.col("event_id").alias("call_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("cost"))
    return E.call_counters(calls, "user_id").withColumn("total_cost", F.round("total_cost", 4))


QUERIES = {
    f.__name__: f
    for f in (
        subset_select, page_scores, bleu_scores, repetition_flags, grouped_scores, type_seeded_means, aggregate_scores,
        leaderboard_pivot, leaderboard_rank, group_languages, failed_scores, call_counters,
    )
}

_NORMAL = f"""{EXAMPLES_SQL},
tagged AS (SELECT *, {S.output_tag('predicted_text')} AS p0, {S.output_tag('gold_text')} AS g0 FROM ex),
norm AS (SELECT *, {S.normal('p0')} AS p, {S.normal('g0')} AS g FROM tagged)"""
_SCORES = f"""{_NORMAL},
scores AS (SELECT *, CASE WHEN greatest(length(p), length(g)) = 0 THEN 1.0 ELSE 1 - levenshtein({S.one_byte('p')}, {S.one_byte('g')}) / CAST(greatest(length(p), length(g)) AS DOUBLE) END AS nls, CASE WHEN p = '' THEN 1.0 ELSE 0.0 END AS empty FROM norm)"""
_KEPT = f"{_SCORES}, kept AS (SELECT *, nls AS score FROM scores)"
_LEVEL = "CASE grouping(main_language) * 2 + grouping(document_type) WHEN 0 THEN 'language_type' WHEN 1 THEN 'language' WHEN 2 THEN 'type' ELSE 'all' END"
_BOARD = ", ".join(
    f'round(avg(100 * score) FILTER (document_type = \'{kind}\'{extra}), 6) AS "{name}"'
    for group, kind in L.GROUPS.items()
    for name, extra in ((group, ""), *((f"{group}:{lang}", f" AND main_language = '{lang}'") for lang in ("de", "en", "es", "fr")))
)
_PIVOT = f"board AS (SELECT dataset_id AS model, {_BOARD}, round(avg(100 * score), 6) AS total FROM kept GROUP BY dataset_id)"
SQL = {
    "subset_select": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lower(trim(lang)) = 'en' AND lower(trim(source)) = 'src7' ORDER BY doc_id LIMIT 20 OFFSET 3",
    "page_scores": f"WITH {_SCORES} SELECT example_id, round(nls, 9) AS normalized_levenshtein_similarity, CAST(empty AS DOUBLE) AS is_empty, CAST(length(p) AS INTEGER) AS predicted_chars, CAST(length(g) AS INTEGER) AS gold_chars FROM scores",
    "bleu_scores": f"""WITH {_NORMAL},
words AS (SELECT example_id, {S.bleu_words('p')} AS pw, {S.bleu_words('g')} AS gw FROM norm),
each AS (SELECT example_id, 'p' AS side, unnest(pw) AS w, unnest(range(1, len(pw) + 1)) AS i FROM words UNION ALL SELECT example_id, 'g', unnest(gw), unnest(range(1, len(gw) + 1)) FROM words),
ones AS (SELECT example_id, side, w, w || ' ' || lead(w) OVER o AS w2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS w3, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS w4 FROM each WINDOW o AS (PARTITION BY example_id, side ORDER BY i)),
grams AS (SELECT example_id, side, 1 AS n, w AS gram FROM ones UNION ALL SELECT example_id, side, 2, w2 FROM ones WHERE w2 IS NOT NULL UNION ALL SELECT example_id, side, 3, w3 FROM ones WHERE w3 IS NOT NULL UNION ALL SELECT example_id, side, 4, w4 FROM ones WHERE w4 IS NOT NULL),
counts AS (SELECT example_id, n, gram, count(*) FILTER (side = 'p') AS own, count(*) FILTER (side = 'g') AS other FROM grams GROUP BY ALL),
orders AS (SELECT example_id, n, sum(least(own, other)) AS common, sum(own) AS possible FROM counts GROUP BY ALL),
geo AS (SELECT example_id, CASE WHEN count(*) FILTER (common > 0) = 4 THEN exp(sum(ln(CASE WHEN common > 0 THEN common / CAST(possible AS DOUBLE) END)) / 4) ELSE 0.0 END AS mean FROM orders GROUP BY example_id)
SELECT example_id, round(CASE WHEN len(pw) = 0 OR len(gw) = 0 THEN 0.0 ELSE coalesce(mean, 0.0) * CASE WHEN len(pw) > len(gw) THEN 1.0 ELSE exp(1 - len(gw) / CAST(len(pw) AS DOUBLE)) END END, 9) AS bleu FROM words LEFT JOIN geo USING (example_id)""",
    # blocks shorter than 16 one by one; for longer ones the last 16 characters must occur one block earlier
    "repetition_flags": f"""WITH k AS (SELECT doc_id, 'as it is' AS kind, text AS t FROM documents UNION ALL SELECT doc_id, 'tripled', text || repeat(right(text, 100), 2) FROM documents),
b AS (SELECT doc_id, kind, translate(t, {S.quote("äçèéêíñóöüßÄÇÈÉÊÍÑÓÖÜ")}, chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21) || chr(22) || chr(23) || chr(24) || chr(25) || chr(26)) AS t FROM k),
n AS (SELECT *, length(t) AS n, greatest(2, length(t) - CAST(floor(CAST(0.8 AS DOUBLE) * length(t)) AS BIGINT)) AS low FROM b),
chars AS (SELECT doc_id, kind, unnest(string_split(t, '')) AS c, unnest(range(1, n + 1)) AS i FROM n),
fours AS (SELECT doc_id, kind, i, c || lead(c) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o AS four FROM chars WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
s AS (SELECT doc_id, kind, t, n, low, unnest(range(1, least(16, (n - 1) // 2) + 1)) AS d FROM n
  UNION ALL SELECT n.doc_id, n.kind, t, n, low, n - 15 - i FROM fours JOIN n ON fours.doc_id = n.doc_id AND fours.kind = n.kind WHERE i <= n - 16 AND n - 15 - i <= (n - 1) // 2 AND four = substr(right(t, 16), 1, 4) AND substr(t, i, 16) = right(t, 16)),
c AS (SELECT *, d * greatest(2, (low + d - 1) // d) AS size FROM s),
r AS (SELECT doc_id, kind, bool_or(size <= n - 1 AND substr(t, n - size + 1, size - d) = substr(t, n - size + d + 1, size - d)) AS repetition FROM c GROUP BY ALL)
SELECT n.doc_id, n.kind, coalesce(repetition, false) AS repetition FROM n LEFT JOIN r ON n.doc_id = r.doc_id AND n.kind = r.kind""",
    "grouped_scores": f"WITH {_SCORES} SELECT {_LEVEL} AS level, main_language, document_type, round(avg(nls), 6) AS mean, count(*) AS n_pages FROM scores GROUP BY GROUPING SETS ((), (main_language), (document_type), (main_language, document_type))",
    "type_seeded_means": f"WITH {_KEPT}, g AS (SELECT CASE document_type WHEN 'print' THEN 'book' ELSE document_type END AS document_type, avg(score) AS mean FROM kept GROUP BY 1), s AS (SELECT unnest(['print', 'handwriting']) AS document_type UNION SELECT document_type FROM g) SELECT s.document_type, round(coalesce(mean, 0.0), 6) AS mean FROM s LEFT JOIN g ON s.document_type = g.document_type",
    "aggregate_scores": f"WITH {_KEPT} SELECT round(avg(score), 6) AS {E.MAIN}, round(avg(CAST(empty AS DOUBLE)), 6) AS is_empty, round(avg(CASE WHEN gold_text LIKE '%\"%' THEN 1.0 ELSE 0.0 END), 6) AS quoted, count(*) AS n_pages FROM kept",
    "leaderboard_pivot": f"WITH {_KEPT}, {_PIVOT} SELECT * FROM board",
    "leaderboard_rank": f'WITH {_KEPT}, {_PIVOT} SELECT model, "handwritten:de", CAST(row_number() OVER (ORDER BY "handwritten:de" DESC NULLS LAST, model) AS INTEGER) AS rank FROM board',
    "group_languages": f"WITH {EXAMPLES_SQL} SELECT CASE document_type WHEN 'print' THEN 'printed' ELSE 'handwritten' END AS \"group\", string_agg(DISTINCT main_language, ',' ORDER BY main_language) AS languages FROM ex WHERE document_type <> 'unlabelled' GROUP BY 1",
    "failed_scores": f"WITH {EXAMPLES_SQL} SELECT example_id, CAST(0 AS DOUBLE) AS normalized_levenshtein_similarity, CAST(0 AS DOUBLE) AS repetition, CAST(1 AS DOUBLE) AS is_empty, CAST(0 AS DOUBLE) AS bleu, CAST(length(predicted_text) AS INTEGER) AS predicted_chars FROM ex",
    "call_counters": "SELECT user_id, count(*) AS request_count, count(*) FILTER (event_type = 'error') AS untracked_request_count, round(coalesce(sum(value) FILTER (event_type <> 'error'), 0.0), 4) AS total_cost, arg_max(value, event_id) FILTER (event_type <> 'error') AS last_cost FROM events GROUP BY user_id",
}
