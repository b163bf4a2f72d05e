"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.blocks import table_html
from ..functions.dialect import W, quote, sql_strip
from ..functions.xml import xml_to_text
from ..operators import profiles
from ..operators.evaluation import normalized
from . import sql as S
from .tables import expression, spread

LF = "chr(10)"
# built in both engines by the same expression
TAGGED = "CASE lang WHEN 'en' THEN '<output>' || chr(10) || text || '</output>' WHEN 'de' THEN '<OUTPUT lang=\"de\"> ' || text WHEN 'es' THEN text || '</output>' ELSE text END"
SCAFFOLDED = "CASE role WHEN 'user' THEN 'OCR:' || chr(10) || '<|user|>' || chr(10) ELSE role || ':' || chr(10) || 'Assistant' || chr(10) || chr(10) END || text || CASE role WHEN 'system' THEN '' ELSE chr(10) || '<|im_end|>' || '<|endoftext|> ' END"
FENCED = "CASE lang WHEN 'en' THEN '```markdown' || chr(10) || text || chr(10) || '```' WHEN 'de' THEN '~~~~' || chr(10) || text || chr(10) || '~~~~' WHEN 'es' THEN '```' || chr(10) || text ELSE text END"
FRONTED = "'---' || chr(10) || 'lang: ' || lang || chr(10) || 'source:  ' || source || chr(10) || 'n_chars: ' || CAST(n_chars AS STRING) || chr(10) || 'none: NULL' || chr(10) || 'no colon' || chr(10) || 'table: True' || chr(10) || '---' || chr(10) || '# ' || text"
ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
XML = f"'<HistoricalDocument xmlns=\"urn:x\"><Metadata><Title>no</Title></Metadata><Page><Header>' || lang || ' <Gap/></Header><Body><Paragraph> ' || {ESCAPED} || '</Paragraph><Figure><Description>left out</Description></Figure></Body></Page><Page><Footer><Deletion>gone</Deletion>' || source || '</Footer></Page></HistoricalDocument>'"
OTSL = "'<fcel>' || lang || '<lcel><fcel>' || source || '<nl><fcel>' || CAST(n_chars AS STRING) || '<ecel><ucel><nl><fcel>a<nl>'"
RESPONSES = "CASE lang WHEN 'en' THEN '<output>' || text || '</output>' WHEN 'de' THEN 'Text Recognition:' || chr(10) || '<|assistant|>' || chr(10) || text || chr(10) || '<|user|>' WHEN 'es' THEN 'OCR: ' || text ELSE '<image>' || chr(10) || 'free ocr.' || chr(10) || '<｜Assistant｜>' || chr(10) || text || '<｜end▁of▁sentence｜>' END"


def strip_output_tag(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "documents").select("doc_id", T.strip_output_tag(expression(TAGGED)).alias("text"))


def markup_to_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "pages").select("page_id", T.markup_to_text(F.col("html")).alias("text"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def normalize_pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "pages").select("page_id", T.normalize_text(F.col("html")).alias("text"))


def arabic_folding(spark: SparkSession, d: str) -> DataFrame:
    """The language decides whether a row is folded; 'fr' stands for Arabic."""
    language = F.when(F.col("lang") == "fr", "Arabic").otherwise(F.col("lang"))
    return spread(spark, d, "documents").select("doc_id", normalized(F.concat(F.lit(ARABIC), F.col("text")), language).alias("text"))


ARABIC = "آمن أَحْمَد ـ مُؤْمِنٌ ئ "


def chat_scaffold(spark: SparkSession, d: str) -> DataFrame:
    cleaned = T.strip_trailing_tokens(T.strip_chat_scaffold(expression(SCAFFOLDED), ("OCR:",)), ("<|endoftext|>", "<|im_end|>"))
    return spread(spark, d, "conversations").select("conv_id", "turn", cleaned.alias("text"))


def stop_strings(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "conversations").select("conv_id", "turn", T.trim_stop_strings(expression(SCAFFOLDED)).alias("text"))


def outer_fence(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "documents").select("doc_id", T.strip_outer_fence(expression(FENCED)).alias("text"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    fields, body = T.split_front_matter(F.col("response"))
    rows = spread(spark, d, "documents").select("doc_id", expression(FRONTED).alias("response"))
    names = ("lang", "source", "n_chars", "none", "table")
    return rows.select("doc_id", fields.alias("f"), body.alias("body")).select("doc_id", *[F.col("f")[n].alias(n) for n in names], F.size("f").alias("n_fields"), "body")


def xml_flatten(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "documents").select("doc_id", xml_to_text(expression(XML)).alias("text"))


def otsl_tables(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "documents").select("doc_id", table_html(expression(OTSL)).alias("html"))


def profile_postprocess(spark: SparkSession, d: str) -> DataFrame:
    profile = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "default", "de", "glm", "es", "paddle", "fr", "deepseek")]), F.col("lang"))
    rows = spread(spark, d, "documents").select("doc_id", profile.alias("profile"), expression(RESPONSES).alias("response"))
    done = profiles.postprocess_by(F.col("response"), F.col("profile"), ("default", "glm", "paddle", "deepseek"))
    return rows.select("doc_id", "profile", done.alias("p")).select("doc_id", "profile", "p.text", F.size("p.metadata").alias("n_metadata"))


def plain_responses(spark: SparkSession, d: str) -> DataFrame:
    """HTML answers of a model whose raw form is kept."""
    done = profiles.postprocess(F.col("html"), "chandra")
    return spread(spark, d, "pages").select("page_id", done.alias("p")).select("page_id", "p.text", F.length(F.col("p.metadata")["raw_html"]).alias("raw_chars"))


def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    page = F.create_map(F.lit("page_index"), F.lit("7"), F.lit("lang"), F.col("lang"), F.lit("x"), F.lit("page"))
    caller = F.create_map(F.lit("x"), F.col("source"), F.lit("y"), F.lit("caller"))
    rows = spread(spark, d, "documents").select("doc_id", profiles.page_metadata(page, caller, F.col("doc_id"), F.lit(0)).alias("m"))
    return rows.select("doc_id", *[F.col("m")[k].alias(k) for k in ("page_index", "source_index", "lang", "x", "y")], F.size("m").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        strip_output_tag, markup_to_text, normalize_text, normalize_pages, arabic_folding, chat_scaffold, stop_strings, outer_fence,
        front_matter, xml_flatten, otsl_tables, profile_postprocess, plain_responses, metadata_merge,
    )
}


def _scaffold_sql() -> str:
    text, line = sql_strip("r"), "[^\\n]*"
    for _ in range(8):
        text = f"regexp_replace({text}, {quote(rf'(?i)\A(?:OCR:|(?:(?:assistant|system|user):?|<\|(?:assistant|system|user)\|>)(?:\n|\z)){W}*')}, '')"
    del line
    return f"regexp_replace({sql_strip(text)}, {quote(rf'(?:{W}*(?:<\|im_end\|>|<\|endoftext\|>)){{1,8}}\z')}, '')"


def _fence_sql() -> str:
    text = "t"
    cases = "".join(f" WHEN regexp_matches(t, {quote(p)}) THEN {sql_strip(f'regexp_extract(t, {quote(p)}, 1)')}" for p in (rf"(?s)\A{fence}[^\n]*\n(.*)\n{fence}\z" for fence in ("````", "```", "~~~~", "~~~")))
    return f"CASE{cases} ELSE {text} END"


_BODY = f"regexp_replace(body, {quote(rf'{W}+\z')}, '')"
SQL = {
    "strip_output_tag": f"WITH r AS (SELECT doc_id, {TAGGED} AS r FROM documents) SELECT doc_id, {S.output_tag('r')} AS text FROM r",
    "markup_to_text": f"SELECT page_id, {S.markup('html')} AS text FROM pages",
    "normalize_text": f"SELECT doc_id, {S.normal('text')} AS text FROM documents",
    "normalize_pages": f"SELECT page_id, {S.normal('html')} AS text FROM pages",
    "arabic_folding": f"WITH r AS (SELECT doc_id, lang, {quote(ARABIC)} || text AS r FROM documents), s AS (SELECT doc_id, lang, {S.output_tag('r')} AS s FROM r) SELECT doc_id, CASE lang WHEN 'fr' THEN {S.normal('s', arabic=True)} ELSE {S.normal('s')} END AS text FROM s",
    "chat_scaffold": f"WITH r AS (SELECT conv_id, turn, {SCAFFOLDED} AS r FROM conversations) SELECT conv_id, turn, {_scaffold_sql()} AS text FROM r",
    "stop_strings": f"WITH r AS (SELECT conv_id, turn, {SCAFFOLDED} AS r FROM conversations) SELECT conv_id, turn, {sql_strip('split_part(split_part(r, ' + quote('<|im_end|>') + ', 1), ' + quote('<|endoftext|>') + ', 1)')} AS text FROM r",
    "outer_fence": f"WITH r AS (SELECT doc_id, {FENCED} AS r FROM documents), s AS (SELECT doc_id, {sql_strip('r')} AS t FROM r) SELECT doc_id, {_fence_sql()} AS text FROM s",
    "front_matter": (
        f"WITH r AS (SELECT doc_id, {FRONTED} AS r FROM documents), s AS (SELECT doc_id, string_split(r, {LF} || '---' || {LF})[1] AS head, substr(r, instr(r, {LF} || '---' || {LF}) + 5) AS body FROM r), "
        "f AS (SELECT doc_id, head, regexp_replace(body, '(?s)\\A\\s+', '') AS body FROM s) "
        "SELECT doc_id, "
        + ", ".join(f"regexp_extract(head, '(?m)^{n}: *(.*)$', 1) AS {n}" for n in ("lang", "source", "n_chars"))
        + f", CAST(NULL AS VARCHAR) AS \"none\", lower(regexp_extract(head, '(?m)^table: *(.*)$', 1)) AS \"table\", CAST(5 AS INTEGER) AS n_fields, {_BODY} AS body FROM f"
    ),
    "xml_flatten": f"SELECT doc_id, lang || CASE WHEN {sql_strip('text')} = '' THEN '' ELSE {LF} || {sql_strip('text')} END || {LF} || {LF} || source AS text FROM documents",
    "otsl_tables": "SELECT doc_id, '<table><tr><td colspan=\"2\">' || lang || '</td><td rowspan=\"2\">' || source || '</td></tr><tr><td>' || n_chars || '</td><td></td></tr><tr><td>a</td><td></td><td></td></tr></table>' AS html FROM documents",
    "profile_postprocess": f"SELECT doc_id, CASE lang WHEN 'en' THEN 'default' WHEN 'de' THEN 'glm' WHEN 'es' THEN 'paddle' WHEN 'fr' THEN 'deepseek' END AS profile, {sql_strip('text')} AS text, CAST(0 AS INTEGER) AS n_metadata FROM documents",
    "plain_responses": f"SELECT page_id, {S.markup('html')} AS text, CAST(length({sql_strip('html')}) AS INTEGER) AS raw_chars FROM pages",
    "metadata_merge": "SELECT doc_id, '7' AS page_index, '0' AS source_index, lang, source AS x, 'caller' AS y, CAST(5 AS INTEGER) AS n FROM documents",
}
