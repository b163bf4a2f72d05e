"""Operator 3: chat formatting with typed content parts.

The content of a turn is a plain text, or a JSON array of parts with a ``type``
of text, image, audio or document.  A visitor goes over the parts of a
conversation in order and flattens them: a text stays, an attachment becomes a
numbered placeholder, its reference and the number of tokens it expands to are
recorded.  Turns are framed as <|role|>, line feed, content, <|end|>, line
feed.  Everything is built-in expressions; the one shuffle gathers the turns of
a conversation.

Expansion: an image has ceil(width / 28) * ceil(height / 28) tokens, 1 at
least; an audio 25 for each second begun; a document 256 for each page, 1 page
at least.  A text counts its words (runs without blank, tab, line feed or
carriage return).

Defined results: a null text is an empty turn and a null role the role 'user';
a text that begins with '[' but isn't as a whole an array of such parts is a
plain text; turns are in order of turn, role, text, nulls first; repeated turns
are repeated; each row with a null conv_id is a conversation of one turn;
missing sizes count as 0; other columns are not looked at; an empty table gives no
conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,url:string,width:double,height:double,seconds:double,pages:double>"
TYPES = ("text", "image", "audio", "document")


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")).cast("long")


def parts(text: Column) -> Column:
    """array of PART: the parts of a turn."""
    # parsing stops where an array ends: inside another array, the text as a whole must be one
    outer = F.from_json(F.when(text.startswith("["), F.concat(F.lit("["), text, F.lit("]"))), f"array<array<{PART}>>")
    parsed = F.when(F.size(outer) == 1, F.get(outer, F.lit(0)))
    typed = parsed.isNotNull() & (F.size(parsed) > 0) & F.forall(parsed, lambda p: p.isNotNull() & F.coalesce(p["type"].isin(*TYPES), F.lit(False)))
    plain = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("url", "string"), *((x, "double") for x in ("width", "height", "seconds", "pages")))]))
    return F.when(F.coalesce(typed, F.lit(False)), parsed).otherwise(plain)


def expanded(part: Column) -> Column:
    """Tokens that a part expands to."""
    size = lambda name: F.greatest(F.coalesce(part[name], F.lit(0.0)), F.lit(0.0))
    image = F.greatest(F.ceil(size("width") / 28) * F.ceil(size("height") / 28), F.lit(1))
    audio = F.ceil(size("seconds")) * 25
    document = F.greatest(F.ceil(size("pages")), F.lit(1)) * 256
    kind = part["type"]
    return F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", document).otherwise(_words(F.coalesce(part["text"], F.lit("")))).cast("long")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, prompt, n_turns, expanded_tokens, n_attachments, attachments (index, type, ref, tokens as JSON)."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit("user"))
    rows = turns.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    gathered = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # turns without a conversation aren't gathered in one row, however many there are
    gathered = gathered.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    # one flat list: a part, and before and after each turn its frame
    frame = lambda s: F.struct(F.lit(None).cast(PART).alias("part"), s.alias("frame"))
    visited = F.flatten(
        F.transform(
            "turns",
            lambda t: F.concat(
                F.array(frame(F.concat(F.lit("<|"), t["role"], F.lit("|>\n")))),
                F.transform(parts(t["text"]), lambda p: F.struct(p.alias("part"), F.lit(None).cast("string").alias("frame"))),
                F.array(frame(F.lit("<|end|>\n"))),
            ),
        )
    )
    rows = gathered.select("conv_id", F.size("turns").alias("n_turns"), visited.alias("items"))
    # places of the attachments; used twice, so that it is worked out once a row and not for each item
    places = F.filter(F.transform("items", lambda x, i: F.when(x["part"].isNotNull() & (x["part"]["type"] != "text"), i)), lambda i: i.isNotNull())
    rows = rows.select("*", places.alias("places")).select("*", F.size("places").alias("n_attachments"))

    def piece(x: Column, i: Column) -> Column:
        mark = F.concat(F.lit("<|"), x["part"]["type"], F.lit("_"), F.array_position("places", i).cast("string"), F.lit("|>"))
        return F.when(x["part"].isNull(), x["frame"]).when(x["part"]["type"] == "text", F.coalesce(x["part"]["text"], F.lit(""))).otherwise(mark)

    attachments = F.transform(
        F.transform("places", lambda i: F.get("items", i)["part"]),
        lambda p, i: F.struct((i + 1).cast("int").alias("index"), p["type"].alias("type"), F.coalesce(p["url"], F.lit("")).alias("ref"), expanded(p).alias("tokens")),
    )
    tokens = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + F.when(x["part"].isNull(), F.lit(0)).otherwise(expanded(x["part"])))
    prompt = F.array_join(F.transform("items", piece), "")
    return rows.select("conv_id", prompt.alias("prompt"), "n_turns", tokens.alias("expanded_tokens"), "n_attachments", F.to_json(attachments).alias("attachments"))


def with_parts(turns: DataFrame) -> DataFrame:
    """turns of which one in three becomes a text with an image after it, and one in three a text between an audio and a document.

    The tables have plain texts only; this gives the query typed contents.
    """
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    field = lambda kind, **x: F.struct(F.lit(kind).alias("type"), *[x.get(n, F.lit(None).cast(t)).cast(t).alias(n) for n, t in (("text", "string"), ("url", "string"), ("width", "double"), ("height", "double"), ("seconds", "double"), ("pages", "double"))])
    said, turn = field("text", text=F.col("text")), F.col("turn")
    image = field("image", url=F.concat(name, F.lit(".png")), width=turn * 100 + 64, height=F.lit(300))
    audio, document = field("audio", url=F.concat(name, F.lit(".wav")), seconds=turn + 0.5), field("document", url=F.concat(name, F.lit(".pdf")), pages=turn)
    kind = F.pmod("turn", F.lit(3))
    return turns.withColumn("text", F.when(kind == 1, F.to_json(F.array(said, image))).when(kind == 2, F.to_json(F.array(audio, said, document))).otherwise(F.col("text")))


#: format_chats(with_parts(conversations)): turns have an order, so that the attachments of a turn follow on those of the turns before.
SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, CASE WHEN turn % 3 = 1 THEN 1 WHEN turn % 3 = 2 THEN 2 ELSE 0 END AS kind FROM conversations),
n AS (SELECT *, coalesce(sum(kind) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 'c' || conv_id || '/' || turn AS name FROM t),
p AS (
  SELECT *, ceil((turn * 100 + 64) / CAST(28 AS DOUBLE)) * 11 AS image, (turn + 1) * 25 AS audio, greatest(turn, 1) * 256 AS document FROM n),
c AS (
  SELECT *, CASE kind WHEN 0 THEN text WHEN 1 THEN text || '<|image_' || CAST(before + 1 AS BIGINT) || '|>'
      ELSE '<|audio_' || CAST(before + 1 AS BIGINT) || '|>' || text || '<|document_' || CAST(before + 2 AS BIGINT) || '|>' END AS content,
    len(regexp_extract_all(text, '[^ \t\n\r]+')) + CASE kind WHEN 0 THEN 0 WHEN 1 THEN image ELSE audio + document END AS tokens,
    CASE kind WHEN 1 THEN '{"index":' || CAST(before + 1 AS BIGINT) || ',"type":"image","ref":"' || name || '.png","tokens":' || CAST(image AS BIGINT) || '}'
      WHEN 2 THEN '{"index":' || CAST(before + 1 AS BIGINT) || ',"type":"audio","ref":"' || name || '.wav","tokens":' || audio || '},{"index":' || CAST(before + 2 AS BIGINT)
        || ',"type":"document","ref":"' || name || '.pdf","tokens":' || document || '}' END AS attached FROM p)
SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || content || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS prompt, CAST(count(*) AS INTEGER) AS n_turns,
  CAST(sum(tokens) AS BIGINT) AS expanded_tokens, CAST(sum(kind) AS INTEGER) AS n_attachments, '[' || coalesce(string_agg(attached, ',' ORDER BY turn, role, text), '') || ']' AS attachments
FROM c GROUP BY conv_id
"""
