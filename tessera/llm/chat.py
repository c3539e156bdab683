"""Chat formatting: typed content parts, a template with turn marks, reversible escapes, a loss mask.

Everything is a DataFrame expression. A visitor over the parts of a turn (text, image, audio, document) flattens them into one
string with ordered placeholders and records, for each attachment, its reference and the tokens it will expand to.

The template writes a turn as

    <|turn|>role\\n content <|end|>\\n

Inside roles and contents `&`, `<` and `[` become `&a;`, `&l;` and `&b;` (in a role, a line feed `&n;`), so that no control
string, this template's or another's (`</s>`, `[INST]`), survives in a text, and every text can be had back:
every `&` of an escaped text begins an escape, which makes it unambiguous. Placeholders are written unescaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

TURN, END = "<|turn|>", "<|end|>\n"
LEARNED_ROLE = "assistant"
#: Expanded sizes: one token for each square of an image, a rate for audio, a number for each page of a document.
PATCH_PIXELS = 28
AUDIO_TOKENS_PER_SECOND = 12.5
TOKENS_PER_PAGE = 256

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(col: Column) -> Column:
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&a;")), F.lit("<"), F.lit("&l;")), F.lit("["), F.lit("&b;"))


def unescape(col: Column) -> Column:
    return F.replace(F.replace(F.replace(col, F.lit("&b;"), F.lit("[")), F.lit("&l;"), F.lit("<")), F.lit("&a;"), F.lit("&"))


def _role(col: Column) -> Column:
    return F.replace(escape(col), F.lit("\n"), F.lit("&n;"))


def text_part(text: Column) -> Column:
    """A text as the only part of a turn."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; missing or negative measures count as one patch, second or page."""
    least = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    squares = lambda c: F.ceil(least(c) / PATCH_PIXELS)
    return (
        F.when(part["kind"] == "image", squares(part["width"]) * squares(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
        .when(part["kind"] == "document", least(part["pages"]) * TOKENS_PER_PAGE)
        .cast("long")
    )


def flatten(parts: Column) -> tuple[Column, Column]:
    """Of an array of parts: the escaped content, in which the nth attachment of the turn is `<|kind:n|>`, and the attachments.

    Null parts and null texts are empty; a part of an unknown kind counts as its text.
    """
    known = F.filter(F.coalesce(parts, F.lit([]).cast(f"array<{PART}>")), lambda p: p.isNotNull())
    is_file = lambda p: F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))
    start = F.struct(F.lit("").alias("content"), F.lit([]).cast("array<struct<n: int, kind: string, ref: string, tokens: bigint>>").alias("files"))
    seen = F.aggregate(
        known,
        start,
        lambda done, p: F.when(
            is_file(p),
            F.struct(
                F.concat(done["content"], F.lit("<|"), p["kind"], F.lit(":"), F.size(done["files"]).cast("string"), F.lit("|>")).alias("content"),
                F.concat(done["files"], F.array(F.struct(F.size(done["files"]).alias("n"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))).alias("files"),
            ),
        ).otherwise(F.struct(F.concat(done["content"], escape(F.coalesce(p["text"], F.lit("")))).alias("content"), done["files"].alias("files"))),
    )
    return seen["content"], seen["files"]


def render(role: Column, content: Column) -> Column:
    """One turn by the template; content is escaped already."""
    return F.concat(F.lit(TURN), _role(F.coalesce(role, F.lit(""))), F.lit("\n"), content, F.lit(END))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts (array of PART) to conv_id, formatted, attachments (turn number from 0, n, kind, ref, tokens), expanded_tokens.

    Turns stand in the order of turn (nulls first), then role and content. Repeated rows stay. A null role is the empty role, null
    parts are an empty content; rows without conv_id form one conversation. Texts of any length are formatted whole, extra columns are ignored whatever their
    names, and an empty table gives no row. A conversation is one string, so its rows
    must meet in one task; nothing else is gathered.
    """
    content, files = flatten(F.col("parts"))
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), files.alias("files")).alias("t"))
    return _joined(rows).select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: render(t["role"], t["content"])), "").alias("formatted"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["files"], lambda f: F.struct(i.alias("at"), f["n"].alias("n"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, f: s + f["tokens"]))


def _joined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))


def read_back(formatted: Column) -> Column:
    """Of a formatted conversation of text parts: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"\Q" + TURN + r"\E", -1), lambda p: F.length(p) > 0)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("&n;"), F.lit("\n"))).alias("role"),
            unescape(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the learned role's, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == LEARNED_ROLE), lambda t: t["text"]), "")


def query(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    done = format_turns(rows.select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts")))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss_text(F.col("turns"))).cast("long").alias("loss_chars"),
        F.sha2(loss_text(F.col("turns")), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&a;'), '<', '&l;'), '[', '&b;') AS content,
    replace(replace(replace(replace(role, '&', '&a;'), '<', '&l;'), '[', '&b;'), chr(10), '&n;') AS name FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, content)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, content) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(content) + length(name) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
