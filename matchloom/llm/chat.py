"""Chat formatting with typed content parts (DataFrame functions only).

A message is an ordered list of parts (kind, text, ref, units). A visitor with a case for each kind turns text into
escaped text and every other part into a placeholder, and records the attachment: its kind, reference, place among the
message's attachments and the tokens that its placeholder stands for.

The template is <|im_start|>ROLE<|im_sep|>CONTENT<|im_end|> for each turn. In roles and texts a backslash is doubled and
"<|" becomes "<\\|", so no control string can appear in them, and dropping each escaping backslash gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens for one unit: an image tile, a second of audio, a document page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """One text part; what a table of plain texts holds."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units")))


def visit_content(part: Column) -> Column:
    """The case for each kind; a kind that is not known stands as its own placeholder."""
    placeholder = F.concat(F.lit("<|"), F.regexp_replace(F.coalesce(part["kind"], F.lit("unknown")), r"[<|>\\]", "_"), F.lit("|>"))
    return F.when(part["kind"] == "text", escape(part["text"])).otherwise(placeholder)


def visit_tokens(part: Column) -> Column:
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
    tokens = F.lit(0).cast("bigint")
    for kind, each in EXPANSION.items():
        tokens = F.when(part["kind"] == kind, units * each).otherwise(tokens)
    return tokens


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The content with ordered placeholders, and the attachments in the same order."""
    content = F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit_content), "")
    others = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: ~F.coalesce(p["kind"] == "text", F.lit(False)))
    attachments = F.transform(others, lambda p, i: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), i.cast("int").alias("place"), visit_tokens(p).alias("tokens")))
    return content, attachments


def format_conversations(messages: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conv_id: formatted string, loss_spans (code points of the content of trained roles), attachments, n_tokens_expanded.

    messages: conv_id, turn, role, parts. Turns go by turn, then role, then content, so that ties and repeated rows have a
    fixed order; a null role or text is empty, a null turn comes first, null conv_ids are one conversation.
    """
    content, attachments = flatten_parts(F.col("parts"))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attachments.alias("attached"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content", "attached")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    lead = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
    body = F.array_join(F.transform("turns", lambda t: F.concat(lead(t), t["content"], F.lit(END))), "")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(lead(t))
        stop = start + F.length(t["content"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        spans = F.when(t["role"].isin(*train_roles), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((stop + len(END)).alias("at"), spans.alias("spans"))

    out = grouped.select("conv_id", body.alias("formatted"), F.aggregate("turns", begin, step)["spans"].alias("loss_spans"), F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"))
    expanded = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"])
    return out.withColumn("n_tokens_expanded", expanded)


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    return F.transform(pieces, lambda p: F.struct(unescape(F.split_part(body(p), F.lit(SEP), F.lit(1))).alias("role"), unescape(F.split_part(body(p), F.lit(SEP), F.lit(2))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and their loss spans say."""
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))), "")
    rows = formatted.withColumn("back", read_turns(F.col("formatted"))).withColumn("trained", trained)
    return rows.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
