"""Chat formatting with Spark expressions alone.

Turns are collected as structs and sorted; adjacent turns of one role merge into a block; blocks are
joined into one string. Inside a block, turns stay apart by a control string of their own, so the
output can be read back turn by turn. Control strings inside roles and texts are escaped reversibly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template, and others that common templates use.
OPEN, BODY, NEXT, CLOSE = "<|turn|>", "<|says|>", "<|next|>", "<|end|>"
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPES = {"<": "%3C", "[": "%5B"}


def escape(text: Column) -> Column:
    """No control string survives in the text; unescape() gives back the text exactly."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for control in (OPEN, BODY, NEXT, CLOSE, *FOREIGN):
        out = F.replace(out, F.lit(control), F.lit(ESCAPES[control[0]] + control[1:]))
    return out


def unescape(text: Column) -> Column:
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit(kv[0])), ESCAPES.items(), text)
    return F.replace(out, F.lit("%25"), F.lit("%"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start from 0 and length in code points of every assistant text).

    Null text and null role are empty strings; turns that tie are ordered by role, then text; a null
    conv_id is one conversation; repeated rows stay. No rows give no conversations.
    """
    turns = rows.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "turn",
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    n = F.size("turns")
    role = lambda i: F.element_at("turns", i.cast("int"))["role"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (role(i) != role(F.greatest(i - 1, F.lit(1)))))
    started = turns.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at("starts", (k + 2).cast("int")), n + 1)
        texts = F.transform(F.slice("turns", start, end - start), lambda t: escape(t["text"]))
        return F.struct(F.element_at("turns", start)["role"].alias("role"), texts.alias("texts"))

    blocks = started.select("conv_id", F.transform("starts", block).alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(BODY))
    whole = lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE))
    # What the mask covers: pieces that alternate between template and text, with their lengths.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.flatten(
                F.transform(
                    b["texts"],
                    lambda t, i: F.array(
                        F.struct(F.when(i == 0, F.length(head(b))).otherwise(len(NEXT)).alias("skip"), F.length(t).alias("len"), (b["role"] == "assistant").alias("loss"), (i == F.size(b["texts"]) - 1).alias("last"))
                    ),
                )
            ),
        )
    )
    shaped = blocks.select("conv_id", F.array_join(F.transform("blocks", whole), "").alias("formatted"), pieces.alias("pieces"))
    ends = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["skip"] + p["len"] + F.when(p["last"], len(CLOSE)).otherwise(0)).alias("at"),
            F.when(
                p["loss"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["skip"]).alias("start"), p["len"].alias("len")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return shaped.select("conv_id", "formatted", ends["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) structs, parsed from the formatted string alone."""
    body = F.split(formatted, r"<\|end\|>")
    blocks = F.slice(body, F.lit(1), F.size(body) - 1)
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, BODY, -1), r"<\|next\|>"),
                lambda t: F.struct(
                    unescape(F.replace(F.substring_index(b, BODY, 1), F.lit(OPEN), F.lit(""))).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the query, all read back from the formatted strings and their masks."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["len"]))), ""
    )
    parsed = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("masked", masked)
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
