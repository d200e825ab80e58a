"""Messenger responses as string and struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def citations_block(citations: Column, mode: Column, *, title: str = "Sources", most: int = 5) -> Column:
    """Numbered lines of (label, url) under a bold title; empty without citations."""
    link = lambda c: F.when(c["url"].isNull(), c["label"]).when(mode == "markdown", F.concat(F.lit("["), T.escape_markdown(c["label"]), F.lit("]("), c["url"], F.lit(")"))).when(mode == "html", F.concat(F.lit('<a href="'), c["url"], F.lit('">'), c["label"], F.lit("</a>"))).otherwise(F.concat_ws(" ", c["label"], c["url"]))
    lines = F.transform(F.slice(citations, 1, most), lambda c, k: F.concat((k + 1).cast("string"), F.lit(". "), link(c)))
    return F.when(F.size(citations) > 0, F.concat(T.bold(F.lit(title), mode), F.lit("\n"), F.array_join(lines, "\n"))).otherwise("")


def keyboard(answer_id: Column, asked: Column) -> Column:
    """Five rating buttons where a rating is asked for."""
    buttons = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.struct(n.cast("string").alias("text"), F.concat_ws(":", F.lit("fb"), answer_id.cast("string"), n.cast("string")).alias("callback_data")))
    return F.when(asked, buttons)


def response(text: Column, block: Column) -> Column:
    return F.concat_ws("\n\n", text, F.nullif(block, F.lit("")))


def parse_mode(mode: Column) -> Column:
    return F.when(mode == "markdown", "MarkdownV2").when(mode == "html", "HTML")


def outgoing(chat_id: Column, text: Column, mode: Column, buttons: Column) -> Column:
    """The JSON that a chat service takes."""
    return F.to_json(F.struct(chat_id.alias("chat_id"), text.alias("text"), parse_mode(mode).alias("parse_mode"), F.struct(F.array(buttons).alias("inline_keyboard")).alias("reply_markup")))
