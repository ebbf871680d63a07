"""Pluggable readers of images: any function from images to replies, or a table of replies; and what becomes of a reply."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import replies as R
from folio.functions.text import looks_described

# The fewest and most characters of a transcription.
LEAST, MOST = 3, 1200


def read(rows: DataFrame, image: str, reader: Callable[[pd.Series], pd.Series], name: str = "reply") -> DataFrame:
    """rows with a reply for each image, by batches; a null reply is a failed call. A reader may differ from call to call, so Spark repeats none by itself."""
    ask = F.pandas_udf(lambda images: pd.Series(reader(images), dtype=object), "string").asNondeterministic()
    return rows.withColumn(name, ask(F.col(image)))


def look_up(rows: DataFrame, transcripts: DataFrame, key: list[str], name: str = "reply") -> DataFrame:
    """rows with the replies of a table, where no reader is at hand; the least of several, null where there is none."""
    one = transcripts.groupBy(*key).agg(F.min("reply").alias(name))
    return rows.drop(name).join(one, key, "left")


def settle(reply: Column, kind: str, most: int = MOST) -> Column:
    """struct(state, text) of a reply to a prompt for a 'band', a 'spread', 'items' or 'text'.

    States: 'retry' (reads as the model's own commentary, or a band as a description), 'none' (a band without display type:
    the empty text), 'unread', 'length', 'ok'; a null reply is 'failed'. Text is null in all but 'none' and 'ok'.
    """
    flat = R.clean(reply)
    text = R.join_items(R.blocks_of(reply)) if kind == "spread" else R.join_items(R.items_of(reply)) if kind == "items" else flat
    text = R.join_broken_words(text)
    band = F.lit(kind == "band")
    state = (
        F.when(reply.isNull(), "failed").when(R.is_commentary(flat) | (band & looks_described(flat)), "retry").when(band & (F.trim(flat) == "NONE"), "none")
        .when(F.contains(flat, F.lit("CANNOT_READ")), "unread").when(~F.length(text).between(LEAST, most), "length").otherwise("ok")
    )
    return F.struct(state.alias("state"), F.when(state == "none", "").when(state == "ok", text).alias("text"))
