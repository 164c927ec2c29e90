"""Greedy CTC decoding of logit sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import strip
from matchloom.functions.vectors import argmax, softmax

# Symbols by index; index 0 is the blank, so no space is ever emitted.
NAME_CHARSET = " 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.'-é♀♂"
NUMBER_CHARSET = " 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ/"


def decode(sequences: DataFrame, charset: str, id_col: str = "seq_id", logits_col: str = "logits") -> DataFrame:
    """seq_id, text, confidence (mean of accepted steps, 0 without any).

    A step counts if its symbol is not blank, differs from the step before (whatever that
    was) and is in the charset.  A sequence stays in its row: no shuffle.
    """
    steps = F.transform(F.col(logits_col), lambda v: F.struct(argmax(v).alias("i"), F.array_max(softmax(v)).alias("p")))
    named = sequences.select(F.col(id_col).alias("seq_id"), steps.alias("steps"))
    before = F.concat(F.array(F.lit(-1)), F.transform("steps", lambda s: s["i"]))
    paired = named.select("seq_id", F.zip_with("steps", F.slice(before, 1, F.greatest(F.size("steps"), F.lit(1))), lambda s, b: F.struct(s["i"].alias("i"), s["p"].alias("p"), b.alias("b"))).alias("steps"))
    kept = F.filter("steps", lambda s: (s["i"] != 0) & (s["i"] != s["b"]) & (s["i"] < len(charset)))
    accepted = paired.select("seq_id", kept.alias("kept"))
    text = F.array_join(F.transform("kept", lambda s: F.substring(F.lit(charset), s["i"] + 1, F.lit(1))), "")
    total = F.aggregate("kept", F.lit(0.0), lambda a, s: a + s["p"].cast("double"))
    return accepted.select("seq_id", strip(text).alias("text"), F.coalesce(F.try_divide(total, F.size("kept")), F.lit(0.0)).alias("confidence"))
