"""Removal of word windows that occur more than once, with a count-min sketch in front of the exact grouping."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.llm import runs

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])


def drop_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, anchor: int = 8, sketch_rows: int = 2, most_bits: int = 26
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (the words that stay, joined by one space).

    A word falls if a window of ``window`` consecutive words covers it whose words also start anywhere
    else, in the same text or another. Words are runs of bytes other than 0x20 and 0x09-0x0D.

    Every partition counts the anchors of its windows in ``sketch_rows`` hashed rows of up to ``2 ** most_bits``
    cells; the sketches are summed. A window occurs at most as often as its anchor, and the least of the
    anchor's cells is no less than that, so the sketch never underestimates a window. Only windows
    estimated twice or more go on: their runs are grouped by two 64-bit hashes, then the windows of
    anchors whose runs differ one by one. The sketch follows the size of the text up to that bound: with far more text it lets more
    windows through, and none is lost.

    Null text: no words. Texts shorter than a window keep all. Null ids are allowed. Rows with the same id
    and different texts are different documents; a row repeated as a whole is an occurrence like any other.
    Input columns named like the new ones are replaced.
    """
    plan = runs.Plan("word", window, (anchor, window))
    key = runs.keyed(docs, id_col, text_col)
    rows = docs.select(*key)
    spans = runs.per_text(runs.repeated_spans(rows, plan, earlier=False, sketch_rows=sketch_rows, most_bits=most_bits))

    @F.arrow_udf(RESULT)
    def rebuild(text: pa.Array, found: pa.Array) -> pa.Array:
        total, lost, kept = [], [], []
        for t, s in zip(text, found):
            words = (t.as_py() or "").encode().split()
            mask = runs.covered(s.values, len(words), window) if s.is_valid else np.zeros(len(words), bool)
            total.append(len(words))
            lost.append(int(mask.sum()))
            kept.append(b" ".join(compress(words, ~mask) if lost[-1] else words).decode())
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept_text"])

    return runs.rebuilt(docs, key, spans, rebuild)
