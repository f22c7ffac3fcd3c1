"""Removal of byte strings that an earlier document holds, by a radix sort of suffixes of limited depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.llm import runs

RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_bytes", T.BinaryType()),
])


def drop_earlier_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, digits: tuple[int, ...] = (20, 40, 50), most_bits: int = 29
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed stretches) and ``kept_bytes``.

    A byte falls if a ``length``-byte string covers it that also starts in a document with a smaller id.
    Texts are UTF-8 bytes; strings lie within one text.

    Texts that are copies of a smaller id's as a whole fall whole and are not ordered.
    Suffixes are ordered only as deep as ``length`` bytes, by passes over digits of growing significance.
    The first pass deals them out by the first digit, the ``digits[0]`` bytes at the anchor of each string; a
    histogram of up to ``2 ** most_bits`` buckets, summed over partitions, closes the buckets with one entry.
    What stays is grouped by content: groups whose members agree as a whole are settled; the others
    go to the next pass with a longer digit. The last digit is the string itself, where equal groups are
    exactly the repeated strings. Suffixes travel as runs that share their anchor, not one by one.

    Null text: empty. Null ids count as larger than all others. Equal ids are never smaller than each other.
    Input columns named like the new ones are replaced.
    """
    if digits[-1] != length:
        raise ValueError("the last digit has to be as long as the string")
    plan = runs.Plan("byte", length, tuple(digits))
    key = runs.keyed(docs, id_col, text_col)
    rows = docs.select(*key)
    spans = runs.per_text(runs.repeated_spans(rows, plan, earlier=True, sketch_rows=1, most_bits=most_bits))

    @F.arrow_udf(RESULT)
    def rebuild(text: pa.Array, found: pa.Array) -> pa.Array:
        total, lost, stretches, kept = [], [], [], []
        for t, s in zip(text, found):
            data = (t.as_py() or "").encode()
            total.append(len(data))
            if s.is_valid:
                mask = runs.covered(s.values, len(data), length)
                lost.append(int(mask.sum()))
                stretches.append(int((mask[1:] & ~mask[:-1]).sum() + mask[0]))
                data = np.frombuffer(data, np.uint8)[~mask].tobytes()
            else:
                lost.append(0)
                stretches.append(0)
            kept.append(data)
        return pa.StructArray.from_arrays([*(pa.array(x, pa.int64()) for x in (total, lost, stretches)), pa.array(kept, pa.binary())], RESULT.names)

    return runs.rebuilt(docs, key, spans, rebuild)
