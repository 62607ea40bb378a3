"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded whole, once. Every token has a span of bytes; sections are spans
too, and an interval join (both sorted, so a binary search) gives each token to sections.
A token that crosses a boundary goes by a stated rule:

- `first`: to the section that holds its first byte;
- `most`: to the section that holds most of its bytes, the earlier one on a tie;
- `split`: to each section by its share of the token's bytes.

Under every rule the sections' counts sum to the document's count. Sections must cover a
text without overlap; the default cuts a text into lines, each with its line feed.

Null and empty texts have no tokens and no sections; long texts are processed whole;
repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, read
from .token_ids import tokenizer_path
from .tokens import encoder

RULES = ("first", "most", "split")


def lines(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the lines of a chunk's texts, as places in the chunk."""
    after = np.flatnonzero(raw == 10) + 1
    return np.unique(np.concatenate([off[:-1][np.diff(off) > 0], after[after < len(raw)]]))


def attribute(token_stop: np.ndarray, token_bytes: np.ndarray, section_start: np.ndarray, end: int, rule: str) -> np.ndarray:
    """Tokens of each section. Tokens and sections tile the same bytes."""
    start = token_stop - token_bytes
    n = len(section_start)
    if not n:
        return np.zeros(0)
    first = np.searchsorted(section_start, start, "right") - 1
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    stop = np.append(section_start[1:], end)
    last = np.searchsorted(section_start, np.maximum(token_stop - 1, start), "right") - 1
    out = np.bincount(first[first == last], minlength=n).astype(float)
    for t in np.flatnonzero(first != last):
        s = np.arange(first[t], last[t] + 1)
        share = np.minimum(stop[s], token_stop[t]) - np.maximum(section_start[s], start[t])
        if rule == "most":
            out[s[np.argmax(share)]] += 1
        else:
            out[s] += share / token_bytes[t]
    return out


SCHEMA = "doc_id long, n_bytes long, n_tokens long, section_tokens array<double>, n_crossing long"


def token_counts(docs: DataFrame, rule: str = "most", sections: Callable = lines, tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: its tokens, those of each section in order, and how many cross a boundary."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    tokenizer = tokenizer or tokenizer_path()

    def run(batches):
        encode = encoder(tokenizer)
        for rows, raw, off in chunks(batches, "text"):
            ids, cut = encode(raw, off)
            size = encode.token_bytes[ids]
            stop = np.cumsum(size)
            if len(stop) and stop[-1] != len(raw):
                raise ValueError("the tokenizer's tokens do not tile the text; a byte-level vocabulary is needed")
            begin = sections(raw, off)
            counts = attribute(stop, size, begin, len(raw), rule)
            inner = np.setdiff1d(begin, off)
            # a token crosses if a section starts after its first byte and before its end
            at = np.searchsorted(stop, inner, "right")
            crossing = np.unique(at[(stop[at] - size[at] < inner)]) if len(inner) else np.zeros(0, np.int64)
            of = np.searchsorted(cut, crossing, "right") - 1
            upto = np.searchsorted(begin, off, "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(off)), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(upto), pa.array(counts)), pa.array(np.bincount(of, minlength=len(off) - 1).astype(np.int64))],
                ["doc_id", "n_bytes", "n_tokens", "section_tokens", "n_crossing"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document; crossing tokens go to the line with most of their bytes."""
    out = token_counts(read(spark, sf_dir, "documents"))
    return out.withColumn("section_tokens", F.expr("transform(section_tokens, x -> bigint(x))"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
