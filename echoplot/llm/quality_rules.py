"""Repetition coverage: how much of a text lies inside n-grams and lines that it repeats.

Rolling hashes of several n-gram lengths, in numpy over whole texts, some MB at a time.
A text is kept if it passes the base rules and no coverage is over its limit:
characters in the most frequent 2-, 3- or 4-word gram, characters in 5- to 10-word
grams that occur again, and characters in lines that occur again.

Null and empty texts have no words and fail the base rule; memory is bounded by a
chunk of texts or the longest text; repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, RollingHash, chunks, mix, read, row_counts, words

#: published limits of web-corpus repetition filters
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars double, top_gram_chars double, dup_gram_chars double, base_failed boolean, kept boolean"


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For grams by place: does it occur again in its row, its count, is it the first of its kind."""
    order = np.lexsort((np.arange(len(key)), mix(key + row.astype(U) * U(0x9E3779B97F4A7C15))))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    again, count, first = np.zeros(len(k), bool), np.zeros(len(k), np.int64), np.zeros(len(k), bool)
    count[order] = size[group]
    again[order] = size[group] > 1
    first[order] = new
    return again, count, first


def _covered(flag: np.ndarray, span: int, n: int) -> np.ndarray:
    """Words inside a flagged gram of `span` words."""
    d = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flag)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + span, n), -1)
    return np.cumsum(d[:-1]) > 0


def coverage(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and coverage of each text of a chunk."""
    n = len(off) - 1
    start, stop, row = words(raw, off)
    head = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before a byte
    chars = (head[stop] - head[start]).astype(np.int64)
    total = np.bincount(row, chars, n).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    marks = np.concatenate([[0], np.cumsum(symbol[raw])])
    out = {"n_words": row_counts(row, n), "word_chars": total, "n_symbols": (marks[off[1:]] - marks[off[:-1]]).astype(np.int64)}

    hashes = RollingHash(raw)
    h = hashes.spans(start, stop)
    rows_ok, repeat, top, dup = {}, np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    gram, floor = h.copy(), np.maximum(total, 1)
    over = np.zeros(n, bool)
    for k in range(2, max(DUP_LIMITS) + 1):
        m = len(h) - k + 1
        if m <= 0:
            break
        gram = mix(gram[:m] * U(0x9E3779B97F4A7C15) + h[k - 1 :])
        whole = row[:m] == row[k - 1 :]
        at = np.flatnonzero(whole)
        if not len(at):
            break
        again, count, first = _repeats(gram[at], row[at])
        full = np.zeros(m, bool)
        full[at] = again
        if k == 3:
            repeat = np.bincount(row, _covered(full, k, len(h)), n).astype(np.int64)
        if k in TOP_LIMITS:
            size = np.concatenate([[0], np.cumsum(chars)])
            length = size[at + k] - size[at]
            share = np.zeros(n)
            pick = first & again
            np.maximum.at(share, row[at][pick], (count * length)[pick] / floor[row[at][pick]])
            over |= share > TOP_LIMITS[k]
            top = np.maximum(top, share)
        if k in DUP_LIMITS:
            share = np.bincount(row, chars * _covered(full, k, len(h)), n) / floor
            over |= share > DUP_LIMITS[k]
            dup = np.maximum(dup, share)

    # lines: from a text's start or a line feed to the next one or the text's end
    feed = np.flatnonzero(raw == 10)
    of = np.searchsorted(off, feed, "right") - 1
    begin, end = np.concatenate([off[:-1], feed + 1]), np.concatenate([feed, off[1:]])
    line_row = np.concatenate([np.arange(n), of])
    order = np.lexsort((begin, line_row))
    begin, line_row = begin[order], line_row[order]
    end = np.concatenate([feed, off[1:]])[np.lexsort((np.concatenate([feed, off[1:]]), np.concatenate([of, np.arange(n)])))]
    first_word = np.searchsorted(start, begin, "left")
    has = first_word < len(start)
    has[has] = start[first_word[has]] < end[has]
    begin, end, line_row = begin[has], end[has], line_row[has]
    again, _, first = _repeats(hashes.spans(begin, end), line_row) if len(begin) else (np.zeros(0, bool),) * 3
    later = again & ~first
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n).astype(np.int64)
    ink = np.concatenate([[0], np.cumsum(chars)])
    line_chars = ink[np.searchsorted(start, end, "left")] - ink[np.searchsorted(start, begin, "left")]
    out["dup_line_chars"] = np.bincount(line_row[later], line_chars[later], n) / floor
    out |= {"n_repeat_words": repeat, "top_gram_chars": top, "dup_gram_chars": dup}
    out["base_failed"] = (out["n_words"] < 50) | (100 * repeat > 50 * out["n_words"])
    out["kept"] = ~(out["base_failed"] | over | (out["dup_line_chars"] > LINE_LIMIT))
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs; see SCHEMA."""

    def run(batches):
        for rows, raw, off in chunks(batches, "text"):
            with np.errstate(over="ignore"):
                found = coverage(raw, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[f]) for f in names)], ["doc_id", *names])

    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return repetition(read(spark, sf_dir, "documents"))


QUERIES = {"op5_repetition_coverage": op5_quality_rules}
ORACLES: dict[str, str] = {}
