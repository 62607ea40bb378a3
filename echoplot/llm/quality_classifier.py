"""Quality classification by hierarchical empirical Bayes.

Document evidence: two logistic classifiers (low quality; toxic) over shape features of
the text and two learned lexicons. Site evidence: the expected numbers of bad documents
of every host and of every path of it, from the classifiers over the whole table, by
grouped aggregation. A host's rate is shrunk toward the global rate and a path's toward
its host's, by beta priors whose strength is fitted by moments on the host rates; sparse
sites so stay near the prior. A document's final log-odds are the classifier's plus the
difference between its site's posterior log-odds and the prior's, bounded.

The fit uses at most `max_labels` labelled documents, those whose id hashes lowest (a
documented bound); everything else covers all rows. Feature sums, not texts, come to the
driver: at most `max_labels` rows of some twenty numbers.

Null and empty texts are scored like others from their features, very long ones whole; a
null source or language is a site of its own; repeated rows are scored alike; rows of one
id with different texts are scored by their own texts, and a label counts for any one of
them; labels with a null are left out, and of several for an id the lower quality and the
toxic one hold; without labels of both kinds a classifier rejects nothing; an empty table
gives an empty result. `classify` returns its own columns only, `accepted` those of docs,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, RollingHash, chunks, read, row_counts, words, written

MAX_LABELS, LEXICON, SITE_REACH = 20_000, 2_000, 1.0
REJECT = 0.5
FEATURES = ("symbols", "upper", "digits", "punctuation", "marked", "short", "long", "repeats", "top_word", "double_marks", "bars", "bad_words", "toxic_words", "toxic_any", "log_words")


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of lower-cased words without the ASCII marks around them, and where the words are."""
    start, stop, row = words(raw, off)
    low = LOWER[raw]
    inner = ((low >= 97) & (low <= 122)) | (low >= 128) | ((low >= 48) & (low <= 57))
    upto = np.concatenate([[0], np.cumsum(inner)])
    count = upto[stop] - upto[start]
    at = np.append(np.flatnonzero(inner), 0)
    first = np.where(count > 0, at[np.minimum(upto[start], len(at) - 1)], start)
    last = np.where(count > 0, at[np.maximum(upto[stop] - 1, 0)] + 1, start)
    with np.errstate(over="ignore"):
        h = RollingHash(low).spans(first, last)
    return h, start, stop, row, count


def features(raw: np.ndarray, off: np.ndarray, bad: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text. bad, toxic: sorted hashes of the lexicons."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    kind = np.zeros(256, np.uint8)
    kind[list(b"#*$%&|<>")] = 1
    kind[65:91], kind[48:58], kind[list(b"!?.,;:")] = 2, 3, 4
    k = kind[raw]
    letters = np.maximum(per((LOWER[raw] >= 97) & (LOWER[raw] <= 122)), 1)
    twin = np.zeros(len(raw), bool)
    twin[1:] = (raw[1:] == raw[:-1]) & (k[1:] > 0) & (k[1:] != 2) & (k[1:] != 3)
    h, start, stop, row, inner = word_hashes(raw, off)
    count = row_counts(row, n)
    w = np.maximum(count, 1)
    share = lambda mask: np.bincount(row[mask], minlength=n)
    length = stop - start
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    if len(h):
        np.maximum.at(top, row[order][new], runs)
    known = lambda lexicon: np.isin(h, lexicon) if len(lexicon) else np.zeros(len(h), bool)
    n_toxic = share(known(toxic))
    return np.column_stack(
        [per(k == 1) / size, per(k == 2) / letters, per(k == 3) / size, per(k == 4) / w, share(length - inner >= 2) / w, share(length <= 3) / w, share(length >= 16) / w, share(same) / w, top / w, per(twin) / w, per(raw == 124) / w]
        + [share(known(bad)) / w, np.minimum(n_toxic / w * 50, 3), np.minimum(n_toxic, 3), np.log1p(count)]
    ).astype(float)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.ok = len(y) > 0 and 0 < y.sum() < len(y)
        if not self.ok:
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        b = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * b)
            b += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-7:
                break
        self.b = b

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(x), -20.0)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(self.b[0] + z @ self.b[1:], -20, 20)


def lexicons(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words that stand in clearly more low-quality, or toxic, documents than in others. sample: text, quality, toxic."""

    def run(batches):
        for rows, raw, off in chunks(batches, "text"):
            h, _, _, row, inner = word_hashes(raw, off)
            h, row = h[inner > 0], row[inner > 0]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            low, tox = rows.column(1).to_numpy(zero_copy_only=False)[row], rows.column(2).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(low.astype(np.int64)), pa.array(tox.astype(np.int64))], ["h", "low", "tox"])

    each = sample.select("text", (F.col("quality") == 0).cast("int").alias("low"), F.col("toxic").cast("int").alias("tox")).mapInArrow(run, "h long, low long, tox long")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 0).cast("int")).alias("low"), F.sum("toxic").alias("tox")).first()
    table = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("tox").alias("tox"))
    out = []
    for name in ("low", "tox"):
        n, hits = int(total["n"] or 0), int(total[name] or 0)
        rate = hits / n if n else 0
        # standard score of the count against the base rate, and a rate well over it
        z = (F.col(name) - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9))
        found = table.where((F.col("n") >= 4) & (F.col(name) >= F.col("n") * min(0.6, 3 * rate))).withColumn("z", z).where("z > 5.0")
        found = found.orderBy(F.desc("z"), "h").limit(LEXICON)  # the size of a lexicon is part of the model
        out.append(np.sort(np.array([r.h for r in found.select("h").collect()], np.int64).astype(U)))
    return out[0], out[1]


class Model:
    def __init__(self, docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS):
        kept = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        # at most max_labels rows: small enough to send to every task
        chosen = F.broadcast(kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
        sample = written(docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]), "label-sample")
        self.bad, self.toxic = lexicons(sample)
        bad, toxic = self.bad, self.toxic

        def run(batches):
            for rows, raw, off in chunks(batches, "text"):
                x = features(raw, off, bad, toxic)
                yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), *(pa.array(c) for c in x.T)], ["low", "tox", *FEATURES])

        rows = sample.select("text", (F.col("quality") == 0).cast("int").alias("low"), F.col("toxic").cast("int").alias("tox")).mapInArrow(run, "low int, tox int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
        x = rows[list(FEATURES)].to_numpy(float)
        self.low, self.tox = Logistic(x, rows["low"].to_numpy(float)), Logistic(x, rows["tox"].to_numpy(float))


def evidence(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "source", "lang"), text: str = "text", texts: bool = False) -> DataFrame:
    """keep (and the text itself, if `texts`) plus log-odds of low quality and of toxicity from the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = [*keep, *([text] if texts else [])]

    def run(batches):
        m = shipped.value
        for rows, raw, off in chunks(batches, text):
            x = features(raw, off, m.bad, m.toxic)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(out)], pa.array(m.low.log_odds(x)), pa.array(m.tox.log_odds(x))], [*out, "low_odds", "tox_odds"])

    picked = docs.select(*keep, text)
    kinds = ", ".join(f"`{c}` {t}" for c, t in picked.select(*out).dtypes)
    return picked.mapInArrow(run, f"{kinds}, low_odds double, tox_odds double")


def sites(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """One row for each host and path (__h, __p; null is a value): low_site and tox_site, the bounded difference of the
    path's posterior log-odds from the prior's."""
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    paths = scored.groupBy(F.col(host).alias("__h"), F.col(path).alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.sum(p("low_odds")).alias("low"), F.sum(p("tox_odds")).alias("tox"))
    hosts = paths.groupBy(F.col("__h").alias("__host")).agg(F.sum("n").alias("hn"), F.sum("low").alias("hlow"), F.sum("tox").alias("htox"))
    every = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"h{k}").alias(k) for k in ("low", "tox")], *[F.sum(F.col(f"h{k}") * F.col(f"h{k}") / F.col("hn")).alias(f"{k}2") for k in ("low", "tox")], F.count(F.lit(1)).alias("hosts"), F.sum(F.col("hn") * F.col("hn")).alias("nn")).first()
    out = paths.join(hosts, F.col("__h").eqNullSafe(F.col("__host")))
    for k in ("low", "tox"):
        n = float(every["n"] or 1)
        mean = min(max((every[k] or 0) / n, 1e-6), 1 - 1e-6)
        # moments: variance of host rates over what counting alone gives; strength of the beta prior from it
        between = max((every[f"{k}2"] or 0) - n * mean * mean - (every["hosts"] - 1) * mean * (1 - mean), 0) / max(n - (every["nn"] or 0) / n, 1e-9)
        strength = min(max(mean * (1 - mean) / between - 1, 10), 1e5) if between > 0 else 1e5
        rate = (F.col(f"h{k}") + strength * mean) / (F.col("hn") + strength)
        site = (F.col(k) + strength * rate) / (F.col("n") + strength)
        shift = F.log(site / (1 - site)) - float(_logit(mean))
        out = out.withColumn(f"{k}_site", F.greatest(F.lit(-SITE_REACH), F.least(F.lit(SITE_REACH), shift)))
    return out.select("__h", "__p", "low_site", "tox_site")


def posteriors(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """scored plus the low_site and tox_site of each row's site."""
    return scored.join(sites(scored, host, path), F.col(host).eqNullSafe(F.col("__h")) & F.col(path).eqNullSafe(F.col("__p"))).drop("__h", "__p")


def classify(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, reject: float = REJECT) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, p_low, p_toxic, score, kept."""
    model = Model(docs, labels, max_labels)
    scored = posteriors(written(evidence(docs, model), "evidence"))
    p = lambda k: 1 / (1 + F.exp(-(F.col(f"{k}_odds") + F.col(f"{k}_site"))))
    out = scored.withColumn("p_low", p("low")).withColumn("p_toxic", p("tox"))
    out = out.withColumn("score", (1 - F.col("p_low")) * (1 - F.col("p_toxic")))
    return out.withColumn("kept", (F.col("p_low") < reject) & (F.col("p_toxic") < reject)).select("doc_id", "source", "lang", "low_odds", "tox_odds", "p_low", "p_toxic", "score", "kept")


def accepted(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, reject: float = REJECT) -> DataFrame:
    """The rows of docs that the classifier keeps. Texts are read once: rows with their evidence are written, sites
    come from its narrow columns. Sites are a table of their own, so that their size is known when the join is
    planned: few go to the texts, and texts are only dealt by site where sites are too many to send. Columns of docs
    may have any names."""
    model = Model(docs, labels, max_labels)
    # every column by its place, so that no name of docs clashes with a working one
    names = [f"__c{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    plain = docs.toDF(*names)
    keep = tuple(n for c, n in own.items() if c != "text")
    judged = written(evidence(plain, model, keep, own["text"], texts=True), "evidence")
    site = written(sites(judged, own["source"], own["lang"]), "sites")
    told = judged.join(site, F.col(own["source"]).eqNullSafe(F.col("__h")) & F.col(own["lang"]).eqNullSafe(F.col("__p")))
    cut = float(_logit(reject))
    kept = told.where((F.col("low_odds") + F.col("low_site") < cut) & (F.col("tox_odds") + F.col("tox_site") < cut))
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
