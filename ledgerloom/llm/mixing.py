"""Mixing sources to target weights by soft membership.

A classifier fitted on a sample of the labelled documents (their own source column) says how likely a text belongs to each
domain; how far it is to be sharpened or flattened is fitted on held-out documents of the sample. With the label, trusted as
far as all documents together bear it out, it gives each document a membership in every domain. Document rates between
nought and the source's cap are then fitted by projected gradient steps until the expected tokens of each domain match its
target. A step needs one number per domain from one pass over (tokens, memberships); the rates are never stored, as each is
a short formula of the memberships and the steps so far. As what is owed is a share by written source, the rates of
each source are then shifted onto its goal. At last rates become whole numbers of uses.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import Stash

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The classifier is fitted on about so many labelled documents at most; everything else covers all documents.
MAX_TRAINING_DOCUMENTS = 20_000
BUCKETS = 1 << 14
#: Part of that sample, one in so many, that is held out to fit the sharpness of the posteriors and to measure them.
HELD_OUT = 5
#: Part of every posterior that is the frequency of the labels, whatever the text.
FLOOR = 0.05
#: Sharpness and trust are the likeliest of these.
SHARPNESS = tuple(round(2.0 ** (k / 2), 4) for k in range(-10, 7))
TRUSTS = tuple(1 - 2.0 ** -k for k in range(1, 15))
#: The descent goes on until the expected totals are off by no more than this part of all, by membership and then by label,
#: for so many steps at most.
SOFTLY, CONVERGED, STEPS = 5e-3, 1e-3, 40
#: Part of the largest feasible size that is used, so that caps leave the fit some room.
HEADROOM = 0.95
#: Documents of one source that one task turns to whole numbers together.
ROUNDING_BLOCK = 200_000


@lru_cache(4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


@lru_cache(1 << 18)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (BUCKETS - 1)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of the lower-case words, damped: (buckets, values) of those that occur."""
    at, n = np.unique(np.fromiter(map(_bucket, re.findall(r"\w+", text.lower())), dtype=np.int64), return_counts=True)
    return at, np.log1p(n).astype(np.float32)


@dataclass
class Classifier:
    """Naive Bayes over word buckets, its log odds scaled by ``sharpness``; ``report`` has the figures of the held-out documents:
    their number, accuracy and mean log loss, and both for always taking the frequencies of the labels."""

    domains: list[str]
    weights: np.ndarray
    priors: np.ndarray
    sharpness: float = 1.0
    report: dict[str, float] = field(default_factory=dict)

    def log_odds(self, text: str) -> np.ndarray:
        at, x = features(text)
        return (x @ self.weights[at]) / max(1.0, float(x.sum()) / 20) if len(at) else np.zeros(len(self.domains))  # words of one text are not independent

    def posterior(self, text: str) -> np.ndarray:
        logit = self.priors + self.sharpness * self.log_odds(text)
        p = np.exp(logit - logit.max())
        return (1 - FLOOR) * p / p.sum() + FLOOR * np.exp(self.priors)


def fit_classifier(labelled: DataFrame, domains: list[str], most: int = MAX_TRAINING_DOCUMENTS) -> Classifier:
    """Fitted on about ``most`` documents (doc_id, text, domain), chosen by a hash of doc_id; one in ``HELD_OUT`` of them only sets
    the sharpness. What comes to the driver is one sum per domain and bucket, so bounded whatever the number of documents."""
    n = labelled.count()
    draw = lambda seed, of: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(of))
    sample = labelled.where(draw(1, 1 << 30) < int((1 << 30) * min(1.0, most / max(n, 1)))).select("text", "domain", (draw(2, HELD_OUT) == 0).alias("held"))
    at = {d: i for i, d in enumerate(domains)}

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, docs = np.zeros((len(domains), BUCKETS)), np.zeros(len(domains))
        for df in frames:
            for text, domain in zip(df["text"], df["domain"]):
                k, x = features(text or "")
                total[at[domain], k] += x
                docs[at[domain]] += 1
        rows, cols = np.nonzero(total)
        yield pd.DataFrame({"d": np.r_[rows, np.arange(len(domains))], "b": np.r_[cols, np.full(len(domains), -1)],
                            "n": np.r_[total[rows, cols], docs]})

    got = sample.where("not held").select("text", "domain").mapInPandas(sums, "d int, b int, n double").groupBy("d", "b").agg(F.sum("n").alias("n")).collect()
    counts, docs = np.full((len(domains), BUCKETS), 0.05), np.full(len(domains), 1.0)
    for r in got:
        if r["b"] < 0:
            docs[r["d"]] += r["n"]
        else:
            counts[r["d"], r["b"]] += r["n"]
    fitted = Classifier(domains, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32), np.log(docs / docs.sum()))
    fitted.weights -= fitted.weights.mean(1, keepdims=True)
    shared = labelled.sparkSession.sparkContext.broadcast(fitted)

    def losses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums over held-out documents: their number, log loss and hits for each sharpness; 0 stands for the label frequencies."""
        c, out = shared.value, np.zeros((len(SHARPNESS) + 1, 3))
        for df in frames:
            for text, domain in zip(df["text"], df["domain"]):
                odds = c.log_odds(text or "")
                for k, sharp in enumerate((0.0, *SHARPNESS)):
                    logit = c.priors + sharp * odds
                    own = (1 - FLOOR) * np.exp(logit[at[domain]] - np.logaddexp.reduce(logit)) + FLOOR * np.exp(c.priors[at[domain]])
                    out[k] += 1, -np.log(own), logit.argmax() == at[domain]
        yield pd.DataFrame({"k": np.arange(len(out)), "n": out[:, 0], "loss": out[:, 1], "hits": out[:, 2]})

    held = {r["k"]: r for r in sample.where("held").select("text", "domain").mapInPandas(losses, "k int, n double, loss double, hits double").groupBy("k").agg(
        *[F.sum(c).alias(c) for c in ("n", "loss", "hits")]).collect()}
    if held and held[0]["n"]:
        best = min(range(1, len(SHARPNESS) + 1), key=lambda k: held[k]["loss"])
        fitted.sharpness = SHARPNESS[best - 1]
        m = held[0]["n"]
        fitted.report = {"documents": m, "accuracy": held[best]["hits"] / m, "log_loss": held[best]["loss"] / m,
                         "frequent_accuracy": held[0]["hits"] / m, "frequent_log_loss": held[0]["loss"] / m}
    return fitted


def posteriors(documents: DataFrame, classifier: Classifier, tokenizer: str) -> DataFrame:
    """``(doc_id, domain, tokens, p)``: p holds how likely the text is of each domain, whatever its label."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, c = encoder(tokenizer), shared.value
        for df in frames:
            texts = [t or "" for t in df["text"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "domain": df["domain"], "tokens": [len(count.encode_ordinary(t)) for t in texts],
                                "p": [c.posterior(t).tolist() for t in texts]})

    return documents.select("doc_id", "text", "domain").mapInPandas(score, "doc_id bigint, domain string, tokens bigint, p array<double>")


def _label_at(domains: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int")


def label_trust(scored: DataFrame, domains: list[str]) -> float:
    """How likely a document's label is its domain, the others equally likely to stand instead: the likeliest over all
    documents, in one pass. What no text contradicts is trusted up to the last of ``TRUSTS``."""
    own = F.element_at("p", _label_at(domains))
    rest = max(1, len(domains) - 1)
    got = scored.agg(*[F.sum(F.log(F.greatest(own * t + (1 - own) * ((1 - t) / rest), F.lit(1e-300)))).alias(f"t{i}") for i, t in enumerate(TRUSTS)]).first()
    return max(zip(TRUSTS, [x if x is not None else 0.0 for x in got]), key=lambda v: v[1])[0]


def memberships(scored: DataFrame, domains: list[str], trust: float) -> DataFrame:
    """``(doc_id, domain, tokens, q)``: q holds the membership in each domain, from text and label."""
    away = (1 - trust) / max(1, len(domains) - 1)
    weighed = F.transform("p", lambda x, i: x * F.when(i + 1 == _label_at(domains), trust).otherwise(away))
    whole = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return scored.withColumn("w", weighed).withColumn("whole", whole).select(
        "doc_id", "domain", "tokens", F.transform("w", lambda x: F.when(F.col("whole") > 0, x / F.col("whole")).otherwise(0.0)).alias("q"))


def _by_domain(values: dict[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for d, v in values.items() for x in (F.lit(d), F.lit(float(v)))]), F.col("domain")), F.lit(0.0))


def fitted_rates(documents: DataFrame, q: Column, start: Column, goals: np.ndarray, caps: dict[str, float], domains: list[str],
                 within: float = CONVERGED, steps: int = STEPS) -> Column:
    """The rate of each document, as a column over ``documents``, after projected gradient descent from ``start`` of the squared
    distance between the expected tokens of the domains, by the memberships ``q``, and the goals. Steps are scaled by each
    domain's own curvature and end when every total is met to ``within`` of all tokens, or where the caps leave no way nearer:
    three steps together bring the worst one less than a twentieth nearer."""
    cap = _by_domain(caps)
    rate = F.least(cap, start)
    k = range(len(domains))
    moves: list[np.ndarray] = []

    def current() -> Column:
        if not moves:
            return rate
        all_moves = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in moves])
        dot = lambda m: F.aggregate(F.zip_with(q, m, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.aggregate(all_moves, rate, lambda r, m: F.greatest(F.lit(0.0), F.least(cap, r - dot(m))))

    sums = lambda df: [np.array([x or 0.0 for x in row]).reshape(2, -1) for row in [df.agg(*[F.sum(F.col("r") * F.col("tokens") * F.col("q")[i]).alias(f"e{i}") for i in k], *[
        F.sum(F.when(F.col("cap") > 0, F.col("tokens")).otherwise(0) * F.col("q")[i] * F.col("q")[i]).alias(f"c{i}") for i in k]).first()]][0]
    off: list[float] = []
    for _ in range(steps):
        total, curve = sums(documents.select("tokens", q.alias("q"), current().alias("r"), cap.alias("cap")))
        short = total - goals
        off.append(np.abs(short).max() / max(goals.sum(), 1.0))
        if off[-1] <= within or (len(off) > 3 and off[-1] > 0.95 * off[-4]):
            break
        moves.append(np.where(curve > 0, short / np.maximum(curve, 1e-9), 0.0))
    return current()


def label_rates(documents: DataFrame, goals: dict[str, float], caps: dict[str, float], within: float = CONVERGED, steps: int = STEPS) -> Column:
    """``rate`` of ``documents`` projected onto the goals by label: one shift for all rates of a domain, cut at nought and its cap, so
    that its tokens come to the goal. A pass gives each domain's tokens and those that a shift still moves, from which the
    next shift follows; as tokens fall with the shift in straight pieces, a few passes do."""
    shifts = dict.fromkeys(goals, 0.0)
    cap = _by_domain(caps)
    whole = max(sum(goals.values()), 1.0)

    def shifted() -> Column:
        return F.greatest(F.lit(0.0), F.least(cap, F.col("rate") - _by_domain(shifts)))

    for _ in range(steps):
        moving = F.when((F.col("r") > 0) & (F.col("r") < F.col("cap")), F.col("tokens")).otherwise(0)
        got = documents.select("domain", "tokens", shifted().alias("r"), cap.alias("cap")).groupBy("domain").agg(
            F.sum(F.col("r") * F.col("tokens")).alias("held"), F.sum(moving).alias("moving"), F.sum("tokens").alias("all")).collect()  # one row per domain
        off = {r["domain"]: (r["held"] - goals[r["domain"]]) for r in got if r["domain"] in goals}
        if all(abs(x) <= within * whole / max(len(goals), 1) for x in off.values()):
            break
        for r in got:
            if r["domain"] in goals and r["all"]:
                shifts[r["domain"]] += off[r["domain"]] / (r["moving"] or r["all"])
    return shifted()


def mixed_documents(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None) -> DataFrame:
    """``(doc_id, source, tokens, repeats)`` of every document used, ``repeats`` times from 1 to its source's cap.

    The mix is as large as the shares allow (or ``total_tokens``, if less): the scarcest source is used up to its cap.
    Targets without documents get no tokens, the others keep their proportions; documents of sources without target are
    not used. Sources are compared in lower case, trimmed. Null texts have no tokens and are not used; of repeated ids
    every row is a document of its own; an empty table on either side gives an empty mix.
    """
    spark = documents.sparkSession
    stash = Stash(spark)
    wanted = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("source")).agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()  # one row per source of the mix
    share = {r["source"]: float(r["share"] or 0.0) for r in wanted}
    cap = {r["source"]: float(r["cap"] or 1) for r in wanted}
    domains = [*sorted(share), "(other)"]
    key = source_key(F.col("source"))
    pool = documents.where("text is not null and doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.when(key.isin(*share), key).otherwise("(other)").alias("domain"))
    scored = stash.put(posteriors(pool, fit_classifier(pool, domains), tokenizer))
    have = {r["domain"]: float(r["t"] or 0) for r in scored.groupBy("domain").agg(F.sum("tokens").alias("t")).collect()}
    live = {s: v for s, v in share.items() if have.get(s, 0) > 0 and v > 0}
    whole = sum(live.values())
    if not live:
        return scored.limit(0).select("doc_id", F.col("domain").alias("source"), "tokens", F.lit(0).alias("repeats"))
    size = min(have[s] * cap[s] / (v / whole) for s, v in live.items())
    size = min(HEADROOM * size, total_tokens) if total_tokens else HEADROOM * size
    goals = np.array([size * live.get(d, 0.0) / whole for d in domains])
    caps = {s: cap[s] for s in live}
    soft = memberships(scored.where(F.col("domain").isin(*live)), domains, label_trust(scored, domains))
    soft = stash.put(soft)
    soft = soft.withColumn("rate", fitted_rates(soft, F.col("q"), F.lit(float(size / sum(have[s] for s in live))), goals, caps, domains, SOFTLY))
    settled = stash.put(soft.select("doc_id", "domain", "tokens", "rate"))
    rate = label_rates(settled, {s: size * v / whole for s, v in live.items()}, caps)
    rated = settled.select("doc_id", F.col("domain").alias("source"), "tokens", rate.alias("rate"))
    return whole_uses(rated)


def whole_uses(rated: DataFrame) -> DataFrame:
    """Rates to whole numbers by systematic rounding: in order of size the running sum of fractions decides which documents
    get one use more, so the tokens of a source stay within about a document of what was meant.

    Large sources are rounded in blocks, so that no task holds a whole one.
    """
    counts = rated.groupBy("source").agg(F.ceil(F.count("*") / ROUNDING_BLOCK).alias("blocks"))  # one row per source
    order = F.xxhash64("doc_id", "tokens")
    placed = rated.join(F.broadcast(counts), "source").withColumn("block", F.pmod(F.xxhash64(order), F.col("blocks")))
    w = Window.partitionBy("source", "block").orderBy("tokens", order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("rate") - F.floor("rate")
    run = placed.withColumn("part", part).withColumn("sum", F.sum("part").over(w))
    extra = F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("part") + 0.5)
    return run.select("doc_id", "source", "tokens", (F.floor("rate") + extra).cast("int").alias("repeats")).where("repeats > 0")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the target table: its target share, cap, and what the mix reached."""
    used = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    total = used.agg(F.sum("tokens_used")).first()[0] or 1
    goal = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    return goal.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce(F.col("tokens_used") / F.lit(float(total)), F.lit(0.0)), 6).alias("actual_share"))
