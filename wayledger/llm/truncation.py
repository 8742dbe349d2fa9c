"""Problem 6: text cut off by field limits or in transfer.

Two kinds of evidence are combined by Bayes' rule. Lengths: per source a length distribution is fitted by maximum
likelihood with right censoring at candidate limits, which gives the odds that a value of exactly that length was cut.
Endings: over all texts it is counted how often each pair of words ends a sentence, stands within one, and begins longer
words; a cut lands on an ending in proportion to the places it has in running text, a complete text ends where texts end.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.session import use_checkpoints

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?]+(?=[\s\"')\]]|$)")
_DIGITS = str.maketrans("123456789", "000000000")
_DOTS = re.compile(r"\s*(?:…|\.\.\.)$")
_ENTITY = re.compile(r"&#?\w{0,8}$")
_OPEN = re.compile(r"[\s]*[(\[{\"“‘,;:/&+\-–—]$")

#: Part of the complete texts that end in a known last word after an unknown one, and weight of any unknown ending.
TYPO, UNSEEN = 0.002, 0.003

#: Beginnings of words are written out up to so many letters; longer ones are looked for among the words that share these.
WORD = 40

#: Pairs held in a map task's memory before they are passed on; LETTERS of words longer than WORD count as a pair.
MOST_PAIRS, LETTERS = 400_000, 100


def _hangs(sign: str) -> bool:
    """Whether a sign is none that closes a sentence: currency, operators, joiners, opening marks and the like."""
    return sign in "@#*\\&§¿¡" or sign != ">" and unicodedata.category(sign) in ("Sc", "Sm", "Sk", "Pc", "Pd", "Ps", "Pi")


def ending(text: str) -> tuple[str, str]:
    """(kind of ending, text before it). Kinds: stop (a sentence's end), dots, open (a sign that must go on, or an unfinished entity), broken (a
    damaged character), sign (one that closes no sentence but may end a text), blank (white space after a word), word."""
    bare = text.rstrip()
    if bare.endswith("�"):
        return "broken", bare.rstrip("�")
    if m := _DOTS.search(bare):
        return "dots", bare[: m.start()]
    if _OPEN.search(bare) or _ENTITY.search(bare):
        return "open", bare
    if bare and _hangs(bare[-1]):
        return "sign", bare
    if not bare or not (bare[-1].isalnum()):
        return "stop", bare
    return ("blank" if len(bare) < len(text) else "word"), bare


def tokens(text: str) -> list[str]:
    """Words in lower case with every digit as 0, however long, and the stops of sentences."""
    return _TOKEN.findall(text.lower().translate(_DIGITS))


_SCHEMA = pa.schema([("what", pa.string()), ("src", pa.string()), ("row_key", pa.int64()), ("feed", pa.string()), ("len", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("kind", pa.string()), ("mid", pa.int64()), ("fin", pa.int64())])


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: counts of word pairs and of lengths, summed within the task, and a row for each text whose
    ending needs judging."""
    pairs: Counter = Counter()
    lengths: Counter = Counter()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)

    def counts() -> pa.RecordBatch:
        mid: dict[tuple, list[int]] = {}
        for (x, y, stop), n in pairs.items():
            mid.setdefault((x, y), [0, 0])[stop] += n
        rows = [("pair", None, None, None, None, x, y, None, m, e) for (x, y), (m, e) in mid.items()]
        rows += [("length", s, None, f, n, None, None, k, c, 0) for (s, f, n, k), c in lengths.items()]
        pairs.clear()
        lengths.clear()
        return batch(rows)

    held = 0
    for b in batches:
        rows = []
        for src, key, feed, text in zip(*(b[c].to_pylist() for c in ("src", "row_key", "feed", "text"))):
            kind, stem = ending(text)
            toks = tokens(text)
            held += sum(len(t) for t in toks if len(t) > WORD)
            after = ["", *toks]
            nxt = [t[0] in ".!?" for t in toks[1:]]
            pairs.update([(x, y, s) for x, y, s in zip(after, toks, nxt) if y[0] not in ".!?"])
            lengths[src, feed, len(text), "judge" if kind != "stop" else "stop"] += 1
            if kind != "stop":
                last = tokens(stem)[-2:] if kind in ("dots", "broken", "open") else toks[-2:]
                x, y = ("", "", *last)[-2:]
                rows.append(("row", src, key, feed, len(text), x, y, kind, None, None))
        if rows:
            yield batch(rows)
        if len(pairs) + len(lengths) + held // LETTERS > MOST_PAIRS:
            yield counts()
            held = 0
    yield counts()


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _upper(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.atleast_1d(z)])


def fit_censored(log_len: np.ndarray, weight: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(mean, deviation) of the logarithm of lengths by maximum likelihood, where a censored value is only a lower bound
    (expectation-maximisation over the censored ones)."""
    mu = float(np.average(log_len, weights=weight))
    sd = max(0.05, math.sqrt(float(np.average((log_len - mu) ** 2, weights=weight))))
    for _ in range(rounds):
        z = (log_len - mu) / sd
        hazard = _phi(z) / np.maximum(_upper(z), 1e-300)
        first = np.where(censored, mu + sd * hazard, log_len)
        second = np.where(censored, mu * mu + sd * sd + sd * hazard * (log_len + mu), log_len**2)
        mu = float(np.average(first, weights=weight))
        sd = max(0.05, math.sqrt(max(0.0, float(np.average(second, weights=weight)) - mu * mu)))
    return mu, sd


def limits(lengths: np.ndarray, counts: np.ndarray, least: int = 4) -> list[tuple[int, float]]:
    """(limit, odds that a value of this length was cut) of one source. Candidates are lengths at which at least half of
    all values that reach them stop, and which stand out of the lengths just below."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order].astype(float)
    keep = lengths > 0
    lengths, counts = lengths[keep], counts[keep]
    if not len(lengths):
        return []
    reach = np.cumsum(counts[::-1])[::-1]
    found = []
    for i in np.nonzero((counts >= least) & (counts * 2 >= reach) & (lengths >= 20))[0]:
        below = counts[(lengths >= lengths[i] - 10) & (lengths < lengths[i])].sum() / 10
        if counts[i] > 5 * (below + 0.3):
            found.append(i)
    if not found:
        return []
    censored = np.isin(np.arange(len(lengths)), found)
    mu, sd = fit_censored(np.log(lengths), counts, censored)
    out = []
    for i in found:
        z = (math.log(lengths[i]) - mu) / sd
        alive = float(_upper(np.array([z]))[0])
        density = float(_phi(np.array([z]))[0]) / (sd * lengths[i])
        part = counts[i] / reach[i]  # of those that got so far, the part that the limit stopped
        out.append((int(lengths[i]), part * alive / max(density, 1e-12)))
    return out


def source_limits(lengths: DataFrame) -> DataFrame:
    """(src, feed, limit, odds) from rows (src, feed, len, n). A source's histogram has a row a length."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = limits(pdf["len"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"src": pdf["src"].iloc[0], "feed": pdf["feed"].iloc[0], "limit": [r[0] for r in rows], "odds": [r[1] for r in rows]})

    return lengths.groupBy("src", "feed").applyInPandas(one, "src string, feed string, limit long, odds double")


def _begun(words: DataFrame, ends: DataFrame, by: list[str], n: str) -> DataFrame:
    """(by, b, n): for each last word b of ends, how often longer words with this beginning stand in words (by, b, n)."""
    asked = ends.select(*by, "b").distinct()
    starts = F.explode(F.expr(f"transform(sequence(1, least(length(b) - 1, {WORD})), i -> substring(b, 1, i))"))
    short = words.where("length(b) > 1").select(*by, starts.alias("b"), n).join(asked, [*by, "b"], "left_semi")
    head = F.substring("b", 1, WORD).alias("_head")
    whole = words.where(F.length("b") > WORD).select(*by, F.col("b").alias("_whole"), head, n)
    long = asked.where(F.length("b") > WORD).select(*by, "b", head).join(whole, [*by, "_head"]).where(F.col("_whole").startswith(F.col("b")) & (F.length("_whole") > F.length("b")))
    return short.unionByName(long.select(*by, "b", n)).groupBy(*by, "b").agg(F.sum(n).alias(n))


def judged(texts: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(cut, lengths): cut has (src, row_key, feed, len, kind, probability) for every text that was cut with a probability
    above the threshold; lengths has (src, feed, len, n) for all texts.

    texts: src, row_key, feed and text. Null and blank texts are complete; a null feed is a source of its own; repeated
    rows are judged alike; very long texts are read whole. A text that ends with a stop is complete, one that ends with a
    sign that must go on, or a damaged character, is cut.
    """
    spark = texts.sparkSession
    use_checkpoints(spark)
    seen = texts.where("text is not null").select("src", "row_key", F.coalesce("feed", F.lit("")).alias("feed"), "text")
    evidence = seen.mapInArrow(_evidence, "what string, src string, row_key long, feed string, len long, a string, b string, kind string, mid long, fin long").checkpoint()
    lengths = evidence.where("what = 'length'").groupBy("src", "feed", "len").agg(F.sum("mid").alias("n"))
    found = source_limits(lengths).collect()  # a few limits a source
    odds = F.broadcast(spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in found], "src string, feed string, len long, limit_odds double"))
    rows = evidence.where("what = 'row'").select("src", "row_key", "feed", "len", "a", "b", "kind").join(odds, ["src", "feed", "len"], "left")

    pairs = evidence.where("what = 'pair'").groupBy("a", "b").agg(F.sum("mid").alias("mid"), F.sum("fin").alias("fin"))
    free = F.col("limit_odds").isNull()
    ends = rows.groupBy("a", "b", "kind").agg(F.count(F.when(free, 1)).alias("n"), F.count("*").alias("all"))
    longer = _begun(pairs.select("a", "b", (F.col("mid") + F.col("fin")).alias("ext")), ends, ["a"], "ext")
    # places where a cut leaves this ending: within longer words, after the word, and after the blank behind it
    known = ends.join(pairs, ["a", "b"], "left").join(longer, ["a", "b"], "left").na.fill(0, ["mid", "fin", "ext"])
    after_word = F.greatest(F.col("mid") + F.col("fin"), F.lit(0))
    known = known.withColumn("places", F.when(F.col("kind").isin("blank", "sign"), F.col("mid")).otherwise(after_word + F.col("ext")).cast("double"))
    vocabulary = pairs.groupBy("b").agg(F.sum("fin").alias("fin_b"), F.sum(F.col("mid") + F.col("fin")).alias("n_b"))
    beginnings = _begun(vocabulary.select("b", F.col("n_b").alias("ext_b")), ends, [], "ext_b")
    known = known.join(vocabulary, "b", "left").join(beginnings, "b", "left").na.fill(0, ["fin_b", "n_b", "ext_b"])
    # no word by itself, but the beginning of usual ones: a piece, also where the word before it is new
    piece = ~F.col("kind").isin("blank", "sign") & (F.col("ext_b") >= 50 * (F.col("n_b") + 1))
    known = known.withColumn("places", F.col("places") + F.when(piece, 1.0).otherwise(0.0))
    known = known.checkpoint()
    # endings that no sentence has show how many cuts there are to a place
    running = F.col("mid") + F.col("ext")
    sure = (F.col("fin") == 0) & (running >= 3 * F.col("all")) & (running >= 20)
    totals = known.groupBy("kind").agg(F.sum(F.when(sure, F.col("n"))).alias("cuts"), F.sum(F.when(sure, F.col("places"))).alias("at")).collect()  # a row a kind
    by_kind = lambda v: F.coalesce(F.create_map(F.lit(""), F.lit(0.0), *[x for k, y in v.items() for x in (F.lit(k), F.lit(float(y)))])[F.col("kind")], F.lit(0.0))
    known = known.withColumn("cuts", F.col("places") * by_kind({r["kind"]: (r["cuts"] or 0) / (r["at"] or 1) for r in totals}))
    # texts that end so without having been cut: a sentence's end that lost its stop, a closing remark, a typing error
    lost = known.where("fin > 0 and kind = 'word'").agg(F.sum(F.greatest(F.col("n") - F.col("cuts"), F.lit(0.0))), F.sum("fin")).first()
    lost_rate = F.when(F.col("kind") == "word", F.lit((lost[0] or 0.0) / (lost[1] or 1))).otherwise(F.lit(0.0))
    excess = F.greatest(F.lit(0.0), F.col("n") - F.col("cuts") - 3.0 * F.sqrt("cuts") - 2.0)
    known = known.withColumn("complete", excess + lost_rate * (F.col("fin") + TYPO * F.col("fin_b")) + F.when(piece, UNSEEN / 20).otherwise(UNSEEN))
    words = pairs.agg(F.sum((F.col("mid") + F.col("fin")) * F.length("b") + F.col("mid"))).first()
    all_places = float(words[0] or 0) or 1.0
    texts_n = float(lengths.agg(F.sum("n")).first()[0] or 0) or 1.0
    free_p = F.col("cuts") / (F.col("cuts") + F.col("complete"))
    known = known.select("a", "b", "kind", free_p.alias("free_p"), (((F.col("places") + 0.5) / all_places) / (F.col("complete") / texts_n)).alias("ratio"))
    hit = rows.join(known, ["a", "b", "kind"])
    limit_odds = F.col("limit_odds") * F.col("ratio")
    p = F.when(F.col("kind").isin("open", "broken"), 1.0).when(F.col("limit_odds").isNotNull(), limit_odds / (1.0 + limit_odds)).otherwise(F.col("free_p"))
    return hit.withColumn("probability", p).where(F.col("probability") > threshold).select("src", "row_key", "feed", "len", "kind", "probability"), lengths


def cut_rates(cut: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per source: texts, cut texts and their share."""
    n = lengths.groupBy("src", "feed").agg(F.sum("n").alias("texts"))
    k = cut.groupBy("src", "feed").agg(F.count("*").alias("cut"))
    return n.join(k, ["src", "feed"], "left").na.fill(0, ["cut"]).withColumn("rate", F.col("cut") / F.col("texts"))
