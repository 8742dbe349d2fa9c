"""Problem 10: abusive, hateful or sexual content."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm.string_kernel import Machine, collapse, fit_svm, kernel_with, nystroem, sketches

#: Labelled documents that the machine is fitted on at most, and landmarks of each kind.
MOST_LABELLED, LANDMARKS = 4_000, 140

#: Characters that look like letters (fixed values).
_LOOKALIKE = str.maketrans(
    {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ł": "l", "ø": "o", "đ": "d", "α": "a", "ο": "o", "ε": "e", "ι": "i", "’": "'", "‘": "'", "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None}
)
_DIGIT_LETTER = str.maketrans("4310$57@", "aeiossta")
_MIXED = re.compile(r"[^\s.,;:!?]*[$@0-9][^\s.,;:!?]*")
_SPREAD = re.compile(r"\b(?:[a-z*](?:[ \-_.*]))+[a-z]{1,3}\b")
_REPEAT = re.compile(r"([a-z])\1{2,}")
_TAG = re.compile(r"</?[a-z!][^<>]*>|&[a-z]{2,6};|&#[0-9]{1,6};")
_STOP = re.compile(r"[.!?\n\r]+(?=\s|$)|\n+")
_BLANKS = re.compile(r"\s+")
#: Characters of a piece of a run without a stop at most, and of a statement, by which neighbouring pieces overlap at least.
PIECE, STATEMENT = 240, 120


def _mixed(m: re.Match) -> str:
    t = m.group(0)
    letters = sum(ch.isalpha() for ch in t)
    if "$" in t or "@" in t or (letters and t[0].isalpha() is False) or letters >= 2 or (letters and len(t) == 2):
        return t.translate(_DIGIT_LETTER)
    return re.sub("[0-9]", "0", t)


def runs(text: str) -> list[str]:
    """The runs of a text between stops, in lower case, without markup, look-alike characters and marks on letters."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LOOKALIKE)
        if not text.isascii():
            text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _STOP.split(text)


def pieces(run: str) -> list[str]:
    """The sentences of a run in plain letters: digits that stand for letters, letters spread out or drawn out are put
    back. Runs of over PIECE characters are cut at blanks into pieces that overlap, so that any STATEMENT characters of a
    run stand in one piece. What holds no letter counts from 8 characters on."""
    s = _MIXED.sub(_mixed, run)
    s = _REPEAT.sub(r"\1", s)
    s = _SPREAD.sub(lambda m: re.sub(r"[ \-_.]", "", m.group(0)), s)
    s = _BLANKS.sub(" ", s).strip(" ,;:-\"'()[]")
    out = []
    while len(s) > PIECE:
        at = s.rfind(" ", PIECE - 60, PIECE)
        at = at if at > 0 else PIECE
        out.append(f" {s[:at].strip()} ")
        back = s.rfind(" ", PIECE - 60 - STATEMENT, at - STATEMENT + 1)  # not nearer than 60, so that few pieces cover a place
        s = s[back if back > 0 else at - STATEMENT :]
    s = s.strip()
    if len(s) >= 8 or any(ch.isalpha() for ch in s):
        out.append(f" {s} ")
    return out


def sentences(text: str) -> list[str]:
    """A text's sentences in plain lower-case letters."""
    return [s for run in runs(text) for s in pieces(run)]


#: Sentences written for this file, from common knowledge of such language and not from any table, that anchor the machine
#: where few documents are labelled.
ABUSIVE = """
what an utter halfwit | get lost, pathetic loser | disgusting piece of shit | fuck off and leave us alone | everyone hates your guts, fat pig | fucking idiots, the lot of them | complete arsehole | stupid bitch | dirty whore | bloody wanker | thick as pigshit, the useless prick | shut your face, dickhead
your mother should have drowned you at birth | we are going to kill you and your family | one more word and i'll knock your teeth out | watch your back, we know where you live | i hope you get cancer | burn in hell | you'll get a knife in your guts
send them all back, the dirty scroungers | gays are an abomination | gypsies are thieves and filth | muslims are a disease | jews must be punished | blacks are less than human | cripples are a waste of money and should be gassed | a woman's place is under a man's boot | those savages are not fit to live
he thrust into her while she begged for it | hot milf wants it hard | let me lick your naked breasts | hardcore porn of teens | masturbating in front of the camera | blowjobs for cash | she came all over his face
ty glupia krowo | spierdalaj stad | pierdolony debil | kurwa mac | y bastard twp | dos i uffern
""".replace("\n", "|").split("|")
HARMLESS = """
the minutes were agreed | thank you for the quick repair | the tram was late this morning | when will it be finished | i am angry that no answer came | this is a disgrace and a waste of money | the paper reports a racist attack | a man was fined for shouting abuse at a nurse
the charity helps victims of sexual violence | the chair regretted an offensive remark | pupils learned about the holocaust | breast screening is offered at the surgery | he was hit by a falling branch | shooting of the film closes the square | the terrier attacked a jogger | chicken breasts were reduced
the cock crowed at dawn | the weather is bloody awful | damn, missed the train | kill the engine while parked | she shot the penalty over the bar | the hate was gone from his voice | an idiot-proof timetable | stupid me, wrong number | the dying elm was felled
n/a | none | ok | yes | no | thanks | dziekuje za naprawe | diolch am y gwaith
""".replace("\n", "|").split("|")


#: Sentences whose kernel, divided by their lengths, is above this are taken for wordings of the same statement.
ALIKE = 0.55
#: Sentences that stand in harmless documents only, of which at most so many are taken for the fit: the most
#: frequent half of them, and as many drawn from the rest.
MOST_BESIDE = 8_000


def _lift(ask: list[str], holders: list[list[int]], own_minus: np.ndarray, others: list[str], minus: np.ndarray, n_plus: int, n_minus: int) -> np.ndarray:
    """For each sentence asked about: how many times likelier its like is in offensive documents than in others. holders
    has the places in ask of each offensive document's sentences, its own document doesn't count; own_minus counts the
    other documents with the very sentence, minus those with each of others."""
    held = np.zeros((len(ask), len(holders)), dtype=np.float32)
    for k, ids in enumerate(holders):
        held[ids, k] = 1
    mine, theirs = sketches(ask), sketches(others)
    out = np.zeros(len(ask))
    for lo in range(0, len(ask), 512):
        near = (mine[lo : lo + 512] @ mine.T > ALIKE).astype(np.float32)
        p = (near @ held > 0).sum(axis=1) - 1
        n = (mine[lo : lo + 512] @ theirs.T > ALIKE) @ minus + near @ own_minus
        out[lo : lo + 512] = ((np.maximum(p, 0) + 0.6) / n_plus) / ((n + 0.3) / n_minus)
    return out


def _doubtful(names: list[str], chosen: set[int], once: list[int]) -> set[int]:
    """Sentences of one harmless document that are alike to two or more of the offensive ones: a reviewer may have erred."""
    if len(chosen) < 2 or not once:
        return set()
    like = sketches([names[i] for i in sorted(chosen)])
    return {i for lo in range(0, len(once), 4096) for i, k in zip(once[lo : lo + 4096], (sketches([names[i] for i in once[lo : lo + 4096]]) @ like.T > ALIKE).sum(axis=1)) if k >= 2}


def fit(labelled: list[tuple[str, float]], seed: int = 5, rounds: int = 5) -> Machine:
    """A machine for sentences from documents with a label for the whole document (the mean of its reviews).

    An offensive document has one offensive sentence at least. At first those sentences are taken whose like, by the
    kernel, is far likelier in offensive documents than in others; then by turns the machine is fitted, and in each
    offensive document the sentences that it holds for offensive, one at least, are taken. All sentences of the other
    documents are harmless. Reviewers err: an 'offensive' document without any sentence that stands out, and a sentence of
    a 'harmless' one whose like is found in offensive documents, don't count. With no labels the sentences of this file
    alone are used.
    """
    rng = np.random.default_rng(seed)
    plus = [f" {s.strip()} " for s in ABUSIVE if s.strip()]
    minus = [f" {s.strip()} " for s in HARMLESS if s.strip()]
    bags = [(own, int(y >= 0.5)) for t, y in labelled if t and (own := list(dict.fromkeys(sentences(t))))]
    in_minus = Counter(s for own, y in bags if not y for s in own)
    in_plus = Counter(s for own, y in bags if y for s in own)
    suspect = sorted(in_plus)
    some = lambda x, n: [x[i] for i in sorted(rng.choice(len(x), min(n, len(x)), replace=False))] if x else []
    only = sorted(s for s in in_minus if s not in in_plus)
    often = sorted(only, key=lambda s: (-in_minus[s], s))[: MOST_BESIDE // 2]
    others = sorted(set(only) - set(often))
    drawn = some(others, MOST_BESIDE // 2)
    pool, part = often + drawn, [1.0] * len(often) + [len(others) / max(1, len(drawn))] * len(drawn)
    share = max(1, sum(1 for _, y in bags if not y)) / max(1, sum(y for _, y in bags))
    fresh = [s for s in suspect if in_plus[s] * share > 4 * in_minus[s]]
    landmarks, root = nystroem(list(dict.fromkeys([*plus, *minus, *some(fresh, 2 * LANDMARKS), *some(pool, LANDMARKS)])))
    index = {s: i for i, s in enumerate(dict.fromkeys([*plus, *minus, *pool, *suspect]))}
    x = kernel_with(list(index), landmarks) @ root
    down, often_plus = (np.array([c[s] for s in index], dtype=np.float32) for c in (in_minus, in_plus))
    lift = np.zeros(len(index))
    held = [[index[s] for s in own] for own, y in bags if y]
    if 0 < len(held) < len(bags):
        place = {index[s]: k for k, s in enumerate(suspect)}
        counts = np.array([in_minus[s] * p for s, p in zip(pool, part)], dtype=np.float32)
        own = np.array([in_minus[s] for s in suspect], dtype=np.float32)
        lift[list(place)] = _lift(suspect, [[place[i] for i in ids] for ids in held], own, pool, counts, len(held), len(bags) - len(held))
    anchors = [index[s] for s in plus], [index[s] for s in minus]
    doubtful: set[int] = set()
    w, b, value = np.zeros(x.shape[1]), 0.0, np.zeros(len(index))
    for turn in range(rounds if held else 1):
        chosen = set(anchors[0])
        for ids in held:
            if turn == 0:
                chosen.update(i for i in ids if lift[i] > 30)
            else:
                best = max(ids, key=lambda i: value[i] if lift[i] > 2.5 else -9.0)
                chosen.update(i for i in ids if value[i] > 0 and lift[i] > 2.5 or i == best and lift[i] > 5 and value[i] > -0.5)
        if turn == 0 and held:
            doubtful = _doubtful(list(index), chosen - set(anchors[0]), [index[s] for s, n in in_minus.items() if n == 1 and s in index])
        other = {index[s] for s in in_minus if s in index and lift[index[s]] < 5} - doubtful - chosen | set(anchors[1])
        ids = np.array([*sorted(chosen), *sorted(other)])
        y = np.r_[np.ones(len(chosen)), -np.ones(len(other))]
        weight = np.r_[np.full(len(chosen), max(1.0, min(8.0, len(other) / max(1, len(chosen))))), np.ones(len(other))]
        weight *= np.sqrt(np.maximum(1.0, np.where(y > 0, often_plus[ids], down[ids])))
        w, b = fit_svm(x[ids], y, weight)
        value = x @ w + b
        if turn == 0 and held:  # landmarks anew: from what was chosen, and from the harmless sentences nearest to it
            names = list(index)
            hard = sorted(other, key=lambda i: (-value[i], i))[:LANDMARKS]
            landmarks, root = nystroem(list(dict.fromkeys([*plus, *minus, *sorted((names[i] for i in chosen), key=lambda s: (-in_plus[s], s))[:LANDMARKS], *some([names[i] for i in sorted(chosen)], LANDMARKS), *(names[i] for i in hard), *some(pool, LANDMARKS)])))
            x = kernel_with(names, landmarks) @ root
            w, b = fit_svm(x[ids], y, weight)
            value = x @ w + b
    return collapse(landmarks, root, w, b)


_machines: dict[str, Machine] = {}


def fitted(labelled: list[tuple[str, float]]) -> Machine:
    """The machine of a labelled sample, fitted once in a session for each sample."""
    mark = hashlib.sha256(repr(labelled).encode()).hexdigest()
    if mark not in _machines:
        if len(_machines) >= 8:
            _machines.clear()
        _machines[mark] = fit(labelled)
    return _machines[mark]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[tuple[str, float]]:
    """(text, mean label) of at most `most` reviewed documents, the first in the order of a hash."""
    mean = labels.where("doc_id is not null and offensive is not null").groupBy("doc_id").agg(F.avg("offensive").alias("_y"))
    some = F.broadcast(mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select("doc_id", "text").join(some, "doc_id").collect()
    return [(r["text"] or "", float(r["_y"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def offence_scores(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the score of a document's most offensive sentence; above 0 it is held for offensive.

    Null and blank texts, and short ones without any letter, score -1 as they hold no sentence. Whole texts are read, however long. No shuffle.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((machine.weights, machine.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*held.value)
        known: dict[str, float] = {}  # runs that were scored before; texts and their sentences repeat
        for b in batches:
            texts = b["text"].to_pylist()
            out = np.full(b.num_rows, -1.0)
            lo = 0
            while lo < len(texts):
                hi, size, split = lo, 0, []
                while hi < len(texts) and size < 4_000_000:
                    split.append(runs(texts[hi]) if texts[hi] else [])
                    size += len(texts[hi] or "")
                    hi += 1
                fresh = {run: pieces(run) for run in dict.fromkeys(run for own_runs in split for run in own_runs if run not in known)}
                part = [s for found in fresh.values() for s in found]
                which = np.repeat(np.arange(len(fresh)), [len(found) for found in fresh.values()])
                best = np.full(len(fresh), -1.0)
                for at in range(0, len(part), 8192):
                    np.maximum.at(best, which[at : at + 8192], own.scores(part[at : at + 8192]))
                known.update(zip(fresh, best.tolist()))
                out[lo:hi] = [max([-1.0, *map(known.__getitem__, own_runs)]) for own_runs in split]
                if sum(map(len, fresh)) + len(known) > 1_000_000 or len(known) > 100_000:
                    known.clear()
                lo = hi
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(out)], ["key", "score"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(score, f"key {kind}, score double").withColumnRenamed("key", key)
