"""A skip-chain conditional random field over tokens, for whole batches of documents at once.

Besides its neighbours, a token shares a potential, one weight for each pair of labels, with the last token before it in
the document that is the same (whatever the letter case), one letter off, or the name to its initial, so that evidence at
one mention reaches the other. Marginals come from loopy message passing: forward and backward sums along the chain, then
messages over the skip edges, by turns. All documents of a batch are passed along together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

LABELS = ("O", "email", "phone", "id_number", "address", "name")
#: Places around a token whose own features count for it.
WINDOW = (-3, -2, -1, 0, 1, 2, 3)

_TOKEN = re.compile(r"\s?(?:[^\W\d_]+|\d+|[^\w\s]|_)")
#: Ends of road names, short forms included (fixed values).
_ROAD = frozenset("road rd street st lane ln avenue ave close drive dr way row gate fold terrace bank grove brow crescent".split())
_TITLE = frozenset("mr mrs ms miss dr prof rev cllr".split())
_PLACE = frozenset("arms park primary school sons inn church hall".split())


def keys(text: str) -> list[str]:
    """The tokens of a text: runs of letters, runs of digits, single signs, each with the blank before it, if any."""
    return _TOKEN.findall(text)


def tokenize(text: str) -> list[tuple[int, int, str]]:
    """(from, to, key) of each token, the places without the blank."""
    return [(m.start() + m.group()[0].isspace(), m.end(), m.group()) for m in _TOKEN.finditer(text)]


def _bare(key: str) -> str:
    return key[1:] if key[0].isspace() else key


def token_features(key: str) -> list[str]:
    """Features of a token by itself."""
    t = _bare(key)
    glued = "+" if t is key else " "
    low = t.lower()
    if t.isdigit():
        return [f"g{glued}", f"d{min(len(t), 13)}", f"g{glued}d{min(len(t), 13)}", f"p{t[:2]}" if len(t) > 2 else "p", "digits", f"P{t[:4]}" if len(t) > 4 else "P"]
    if not t[0].isalpha():
        return [f"s{t}", f"g{glued}s{t}", "sign"]
    if low.strip("o") == "" and t is key and len(t) <= 4:  # letters that may stand for noughts
        return [f"noughts{min(len(t), 3)}", "noughts", "g+"]
    case = "A" if t.isupper() and len(t) > 1 else "C" if t[0].isupper() else "a"
    out = [f"w{low}", f"g{glued}{case}", f"c{case}", f"l{min(len(t), 4)}", f"x{low[-3:]}", f"g{glued}l{min(len(t), 4)}"]
    for name, words in (("road", _ROAD), ("title", _TITLE), ("place", _PLACE)):
        if low in words:
            out += [name, name + case]
    return out


#: Words of so many letters and more also meet those that are one letter off.
NEAR = 5


def link_keys(key: str) -> tuple[str, ...]:
    """What a token meets similar ones by: a word of two letters and more by itself in lower case, a longer one also by
    what is left without one of its letters (two words that are one letter off share such a rest), numbers of three digits
    and more by themselves. Other tokens meet none."""
    t = _bare(key).lower()
    if t.isdigit():
        return (t,) if len(t) >= 3 else ()
    if not t.isalpha() or len(t) < 2:
        return ()
    return (t, *dict.fromkeys(t[:i] + t[i + 1 :] for i in range(len(t)))) if len(t) >= NEAR else (t,)


def links(places: list[int], keys_: list[tuple[str, ...]], initials: dict[int, str], follows: dict[int, str]) -> list[tuple[int, int]]:
    """(earlier place, later place): each token with the last one before it by each of its keys; places rise. initials has
    the letter of each single-letter token, follows the word behind a place: an initial meets the name that begins with it
    and has the same word behind it."""
    last: dict[object, int] = {}
    out: dict[tuple[int, int], None] = {}
    for p, own in zip(places, keys_):
        if p in follows:
            own = (*own, (initials[p] if p in initials else own[0][0], follows[p]))
        for k in own:
            q = last.get(k)
            if q is not None:
                out[q, p] = None
            last[k] = p
    return list(out)


@dataclass
class Chains:
    """A batch of documents: types[b, t] numbers the token's type, -1 behind the end; edges are pairs of places."""

    types: np.ndarray
    lengths: np.ndarray
    edges: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), dtype=np.int64))  # document, place, later place


@dataclass
class Kinds:
    """What is known of each type of token: the keys that it meets others by (none for common words), its letter if it is
    an initial, its word if it can follow one."""

    keys: list[tuple[str, ...]] = field(default_factory=list)
    letters: list[str] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)

    def add(self, key: str, common: frozenset[str]) -> None:
        bare = _bare(key).lower()
        letter = bare if len(bare) == 1 and bare.isalpha() else ""
        self.keys.append(() if bare in common else link_keys(key))
        self.letters.append(letter)
        self.linked.append(bool(self.keys[-1]) or bool(letter))


def chains(types: list[list[int]], kinds: Kinds) -> Chains:
    """Documents as lists of type numbers, with the skip edges between their similar tokens."""
    n = len(types)
    lengths = np.fromiter(map(len, types), dtype=np.int64, count=n)
    wide = int(lengths.max()) if n else 0
    out = np.full((n, wide), -1, dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(types), dtype=np.int32, count=int(lengths.sum()))
    out[np.arange(wide)[None, :] < lengths[:, None]] = flat
    linked = np.array(kinds.linked, dtype=bool)
    edges = []
    where = np.nonzero(linked[flat])[0] if len(flat) else np.zeros(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(n), lengths)[where]
    starts = np.searchsorted(doc, np.arange(n + 1))
    for d in np.nonzero(np.diff(starts) > 1)[0].tolist():
        own = where[starts[d] : starts[d + 1]] - first[d]
        row = types[d]
        places = own.tolist()
        initials, follows, held = {}, {}, []
        for a, b in zip(places, [*places[1:], -9]):
            t = row[a]
            if kinds.letters[t]:
                initials[a] = kinds.letters[t]
            # the word behind a name, or behind an initial and its stop
            if b > a and kinds.keys[row[b]] and not kinds.keys[row[b]][0].isdigit() and (b == a + 1 and kinds.keys[t] and not kinds.keys[t][0].isdigit() or a in initials and 1 <= b - a <= 2):
                follows[a] = kinds.keys[row[b]][0]
            held.append(kinds.keys[t])
        edges += [(d, q, p) for q, p in links(places, held, initials, follows)]
    return Chains(out, lengths, np.array(edges, dtype=np.int64).reshape(-1, 3))


def emissions(c: Chains, table: np.ndarray) -> np.ndarray:
    """Scores of each label at each place: the sum over the window of the tokens' own vectors (table: window x types x
    labels; its last type stands for what lies outside of the document)."""
    b, t = c.types.shape
    wide = np.full((b, t + 2 * max(WINDOW)), -1, dtype=np.int32)
    wide[:, max(WINDOW) : max(WINDOW) + t] = c.types
    out = np.zeros((b, t, table.shape[2]), dtype=np.float32)
    for k, o in enumerate(WINDOW):
        out += table[k][wide[:, max(WINDOW) + o : max(WINDOW) + o + t]]
    return out


#: A token at least as certain to be O as this has no say over a skip edge whose other end is as certain.
SURE = 1 - 1e-5


def marginals(c: Chains, scores: np.ndarray, trans: np.ndarray, start: np.ndarray, skip: np.ndarray, rounds: int = 2, pairs: bool = False, whole: bool = False):
    """Label probabilities at each place, by message passing; with pairs also the expected transitions and pairs of labels
    over skip edges. whole: all documents go all rounds."""
    b, t, k = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    inside = np.arange(t)[None, :] < c.lengths[:, None]
    local[~inside] = 1.0
    move, first = np.exp(trans).astype(np.float32), np.exp(start).astype(np.float32)
    agree = np.exp(skip).astype(np.float32)  # earlier label x later label
    e = c.edges
    if not pairs and len(e) and rounds and not whole:
        # documents without skip edges are exact after one pass, and edges between two tokens that are both certain to be
        # O move nothing; the documents with others go round by themselves
        out = marginals(Chains(c.types, c.lengths), scores, trans, start, skip)
        open_ = (out[e[:, 0], e[:, 1], 0] < SURE) | (out[e[:, 0], e[:, 2], 0] < SURE)
        if open_.any():
            docs = np.unique(e[open_, 0])
            mine = np.isin(e[:, 0], docs)
            t_own = int(c.lengths[docs].max())
            own = Chains(c.types[docs, :t_own], c.lengths[docs], np.c_[np.searchsorted(docs, e[mine, 0]), e[mine, 1:]])
            out[docs, :t_own] = marginals(own, scores[docs, :t_own], trans, start, skip, rounds, whole=True)
        return out
    if not len(e):
        rounds = 0
    to_late = np.full((len(e), k), 1.0 / k, dtype=np.float32)
    to_early = to_late.copy()
    for turn in range(rounds + 1):
        unary = local.copy()
        if turn:
            np.multiply.at(unary, (e[:, 0], e[:, 2]), to_late)
            np.multiply.at(unary, (e[:, 0], e[:, 1]), to_early)
        fw, bw = np.empty_like(unary), np.empty_like(unary)
        a = unary[:, 0] * first
        fw[:, 0] = a / a.sum(axis=1, keepdims=True)
        for i in range(1, t):
            a = (fw[:, i - 1] @ move) * unary[:, i]
            fw[:, i] = np.where(inside[:, i, None], a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30), fw[:, i - 1])
        bw[:, t - 1] = 1.0 / k
        for i in range(t - 2, -1, -1):
            a = (bw[:, i + 1] * unary[:, i + 1]) @ move.T
            bw[:, i] = np.where(inside[:, i + 1, None], a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30), 1.0 / k)
        p = fw * bw
        p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-30)
        if turn < rounds:
            early, late = p[e[:, 0], e[:, 1]] / np.maximum(to_early, 1e-6), p[e[:, 0], e[:, 2]] / np.maximum(to_late, 1e-6)
            new_late, new_early = early @ agree, late @ agree.T
            to_late, to_early = (m / np.maximum(m.sum(axis=1, keepdims=True), 1e-30) for m in (new_late, new_early))
    if not pairs:
        return p
    x = fw[:, :-1, :, None] * move[None, None] * (bw[:, 1:] * unary[:, 1:])[:, :, None, :]
    x /= np.maximum(x.sum(axis=(2, 3), keepdims=True), 1e-30)
    both = np.zeros((k, k))
    if len(e):
        early, late = p[e[:, 0], e[:, 1]] / np.maximum(to_early, 1e-6), p[e[:, 0], e[:, 2]] / np.maximum(to_late, 1e-6)
        joint = early[:, :, None] * agree[None] * late[:, None, :]
        both = (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-30)).sum(axis=0)
    return p, (x * inside[:, 1:, None, None]).sum(axis=(0, 1)), both


def feature_ids(features: dict[str, int], key: str) -> list[int]:
    """Numbers of a token's features; a word that isn't among them counts as unknown, by its letter case, whatever its
    last letters."""
    names = token_features(key)
    if names[0][0] == "w" and names[0] not in features:
        names = [f for f in names if f[0] != "x"] + ["unknown", "unknown" + names[2]]
    return [i for f in names if (i := features.get(f)) is not None]


#: Classes of tokens, of which those of a token and its two neighbours together have a weight for each label.
CLASSES = ("outside", "word", "Word", "rare", "Rare", "RARE", "letter", "title", "road", "digits", "long digits", ",", "stop", "sign")


def class_of(features: dict[str, int], key: str) -> int:
    t = _bare(key)
    if t.isdigit():
        return CLASSES.index("digits" if len(t) <= 3 else "long digits")
    if not t[0].isalpha():
        return CLASSES.index("," if t == "," else "stop" if t in ".!?" else "sign")
    low = t.lower()
    if len(t) == 1:
        return CLASSES.index("letter")
    for name, words in (("title", _TITLE), ("road", _ROAD)):
        if low in words:
            return CLASSES.index(name)
    if f"w{low}" in features:
        return CLASSES.index("Word" if t[0].isupper() else "word")
    return CLASSES.index("RARE" if t.isupper() else "Rare" if t[0].isupper() else "rare")


def triples(c: Chains, classes: np.ndarray) -> np.ndarray:
    """At each place the number of the classes of the token before, itself and after; classes[-1] is that of outside."""
    b, t = c.types.shape
    own = np.zeros((b, t + 2), dtype=np.int32)
    own[:, 1:-1] = classes[c.types]
    n = len(CLASSES)
    return (own[:, :-2] * n + own[:, 1:-1]) * n + own[:, 2:]


@dataclass
class Model:
    """Weights: feature -> window x labels; transitions, starts, pairs of labels over skip edges; the common words, which
    have no skip edges."""

    features: dict[str, int]
    weights: np.ndarray  # window x features x labels
    trans: np.ndarray
    start: np.ndarray
    skip: np.ndarray
    common: frozenset[str]
    shapes: np.ndarray  # triples of classes x labels

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self._types: dict[str, int] = {}
        self._rows = np.zeros((len(WINDOW), 4096, len(LABELS)), dtype=np.float32)
        self._kinds = Kinds()
        self._classes = np.zeros(4096, dtype=np.int32)
        self._outside = self.weights[:, [self.features["outside"]]].sum(axis=1)

    def _type_of(self, key: str) -> int:
        """The number of a token's type; its vectors are worked out once."""
        n = self._types.get(key)
        if n is None:
            n = self._types[key] = len(self._types)
            if n + 1 >= self._rows.shape[1]:
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)], axis=1)
                self._classes = np.concatenate([self._classes, np.zeros_like(self._classes)])
            self._classes[n] = class_of(self.features, key)
            self._rows[:, n] = self.weights[:, feature_ids(self.features, key)].sum(axis=1)
            self._kinds.add(key, self.common)
        return n

    def types(self, keys_: list[str]) -> list[int]:
        out = list(map(self._types.get, keys_))
        if None in out:
            out = [self._type_of(k) if n is None else n for k, n in zip(keys_, out)]
        return out

    def table(self) -> np.ndarray:
        n = len(self._types)
        rows = self._rows[:, : n + 1]
        rows[:, n] = self._outside  # -1 points here
        return rows

    def scores(self, c: Chains) -> np.ndarray:
        table = self.table()
        return emissions(c, table) + self.shapes[triples(c, self._classes[: table.shape[1]])]

    def label(self, documents: list[list[str]], block: int = 1024) -> list[np.ndarray]:
        """The likeliest label of each token. Documents of like length are passed along together."""
        if len(self._types) > 300_000:
            self.reset()
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(documents)
        order = sorted((i for i, d in enumerate(documents) if d), key=lambda i: len(documents[i]))
        lo = 0
        while lo < len(order):
            hi = min(len(order), lo + block)
            while hi - lo > 1 and len(documents[order[hi - 1]]) * (hi - lo) > 200_000:  # very long ones by themselves
                hi = lo + (hi - lo) // 2
            part = order[lo:hi]
            lo = hi
            c = chains([self.types(documents[i]) for i in part], self._kinds)
            p = marginals(c, self.scores(c), self.trans, self.start, self.skip).argmax(axis=2)
            hit = p.any(axis=1)
            for row, i, h in zip(p, part, hit):
                out[i] = row[: len(documents[i])] if h else _NONE
        return out

    def certainty(self, documents: list[list[str]], block: int = 256) -> np.ndarray:
        """Of each document the probability of the label that is least certain."""
        out = np.ones(len(documents))
        for lo in range(0, len(documents), block):
            c = chains([self.types(d) for d in documents[lo : lo + block]], self._kinds)
            p = marginals(c, self.scores(c), self.trans, self.start, self.skip).max(axis=2)
            p[c.types < 0] = 1.0
            out[lo : lo + block] = p.min(axis=1)
        return out


#: Stands for a document without any label.
_NONE = np.zeros(0, dtype=np.int64)


def proper_words(documents: list[list[str]], words: dict[str, int], most: float = 0.02) -> set[str]:
    """Words in few documents that mostly have a capital within sentences: names of some kind. The field knows them by how
    they are written only, so that it can't learn which people there are."""
    from collections import Counter

    upper, every = Counter(), Counter()
    for d in documents:
        for before, k, after, then in zip(d, d[1:], [*d[2:], " "], [*d[3:], " ", " "]):
            t = _bare(k)
            joined = not (after[0].isspace() or after[0].isalnum() or after == "-" or then[0].isspace())  # part of an address or the like
            if t.isalpha() and (t is not k or before == "-") and not joined and _bare(before) not in (".", "!", "?", "¶"):
                every[t.lower()] += 1
                upper[t.lower()] += t[0].isupper() and not t.isupper()
    return {w for w, n in every.items() if upper[w] > 0.3 * n and words[w] <= most * len(documents)}


def train(documents: list[list[str]], labels: list[np.ndarray], epochs: int = 25, rate: float = 0.1, l2: float = 1e-5, least: int = 4, seed: int = 3, batch: int = 512) -> Model:
    """Maximum likelihood by Adam, the expectations by message passing over chain and skip edges. Words that stand in fewer
    than `least` documents are unknown ones."""
    from collections import Counter

    rng = np.random.default_rng(seed)
    counts = Counter(f for d in documents for f in {f for k in set(d) for f in token_features(k)})
    words = Counter(s for d in documents for s in {_bare(k).lower() for k in d} if s.isalpha())
    inside = Counter(s for d, y in zip(documents, labels) for k, v in zip(d, y) if v and (s := _bare(k).lower()))
    proper = proper_words(documents, words)
    common = frozenset(w for w, n in words.items() if n > 0.003 * len(documents) and inside[w] < 0.05 * n)
    features = {f: i for i, f in enumerate(sorted({f for f, n in counts.items() if n >= least and not (f[0] == "w" and f[1:] in proper)} | {"unknown", *(f"unknownc{x}" for x in "ACa")}))}
    features["outside"] = len(features)
    k = len(LABELS)
    model = Model(features, np.zeros((len(WINDOW), len(features), k), dtype=np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32), common, np.zeros((len(CLASSES) ** 3, k), np.float32))
    params = [model.weights, model.trans, model.start, model.skip, model.shapes]
    m1, m2 = [np.zeros_like(p, dtype=np.float64) for p in params], [np.zeros_like(p, dtype=np.float64) for p in params]
    kinds = {}
    for d in documents:
        for key in d:
            if key not in kinds:
                kinds[key] = feature_ids(features, key)
    names = list(kinds)
    number = {key: i for i, key in enumerate(names)}
    flat = np.concatenate([np.array(kinds[key], dtype=np.int64) for key in names] + [np.array([features["outside"]])])
    owner = np.repeat(np.arange(len(names) + 1), [*(len(kinds[key]) for key in names), 1])
    step = 0
    order = np.argsort([len(d) for d in documents], kind="stable")
    parts = [order[i : i + batch] for i in range(0, len(order), batch)]
    linked = Kinds()
    classes = np.array([*(class_of(features, key) for key in names), 0], dtype=np.int32)
    for key in names:
        linked.add(key, common)
    prepared = [chains([[number[key] for key in documents[i]] for i in part], linked) for part in parts]
    shaped = [triples(c, classes) for c in prepared]
    for epoch in range(epochs):
        for j in rng.permutation(len(parts)):
            part, c = parts[j], prepared[j]
            table = np.zeros((len(WINDOW), len(names) + 1, k), dtype=np.float32)
            for w in range(len(WINDOW)):
                for y in range(k):
                    table[w, :, y] = np.bincount(owner, weights=model.weights[w, flat, y], minlength=len(names) + 1)
            p, moves, both = marginals(c, emissions(c, table) + model.shapes[shaped[j]], model.trans, model.start, model.skip, pairs=True)
            truth = np.zeros_like(p)
            gold = np.zeros(c.types.shape, dtype=np.int64)
            for r, i in enumerate(part):
                gold[r, : len(labels[i])] = labels[i]
            mask = c.types >= 0
            np.put_along_axis(truth, gold[:, :, None], 1.0, axis=2)
            diff = (truth - p) * mask[:, :, None]
            wide = np.full((c.types.shape[0], c.types.shape[1] + 2 * max(WINDOW)), -1, dtype=np.int64)
            wide[:, max(WINDOW) : max(WINDOW) + c.types.shape[1]] = c.types
            wide[wide < 0] = len(names)
            grad_w = np.zeros_like(model.weights, dtype=np.float64)
            for w, o in enumerate(WINDOW):
                at = wide[:, max(WINDOW) + o : max(WINDOW) + o + c.types.shape[1]][mask]
                for y in range(k):
                    own = np.bincount(at, weights=diff[:, :, y][mask], minlength=len(names) + 1)
                    grad_w[w, :, y] = np.bincount(flat, weights=own[owner], minlength=len(features))
            grad_s = np.stack([np.bincount(shaped[j][mask], weights=diff[:, :, y][mask], minlength=len(model.shapes)) for y in range(k)], axis=1)
            true_moves = np.zeros((k, k))
            pair = mask[:, 1:]
            np.add.at(true_moves, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
            e = c.edges
            true_both = np.zeros((k, k))
            if len(e):
                np.add.at(true_both, (gold[e[:, 0], e[:, 1]], gold[e[:, 0], e[:, 2]]), 1)
            grads = [grad_w / len(part), (true_moves - moves) / len(part), diff[:, 0].sum(axis=0) / len(part), (true_both - both) / len(part), grad_s / len(part)]
            step += 1
            lr = rate * (1 - epoch / epochs) + 0.005
            for q, (prm, g) in enumerate(zip(params, grads)):
                g = g - l2 * prm
                m1[q] = 0.9 * m1[q] + 0.1 * g
                m2[q] = 0.999 * m2[q] + 0.001 * g * g
                prm += (lr * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)).astype(prm.dtype)
    model.reset()
    return model
