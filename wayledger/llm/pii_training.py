"""Training of the field for personal information: python -m wayledger.llm.pii_training REPORTS.parquet

No report is labelled by hand and no name of the reports is known here. Sentences with made-up people, addresses and
numbers, and with things that look like them, are put into reports; the field is trained on those, labels the reports
themselves, and is then trained again on both. In what it labelled, every name is exchanged for a made-up one, in
look-alikes too, so that it learns where names stand and how they are written, not which ones there are. In part of the
examples a person is named twice, once where only the other mention tells that it is a person: this is what the skip
edges learn from. The result is written to pii_model.npz beside this file; what is measured is printed.
"""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np

from wayledger.llm import crf
from wayledger.llm.pii import BREAK, find

#: Usual given names and surnames; as many again are made up from syllables, anew for each example.
GIVEN = "James Mary John Patricia Robert Jennifer Michael Linda David Susan William Karen Richard Sarah Thomas Emma Mohammed Fatima Ahmed Aisha Piotr Agnieszka Ivan Elena Chloe Olivia Harry George Amelia Ruth Peter Helen Gareth Sian Ewan Fiona".split()
FAMILY = "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Khan Patel Ahmed Hussain Singh Kaur Nowak Kowalska Murphy Kelly Hughes Edwards Clarke Cooper Ward Bailey Fletcher Marsden".split()
TITLES = "Mr Mrs Ms Miss Dr Mr Mrs Cllr Rev Prof".split()
ROADS = "Road Street Lane Avenue Close Drive Way Row Terrace Bank Grove Fold Gate Brow Crescent Rd St Ave".split()
TREES = "Ash Elm Birch Hill Mill Church Station Park Victoria Chapel Spring Bridge Long Green Lower Upper High Queen King Canal Harbour Meadow".split()

#: {n} a person, {e} e-mail, {p} phone, {i} identity number with what it is called, {a} address, {r} road.
CLEAR = """
My name is {n}. | I am {n} and I live nearby. | Regards, {n} | Kind regards, {n}. | Thanks, {n} | Many thanks {n} | Yours, {n}. | Signed, {n} | this is {n} from {r} | (reported by {n}) | Reported by {n}. | I spoke to {n} about it.
I spoke to {n} last week. | Ask {n}. | Ask for {n} at the door. | Please contact {n}. | {n} fell there and was hurt. | {n} told me that it is unsafe. | {n} tripped and broke an arm. | The tenant is {n}. | The {thing} belongs to {n}. | The {thing} is owned by {n} | This is {n} again. | It was left there by {n}. | The owner is called {n}.
- {n} | from {n} | again, from {n} | My neighbour {n} has complained too. | My mother, {n}, uses a wheelchair. | {n} here. | The driver gave the name {n}. | Speak to {n}, who saw it. | {n} will be at home. | For the attention of {n}. | {n} rang twice. | Sent on behalf of {n}.
My address for replies is {e}. | You can write to {e}. | Please copy {e}. | reply to {e} | Updates to {e} please. | {e} | email {e} | Use {e} for answers. | Photos were sent from {e}. | A letter has arrived at {e}. | Email: {e}
Ring me on {p}. | My mobile is {p}. | Tel: {p} | tel {p} | Call {p} after six. | - call {p} | Text {p} when the crew is near. | Out all day, so try {p}. | {p} is the best number to reach us. | Nobody picked up when they rang {p}. | Phone {p}. | {p}
I was told to quote {i}. | My details are {i}. | You already hold {i} for me. | The form asked for a number, it is {i}. | Claimant {i}. | Badge application, {i}. | claim {i} | {i}
I live at {a}. | We moved to {a}. | Water comes in at {a}. | The bins belong to {a}. | Knock at {a}. | The owner of {a} refuses to cut it. | Post for me goes to {a}. | {a} | She is stuck indoors at {a}. | outside {a} | from {a}
""".replace("\n", "|").split("|")
#: What firms do (for look-alikes).
TRADES = "Drainage Telecom Networks Power Gas Water Cable Civils Paving Surfacing Broadband Energy Electric Utilities Contractors Builders Rail Media Motors Catering".split()
THINGS = "car van dog skip bike caravan trailer house garage lorry wheelbarrow horse boat hedge wall tree".split()
#: Things that look like the above; {S} {G} words written like a surname and a given name, {N} a number.
ALIKE = """
The van from {S} and Sons is always there. | The {S} Arms is closed. | It is behind the {S} Arms. | {G} {S} Primary School is near. | The sign points to {S} Park. | {S} Ltd dug it up. | The crew of {S} Civils left it. | {G} {S} House is dark. | The old {S} Inn is shut. | the {G} {S} Centre | {S} Church | {S} {trade} promised to come back. | {S} {trade} has a page but nobody answers. | The workmen from {S} {trade} left it behind. | {S} {trade} dug here. | {S} {S2} {trade} have put up lights. | {G} {S} Primary is closed. | {S} Building Supplies
Your reference was {N3}-{N3}. | The ticket was {N5}/{N3}/{N2}. | The meter reads {N3} {N3} {N3} {N3}. | The asset tag reads {N5}-{L2}-{N3}. | The cabinet says {L2} {N3} {N3} {N2}. | The permit board shows {L2}-{N2}-{N3}. | Job {N9} is still open. | Order number {N9}. | Part {N9} is missing. | The invoice says {L2}{N6}.
Lamp column {N3} is the nearest one. | Bus stop {N3} and the shelter are damaged. | The {N2} bus along {r} is late. | {N2} potholes, {N3} yards apart. | {N1} jobs on {r} are open. | about {N3} metres up {r} | {N2} parked cars on {r} | Speed limit {N2} on {r}. | Serial {N6} {N4}. | It is {N2} years old. | bin {N1} of {N1}
It is near {r}. | The junction of {r} and {r}. | Someone at the council said so. | Ask the council. | Regards, a resident | Thanks, all of us on {r} | from the school | this is a blocked drain | reported by phone | I spoke to the crew. | write to the office | Email me | Ring me. | call the depot
""".replace("\n", "|").split("|")
#: Where a word pair may be a person or a place ({x}); what another mention of it tells.
DOUBTFUL = "near {x} | Opposite {x} | by {x} | It is at {x}. | beside {x} | Seen outside {x}. | {x} again | {x}: broken | Right behind {x}. | not far from {x} | {x} | About {x}. | next to {x} | across from {x}".split("|")
PLACE = "{x} Ltd has its yard there. | The {x} estate is close by. | We shop at {x} Stores. | {x} House is empty. | {x} Primary School is close. | The {x} Arms is shut. | {x} Park floods. | The firm {x} Civils dug there. | The {x} building is old.".split("|")


def made_up(rng: random.Random) -> str:
    """A word that could be a name."""
    head = "".join(rng.choice("b br c ch d dr f fl g gl h j k kr l m n p pr qu r s sh sk st t th tr v w wh wr y z".split() + [""]) + rng.choice("a e i o u y ai ea oo".split()) for _ in range(rng.choice((1, 2, 2, 3))))
    word = head + rng.choice("n ll rd ton ley s ss m ck th dale worth field by ham shaw wick sby more stead r l x nd rt a ia ie y o us ine ette".split())
    return word.capitalize() if rng.random() < 0.9 else f"{word.capitalize()}-{rng.choice(FAMILY)}"


def person(rng: random.Random, usual: float = 0.3) -> tuple[str, str]:
    pick = lambda words: rng.choice(words) if rng.random() < usual else made_up(rng)
    return pick(GIVEN), pick(FAMILY)


def cased(rng: random.Random, text: str, even: float = 0.6) -> str:
    return text if (x := rng.random()) < even else text.lower() if x < even + (1 - even) * 0.6 else text.upper()


def written(rng: random.Random, who: tuple[str, str]) -> str:
    """A person's name in one of the ways in which it is written."""
    g, f = who
    title = rng.choice(TITLES) + rng.choice(("", "", "", "."))
    return cased(rng, rng.choice((f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{f}, {g}", f"{title} {f}", f"{title} {f}", f"{title} {g[0]}. {f}", f"{title} {g} {f}")))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def email(rng: random.Random, who: tuple[str, str]) -> str:
    g, f = (w.lower() for w in who)
    local = rng.choice((f"{g}.{f}", f"{g}.{f}", f"{g[0]}{f}{_digits(rng, 2)}", f"{g}+{rng.choice(('roads', 'home', 'post'))}", f"{g}_{f}", f"{g}{_digits(rng, 3)}"))
    host = rng.choice(("", "", "mail.", "letters.", "home.")) + rng.choice(("example", "inbox", "webpost", "post")) + "." + rng.choice(("example", "com", "org", "net", "co.uk"))
    at = rng.random()
    if at < 0.7:
        return cased(rng, f"{local}@{host}", 0.8)
    return f"{local} [at] {host}" if at < 0.85 else f"{local} (at) {host.replace('.', ' dot ')}"


def phone(rng: random.Random) -> str:
    d = rng.choice((_digits(rng, 10), "7700900" + _digits(rng, 3), "1632960" + _digits(rng, 3), "2079460" + _digits(rng, 3)))  # also numbers kept free for fiction
    a, b, c = d[:4], d[4:7], d[7:]
    out = rng.choice((f"+44 {a} {b} {c}", f"+44 (0){d[:2]} {d[2:6]} {d[6:]}", f"0{d}", f"0{a} {b} {c}", f"0{a}.{b}.{c}", f"0{a}-{b}-{c}", f"0{a} {b}{c}", f"0{d[:2]} {d[2:6]} {d[6:]}", f"(0{a}) {b}{c}", f"0044 {a} {b}{c}", f"+44 {d[:2]} {d[2:6]} {d[6:]}"))
    if rng.random() < 0.4 and "0" in out and out[0] in "0(":  # letters for noughts, at random or all
        return re.sub("0", lambda m: rng.choice("0Oo"), out) if rng.random() < 0.3 else out.replace("0", rng.choice("Oo"), 1).replace("0", rng.choice(("O", "o", "0")), rng.choice((2, 9)))
    return out


def identity(rng: random.Random) -> tuple[str, str]:
    """(what it is called, the number)."""
    sep = rng.choice(("", " ", "-"))
    pair = rng.choice("ABCEGHJKLMNOPQRSTWXYZ") + rng.choice("ABCEGHJKLMNPRSTWXYZQ")
    ni = sep.join((pair, *(_digits(rng, 2) for _ in range(3)), rng.choice("ABCD")))
    return rng.choice(((rng.choice(("NI number ", "national insurance ", "National Insurance no ", "")), cased(rng, ni, 0.7)), (rng.choice(("NI number ", "")), cased(rng, ni, 0.7)), (rng.choice(("NHS no ", "nhs number ", "NHS no ")), f"{_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 4)}"), (rng.choice(("passport ", "passport no ")), _digits(rng, 9))))


def road(rng: random.Random, names: list[str]) -> str:
    word = rng.choice(TREES + names) if rng.random() < 0.7 and names else made_up(rng)
    return f"{word} {rng.choice(ROADS)}"


def address(rng: random.Random, names: list[str]) -> str:
    code = f"{rng.choice('ABDLMNPSTWZQ')}{rng.choice(('', 'B', 'L', 'S', 'X', 'Z'))}{rng.randint(1, 29)} {rng.randint(1, 9)}{''.join(rng.choice('ABDEFGHJLNPQRSTUWXYZ') for _ in range(2))}"
    out = f"{rng.randint(1, 250)}{rng.choice(('', '', '', 'a', 'b', 'c'))} {road(rng, names)}"
    if rng.random() < 0.3:
        out = rng.choice((f"Flat {rng.randint(1, 40)}, ", f"{made_up(rng)} House, ", f"Flat {rng.randint(1, 9)}{rng.choice('abc')}, ")) + out
    if rng.random() < 0.5:
        code = code.replace(" ", "") if rng.random() < 0.2 else code
        out += rng.choice((" ", ", ", f", {made_up(rng)} ", f", {rng.choice(TREES)} {rng.choice(('Vale', 'Moss', 'Green'))} ")) + code
    return cased(rng, out, 0.75)


class Marked:
    """A text that is put together with labels for its parts."""

    def __init__(self) -> None:
        self.text, self.spans = "", []

    def add(self, part: str, kind: str | None = None) -> None:
        if kind:
            self.spans.append((len(self.text), len(self.text) + len(part), crf.LABELS.index(kind)))
        self.text += part


def fill(rng: random.Random, form: str, out: Marked, who: tuple[str, str], names: list[str], x: str = "", x_kind: str | None = None) -> None:
    for piece in re.split(r"(\{\w+\})", form.strip()):
        if not piece.startswith("{"):
            out.add(piece)
        elif piece == "{n}":
            out.add(written(rng, who), "name")
        elif piece == "{t}":
            out.add(cased(rng, f"{rng.choice(TITLES)} {rng.choice((who[1], f'{who[0][0]}. {who[1]}'))}"), "name")
        elif piece == "{e}":
            out.add(email(rng, who), "email")
        elif piece == "{p}":
            out.add(phone(rng), "phone")
        elif piece == "{a}":
            out.add(address(rng, names), "address")
        elif piece == "{i}":
            called, number = identity(rng)
            out.add(called)
            out.add(number, "id_number")
        elif piece == "{x}":
            out.add(x, x_kind)
        elif piece == "{r}":
            out.add(road(rng, names))
        elif piece == "{thing}":
            out.add(rng.choice(THINGS))
        elif piece == "{trade}":
            out.add(rng.choice(TRADES))
        elif piece == "{S2}":
            out.add(made_up(rng))
        elif piece[1] == "N":
            out.add(str(rng.randint(1, 9)) + _digits(rng, int(piece[2]) - 1))
        elif piece[1] == "L":
            out.add(cased(rng, "".join(rng.choice("ABCEGHKLMPQRTXZ") for _ in range(2)), 0.8))
        else:
            out.add(who[piece == "{S}"])


def typo(rng: random.Random, word: str) -> str:
    i = rng.randrange(1, max(2, len(word) - 1))
    return rng.choice((word[:i] + word[i + 1 :], word[:i] + rng.choice("aeinorst") + word[i:], word[:i] + rng.choice("aeinorst") + word[i + 1 :])) if len(word) >= crf.NEAR + 1 else word


def doubtful_pair(rng: random.Random, person_: bool | None = None) -> tuple[tuple[str, str | None], tuple[str, tuple[str, str], bool]]:
    """A mention that by itself may be a person or a place, and a sentence form that tells which."""
    who = person(rng, 0.0)
    person_ = rng.random() < 0.5 if person_ is None else person_
    g, f = who
    near = rng.choice((who, who, (g, typo(rng, f))))
    x = cased(rng, rng.choice((f"{near[0]} {near[1]}", f"{near[0]} {near[1]}", f"{near[1]}, {near[0]}")) if person_ else f"{near[0]} {near[1]}", 0.7)
    return (x, "name" if person_ else None), (rng.choice([c for c in CLEAR if "{n}" in c]) if person_ else rng.choice(PLACE), who, person_)


def open_ended(rng: random.Random, form: str, sentences: list[str], part: float = 0.35) -> str:
    """A form that names a person, in part of the cases with words from elsewhere behind the name, or before one that is
    certain by its title."""
    form = form.strip()
    words = [w for s in sentences for w in s.split() if "{" not in w]
    if "{n}" not in form or len(words) < 8 or rng.random() > part:
        return form
    at = rng.randrange(len(words) - 4)
    some = " ".join(w.rstrip(".,?!") for w in words[at : at + rng.randint(1, 4)])
    some = some[:1].lower() + some[1:]
    if rng.random() < 0.2:
        return f"{some} {{t}} {' '.join(words[at + 4 : at + 8])}"
    head, _, tail = form.partition("{n}")
    return f"{head}{{n}} {some}." if rng.random() < 0.7 or len(tail) < 3 else f"{head}{{n}} {some} {tail.strip()}"


def synthetic(rng: random.Random, backgrounds: list[list[str]], names: list[str], two: float = 0.35) -> tuple[list[str], np.ndarray]:
    """The tokens and labels of a report with sentences put in; backgrounds: [title, sentences...]."""
    title, *rest = rng.choice(backgrounds)
    parts: list[tuple] = [("plain", s) for s in rest]
    who = person(rng)
    head: tuple = ("plain", title)
    for _ in range(rng.choice((0, 1, 2, 3, 3, 4))):
        form = rng.choice(CLEAR if rng.random() < 0.7 else ALIKE)
        if rng.random() < 0.08:
            head = ("form", title + rng.choice((" ", ": ", " - ", " ")) + form.strip()) if "{" not in title else head
        else:
            parts.insert(rng.randint(0, len(parts)), ("form", open_ended(rng, form, rest)))
    if rng.random() < two:
        doubt, tell = doubtful_pair(rng)
        other = ("doubt", rng.choice(DOUBTFUL), *doubt)
        parts.insert(rng.randint(0, len(parts)), ("tell", *tell, doubt[0]))
        if rng.random() < 0.4:
            head = other
        else:
            parts.insert(rng.randint(0, len(parts)), other)
    out = Marked()
    for n, part in enumerate([head, *parts]):
        if n:
            out.add(BREAK if n == 1 else rng.choice((" ", " ", " ", ". ", " - ")) if not out.text.endswith((".", "?", "!")) else " ")
        if part[0] == "plain":
            out.add(part[1])
        elif part[0] == "form":
            fill(rng, part[1], out, who, names)
        elif part[0] == "doubt":
            fill(rng, part[1], out, who, names, part[2], part[3])
        else:
            _, form, own, is_person, x = part
            fill(rng, form, out, own, names, " ".join(own), None)
    return tokens_of(out.text, out.spans)


def tokens_of(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], np.ndarray]:
    tokens = crf.tokenize(text)
    y = np.zeros(len(tokens), dtype=np.int64)
    for a, b, k in spans:
        for i, (x, z, _) in enumerate(tokens):
            if x >= a and z <= b:
                y[i] = k
    return [k for *_, k in tokens], y


_CLUE = re.compile(r"\w@|[(\[]at[)\]]|\d[\d ().-]{7,}|\b(?:mr|mrs|ms|miss|dr)\b|\b\d{1,3}[a-c]? [A-Za-z]+ (?:" + "|".join(ROADS) + r")\b|\b[a-z]{2}[ -]?\d\d[ -]?\d\d", re.I)


def rare_words(texts: list[str], least: int = 4) -> set[str]:
    """Words that are names of some kind, or stand in fewer than `least` texts."""
    from collections import Counter

    documents = [crf.keys(t) for t in texts]
    words = Counter(w for d in documents for w in {k.lstrip().lower() for k in d} if w.isalpha())
    return crf.proper_words(documents, words) | {w for w, n in words.items() if n < least}


def backgrounds_of(texts: list[str], rare: set[str]) -> list[list[str]]:
    """Reports without any clue to personal information, as their title and sentences. Sentences with two rare words side
    by side, which may be anybody's name, are left out."""
    doubt = lambda s: (w := re.findall(r"[^\W\d_]+", s.lower())) and any(len(a) > 1 and len(b) > 1 and a in rare and b in rare for a, b in zip(w, w[1:]))
    out = []
    for t in texts:
        title, _, body = t.partition(BREAK)
        if title and not _CLUE.search(t) and not doubt(title):
            out.append([title, *[s for s in re.split(r"(?<=[.?!]) ", body) if s.strip() and not doubt(s)]])
    return out


def renamed(rng: random.Random, keys: list[str], names: set[str]) -> list[str]:
    """The tokens with every name exchanged for a made-up one, the same for the same."""
    new: dict[str, str] = {}
    out = []
    for k in keys:
        bare = k.lstrip()
        low = bare.lower()
        if low in names:
            word = new.setdefault(low, made_up(rng).split("-")[0])
            k = k[: len(k) - len(bare)] + (word.upper() if bare.isupper() and len(bare) > 1 else word if bare[0].isupper() else word.lower())
        out.append(k)
    return out


def names_in(documents: list[list[str]], labels: list[np.ndarray]) -> set[str]:
    """Words that the field takes for names, and that stand inside of names, mails or look-alikes more than elsewhere."""
    from collections import Counter

    inside, everywhere = Counter(), Counter()
    for d, y in zip(documents, labels):
        everywhere.update(k.lstrip().lower() for k in d)
        inside.update(k.lstrip().lower() for k, v in zip(d, y) if v == crf.LABELS.index("name"))
    usual = {t.lower() for t in TITLES}
    return {w for w, n in inside.items() if w.isalpha() and len(w) > 1 and w not in usual and n >= 0.1 * everywhere[w]}


def report(model: crf.Model, documents: list[list[str]], labels: list[np.ndarray]) -> str:
    got = [g if len(g) else np.zeros(len(y), dtype=np.int64) for g, y in zip(model.label(documents), labels)]
    out = []
    for k, name in enumerate(crf.LABELS[1:], 1):
        out.append(f"{name} {sum((g == k)[y == k].all() and (y == k).any() for g, y in zip(got, labels))}/{sum((y == k).any() for y in labels)} wrong {sum((g == k).any() and not (y == k).any() for g, y in zip(got, labels))}")
    return "; ".join(out)


def without_skips(model: crf.Model) -> crf.Model:
    return crf.Model(model.features, model.weights, model.trans, model.start, np.zeros_like(model.skip), model.common, model.shapes)


def two_mentions(rng: random.Random, backgrounds: list[list[str]], names: list[str], n: int) -> list[tuple[list[str], np.ndarray, bool]]:
    """Documents that name a person (or a place, every other one) twice, once in doubt."""
    out = []
    for i in range(n):
        doubt, (form, who, is_person) = doubtful_pair(rng, i % 2 == 0)
        title, *rest = rng.choice(backgrounds)
        made = Marked()
        if rng.random() < 0.5:
            fill(rng, rng.choice(DOUBTFUL), made, who, names, *doubt)
            made.add(BREAK + " ".join([*rest, ""]))
            fill(rng, form, made, who, names, " ".join(who), None)
        else:
            made.add(title + BREAK)
            fill(rng, form, made, who, names, " ".join(who), None)
            made.add(" " + " ".join([*rest, ""]))
            fill(rng, rng.choice(DOUBTFUL), made, who, names, *doubt)
        out.append((*tokens_of(made.text, made.spans), is_person))
    return out


def skip_figures(model: crf.Model, cases: list[tuple[list[str], np.ndarray, bool]]) -> tuple[float, float]:
    """(part of the persons whose mentions are all found, part of the places where none is)."""
    got = model.label([d for d, _, _ in cases])
    k = crf.LABELS.index("name")
    hit = [len(g) and ((g == k) | (y != k)).all() if is_person else not (len(g) and (g == k).any()) for g, (_, y, is_person) in zip(got, cases)]
    part = lambda v: float(np.mean([h for h, c in zip(hit, cases) if c[2] is v]))
    return part(True), part(False)


def save(model: crf.Model, path: Path) -> None:
    names = [f for f, _ in sorted(model.features.items(), key=lambda x: x[1])]
    np.savez_compressed(path, features=np.array("\n".join(names)), common=np.array("\n".join(sorted(model.common))), weights=model.weights.astype(np.float16), trans=model.trans, start=model.start, skip=model.skip, shapes=model.shapes.astype(np.float16))


def main(path: str, most: int = 15_000, made: int = 11_000, epochs: int = 12) -> None:
    import pyarrow.parquet as pq

    rng = random.Random(11)
    table = pq.read_table(path, columns=["title", "description"]).to_pydict()
    texts = list(dict.fromkeys((a or "") + BREAK + (b or "") for a, b in zip(table["title"], table["description"])))
    rng.shuffle(texts)
    texts = texts[:most]
    held_texts, texts = texts[: most // 6], texts[most // 6 :]
    rare = rare_words(texts)
    plain, held_plain = backgrounds_of(texts, rare), backgrounds_of(held_texts, rare)
    names = sorted({w for b in plain for w in re.findall(r"\b([A-Z][a-z]+) (?:" + "|".join(ROADS) + r")\b", " ".join(b))})
    held = [synthetic(rng, held_plain, names, 0.0) for _ in range(1500)]
    pairs = two_mentions(rng, held_plain, names, 1000)
    second: list[tuple[list[str], np.ndarray]] = []
    for turn in range(2):
        first = [synthetic(rng, plain, names) for _ in range(made)]
        model = crf.train(*map(list, zip(*first, *second)), epochs=epochs)
        docs = [tokens_of(t, [(a, b, crf.LABELS.index(k)) for a, b, k in f]) for t, f in zip(texts, find(model, texts))]
        known, sure = names_in(*map(list, zip(*docs))), model.certainty([d for d, _ in docs])
        second = [(renamed(rng, k, known), y) for (k, y), c in zip(docs, sure) if c > 0.8 and y.any()]
        plain = backgrounds_of([t for t, (_, y), c in zip(texts, docs, sure) if c > 0.95 and not y.any()], rare)
        print(f"turn {turn}: {sum(d[1].any() for d in docs)} reports with findings, {len(second)} of them certain, {len(plain)} surely without, {len(known)} names;", report(model, *map(list, zip(*held))), flush=True)
    print("two mentions: persons, places", skip_figures(model, pairs), "; without skip edges", skip_figures(without_skips(model), pairs))
    print(len(model.features), "features; skip weights", np.round(model.skip, 2).tolist())
    save(model, Path(__file__).with_name("pii_model.npz"))


if __name__ == "__main__":
    main(sys.argv[1])
