"""Problems 6 to 10: against brute force, exact round trips and held-out accuracy, and their edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import crf, offence, pii, plans, string_kernel, truncation
from wayledger.llm.mixing import mix, plan_mix, shares, water_fill
from wayledger.llm.packing import assign, balanced, pack, tightest
from wayledger.llm.tokens import encoding, token_count, VOCABULARY

# ---- 6


def test_endings():
    for text, kind in (("It floods.", "stop"), ("It floods", "word"), ("It floods ", "blank"), ("It flo…", "dots"), ("It ...", "dots"), ("It (", "open"), ('It "', "open"), ("It,", "open"), ("It flo�", "broken"), ("(see photo)", "stop"), ("", "stop"), ("   ", "stop")):
        assert truncation.ending(text)[0] == kind, text


def test_censored_fit_finds_the_distribution():
    rng = np.random.default_rng(1)
    full = np.exp(rng.normal(5.0, 0.5, 20_000)).astype(int) + 1
    cut = np.minimum(full, 200)
    lengths, counts = np.unique(cut, return_counts=True)
    mu, sd = truncation.fit_censored(np.log(lengths), counts.astype(float), lengths == 200)
    assert abs(mu - 5.0) < 0.05 and abs(sd - 0.5) < 0.05
    assert [x[0] for x in truncation.limits(lengths, counts)] == [200] and truncation.limits(lengths, counts)[0][1] > 10
    assert truncation.limits(*np.unique(full, return_counts=True)) == []
    assert truncation.limits(np.array([0, 0]), np.array([5, 5])) == []


def test_cut_texts(spark):
    rng = random.Random(2)
    heads = ["The lamp by the school", "A deep hole near the chapel", "The queue on the main road", "My wheel", "The bin behind the library"]
    ends = ["has been dark all winter", "was reported last year", "reaches the lights", "was damaged yesterday", "smells after each bin day"]
    rows, want = [], set()
    for i in range(3000):
        text = ". ".join(rng.choice(heads) + " " + rng.choice(ends) for _ in range(rng.randint(1, 6))) + rng.choice([".", ".", ".", "", "!"])
        limit = 90 if i % 2 else 10_000
        if len(text) > limit:
            text = text[:limit]
            if text[-1] not in ".!":
                want.add(i)
        elif rng.random() < 0.05:
            text = text[: rng.randint(12, len(text) - 2)]
            if text[-1] not in ".!":
                want.add(i)
        rows.append(("t", i, f"feed{i % 2}", text))
    rows += [("t", -1, "feed0", None), ("t", -2, None, ""), ("t", -3, "feed1", "  "), ("t", -4, "feed0", "x" * 200_000 + "."), ("t", -5, "feed0", "It was (")]
    df = spark.createDataFrame(rows, "src string, row_key long, feed string, text string").withColumns({"kind": F.lit(1), "a": F.lit(2), "len": F.lit(3)})
    cut, lengths = truncation.judged(df)
    got = {r.row_key for r in cut.collect()} - {-5}
    assert lengths.agg(F.sum("n")).first()[0] == len(rows) - 1
    assert len(got & want) > 0.93 * len(want) and len(got - want) < 0.06 * len(want)
    assert {r.feed for r in truncation.cut_rates(cut, lengths).where("rate > 0.2").collect()} == {"feed1"}
    empty, _ = truncation.judged(df.limit(0))
    assert empty.count() == 0


def test_signs_that_close_no_sentence():
    for text, kind in (("Write to me@", "sign"), ("It cost £", "sign"), ("Width =", "sign"), ("See #", "sign"), ("It is <", "sign"), ("Read *", "sign"), ("Done :)", "stop"), ("Up 5%", "stop"), ("<b>Done</b>", "stop"), ("It, ", "open")):
        assert truncation.ending(text)[0] == kind, text


def test_long_words_and_signs_at_a_limit(spark):
    rng = random.Random(6)
    head = "".join(rng.choice("abcdefgh") for _ in range(44))
    one, two = head + "x" * 16, head + "y" * 16
    assert truncation.tokens(f"{one} {two}") == [one, two]
    words = spark.createDataFrame([("p", one, 5), ("p", two, 7), ("q", one, 9), ("p", "lamps", 2)], "a string, b string, n long")
    ends = spark.createDataFrame([("p", head), ("p", one[:50]), ("p", one), ("p", "lamp"), ("p", head[:40])], "a string, b string")
    assert {r.b: r.n for r in truncation._begun(words, ends, ["a"], "n").collect()} == {head: 12, one[:50]: 5, "lamp": 2, head[:40]: 12}
    rows = []
    for i in range(3000):
        text = " ".join(rng.choice(["The lamp is out.", "A hole near the chapel.", "It cost £ 90 to mend the wheel.", "Write to the council."]) for _ in range(rng.randint(1, 12)))[:150]
        rows.append(("t", i, "feed", text))
    want = {r[1] for r in rows if r[3].endswith("£")}
    cut, _ = truncation.judged(spark.createDataFrame(rows, "src string, row_key long, feed string, text string"))
    assert want and want <= {r.row_key for r in cut.collect()}


# ---- 7


def brute_marginals(scores, trans, start, skip, edges):
    t, k = scores.shape
    out, total = np.zeros((t, k)), 0.0
    for y in itertools.product(range(k), repeat=t):
        s = start[y[0]] + sum(scores[i, y[i]] for i in range(t)) + sum(trans[a, b] for a, b in zip(y, y[1:])) + sum(skip[y[a], y[b]] for a, b in edges)
        w = np.exp(s)
        total += w
        for i in range(t):
            out[i, y[i]] += w
    return out / total


def test_marginals_brute_force():
    rng = np.random.default_rng(3)
    k = 3
    scores, trans, start, skip = rng.normal(size=(2, 5, k)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32), np.array([[0.2, -0.3, 0.1], [-0.4, 0.6, 0.0], [0.3, -0.2, 0.9]], dtype=np.float32)
    types, lengths = np.zeros((2, 5), dtype=np.int32), np.array([5, 3])
    plain = crf.marginals(crf.Chains(types, lengths), scores, trans, start, skip)
    for b in range(2):
        assert np.allclose(plain[b, : lengths[b]], brute_marginals(scores[b, : lengths[b]], trans, start, skip, []), atol=1e-4)
    loopy = crf.marginals(crf.Chains(types, lengths, np.array([[0, 0, 4]])), scores, trans, start, skip, rounds=6)
    exact = brute_marginals(scores[0], trans, start, skip, [(0, 4)])
    assert np.abs(loopy[0] - exact).max() < 0.05 and np.abs(loopy[0] - exact).max() < np.abs(plain[0] - exact).max()
    assert np.allclose(loopy[1, :3], plain[1, :3], atol=1e-5)


PII = [
    ("My mobile is 07700 900123. The lamp is out.", {"phone"}),
    ("Please write to jo.bloggs@mail.example.net about the hole.", {"email"}),
    ("The ticket was 01632/703/22 and the asset tag reads 07700-LC-339.", set()),
    ("I was told to quote NI number QQ 12 34 56 C.", {"id_number"}),
    ("The spot is near the chapel, not far from Alder Way.", set()),
    ("I live at Flat 3, 14 Copper Crescent. It floods.", {"address"}),
    ("Regards, Mrs Dallowmere.", {"name"}),
    ("Hetty Wexcombe Primary School is close by.", set()),
    ("The meter reads 724 416 129 255.", set()),
    ("", set()),
]


def test_personal_information(spark):
    rows = [(i, t, None if i % 2 else t) for i, (t, _) in enumerate(PII)] + [(100, None, None), (101, "x " * 100_000, "")]
    df = spark.createDataFrame(rows, "delivery_id long, title string, description string").withColumns({"key": F.lit(1), "kind": F.lit(2)})
    got = {}
    for r in pii.personal_information(df, "delivery_id", ["title", "description"]).collect():
        got.setdefault((r.delivery_id, r.field_name), set()).add(r.kind)
    for i, (t, kinds) in enumerate(PII):
        assert got.get((i, "title"), set()) == kinds, t
        assert got.get((i, "description"), set()) == (set() if i % 2 else kinds)
    clean = {r.delivery_id: r for r in pii.personal_information(df, "delivery_id", ["title", "description"], redacted=True).collect()}
    assert clean[0].title == "My mobile is [PHONE]. The lamp is out." and clean[100].title is None and clean[101].title == "x " * 100_000
    assert "07700" not in clean[0].description and clean[2].title == PII[2][0]
    assert pii.personal_information(df.limit(0), "delivery_id", ["title", "description"]).count() == 0


def test_redaction_keeps_the_rest():
    text = "Ask Kofi Loxdale at a.b@c.example now."
    assert pii.redact(text, [(4, 16, "name"), (20, 33, "email")]) == "Ask [NAME] at [EMAIL] now."
    assert pii.redact(text, []) == text


def _backgrounds():
    return [[f"{a} {b}", f"{c}.", "It has been so for weeks."] for a in ("Pothole", "Broken lamp", "Blocked drain") for b in ("on Mill Lane", "near the shop", "by the bridge") for c in ("The water runs into the cellar", "Cars swerve to avoid it", "Nobody has come yet")]


def test_skip_edges_carry_weight():
    """Persons and places that are named twice, once in doubt, by names that no training has seen: without the skip edges
    far fewer are right."""
    from wayledger.llm import pii_training as t

    model = crf.Model(*pii.load_model())
    cases = t.two_mentions(random.Random(99), _backgrounds(), ["Mill"], 600)
    persons, places = t.skip_figures(model, cases)
    persons0, places0 = t.skip_figures(t.without_skips(model), cases)
    assert persons >= 0.95 and places >= 0.95, (persons, places)
    assert persons0 < persons - 0.1 and places0 < places - 0.2, (persons0, places0)


def test_names_outside_of_training():
    from wayledger.llm import pii_training as t

    rng, found, all_ = random.Random(123), 0, 0
    forms = ["Regards, {n}.", "My name is {n}.", "I spoke to {n} about it.", "Please contact {n}.", "(reported by {n})", "this is {n} from Mill Lane", "The car belongs to {n}."]
    texts = []
    for _ in range(500):
        name = t.written(rng, t.person(rng, 0.0))
        form = rng.choice(forms)
        texts.append("Pothole on Mill Lane" + pii.BREAK + "It floods. " + form.format(n=name) + " Nobody came.")
    got = pii.find(crf.Model(*pii.load_model()), texts)
    assert sum(any(k == "name" for *_, k in f) for f in got) >= 0.95 * len(texts)


def test_links_between_similar_tokens():
    kinds = crf.Kinds()
    words = [" Dravel", " Morthen", " saw", " D", ".", " MORTHEN", " Morthem", " 415", " 415", " it", " it"]
    for w in words:
        kinds.add(w, frozenset({"saw", "it"}))
    c = crf.chains([list(range(len(words)))], kinds)
    edges = {(int(a), int(b)) for _, a, b in c.edges}
    assert {(1, 5), (5, 6), (0, 3), (7, 8)} <= edges and not any({9, 10} & set(e) for e in edges)


# ---- 8


@pytest.mark.parametrize("seed", range(4))
def test_balanced_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes, capacity, n = rng.integers(0, 60, 300), 100, 92
    used = np.bincount(balanced(sizes, capacity, n), weights=sizes)
    cost, room = [0.0] * n, [capacity] * n
    for i in np.argsort(-sizes, kind="stable"):
        fits = [k for k in range(len(cost)) if room[k] >= sizes[i]]
        k = min(fits, key=lambda k: (cost[k], k)) if fits else len(cost)
        if not fits:
            cost.append(0.0)
            room.append(capacity)
        cost[k] += sizes[i] + sizes[i] ** 2 / 2048
        room[k] -= sizes[i]
    assert sorted(capacity - np.array(room)) == sorted(used)


def test_evened_keeps_the_containers_and_lowers_the_cost():
    from wayledger.llm.packing import evened

    rng = np.random.default_rng(5)
    sizes = rng.integers(5, 200, 1500)
    place = tightest(sizes, 512)
    even = evened(sizes, place, 512)
    cost = lambda p: np.bincount(p, weights=sizes + sizes.astype(float) ** 2 / 2048)
    assert even.max() == place.max() and np.bincount(even, weights=sizes).max() <= 512
    assert cost(even).max() <= cost(place).max() and cost(even).std() < 0.6 * cost(place).std()
    assert np.array_equal(evened(sizes[:1], np.zeros(1, dtype=np.int64), 512), [0]) and len(evened(sizes[:0], np.zeros(0, dtype=np.int64), 512)) == 0


@pytest.mark.parametrize("most", [10, 60, 100])
def test_assign_is_tight(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 5, 400):
        sizes = rng.integers(0, most, n, endpoint=True)
        used = np.bincount(assign(sizes, 100), weights=sizes) if n else np.zeros(0)
        assert n == 0 or used.max() <= 100
        assert len(used) <= (len(np.bincount(tightest(sizes, 100))) if n else 0)
        assert most > 10 or len(used) <= max(1, np.ceil(sizes.sum() / 100)) or n == 0


def test_pack_keeps_everything(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, -1, 0, 1, 30, 70, 100, 101, 1000])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumns({"shard": F.lit(1), "container": F.lit(2)})
    kinds = {"a": 100, "b": 37}
    got = pack(df, "doc_id", "tokens", kinds, shard_items=120).toPandas()
    for k, cap in kinds.items():
        own = got[got.container == k]
        assert own.groupby("sequence_id").tokens.sum().max() <= cap
        per = own.groupby("doc_id").tokens.sum()
        assert per.to_dict() == {i: max(0, t or 0) for i, t in rows}
        pieces = own.groupby("doc_id").size()
        assert all(pieces[i] == max(1, -(-max(0, t or 0) // cap)) for i, t in rows)
        assert not own.duplicated(["doc_id", "piece_no"]).any()
    assert pack(df.limit(0), "doc_id", "tokens", kinds).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "tokens", {"x": 0})


def test_tokens(spark):
    texts = ["A deep pothole on Alder Way.", "", None, "<|endoftext|> ąę", "x" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    enc = encoding(VOCABULARY)
    assert [r[0] for r in df.select(token_count("t")).collect()] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


# ---- 9


def test_water_fill():
    t = {"a": (0.5, 1, 100), "b": (0.3, 4, 30), "c": (0.2, 2, 1000), "none": (0.1, 3, 0)}
    exact = water_fill(t)
    total = sum(s.wanted for s in exact.values())
    assert all(abs(exact[k].wanted / total - t[k][0]) < 1e-9 for k in "abc") and exact["none"].wanted == 0
    big = water_fill(t, 1000.0)
    assert big["a"].wanted == 100 and big["b"].wanted == 120 and abs(big["c"].wanted - 780) < 1e-6
    assert sum(s.wanted for s in water_fill(t, 1e9).values()) == 100 + 120 + 2000
    assert water_fill({}) == {} and water_fill({"x": (0.0, 1, 5)})["x"].wanted == 0


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["Big-Source", "big_source ", "small"] if i % 10 else ["small", "untargeted"]), rng.choice([None, 0, 5, 50])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("source", plans.source_key("source")).withColumns({"whole": F.lit(1), "part": F.lit(2)})
    targets = spark.createDataFrame([("big source", 0.4, 1), ("SMALL", 0.6, 3)], "source string, target_share double, max_repeats int")
    plan = plan_mix(docs, targets)
    mixed = mix(docs, plan)
    assert all(p.documents for p in plan.values())
    report = {r.source: r for r in shares(mixed, plan).collect()}
    assert abs(report["big_source"].actual_share - 0.4) < 0.01 and report["small"].most_repeats <= 3 and "untargeted" not in report
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, mixed.collect()), key=repr) == sorted(map(tuple, mix(docs.repartition(7), plan).collect()), key=repr)
    capped = spark.createDataFrame([("big source", 0.2, 2), ("small", 0.8, 1)], "source string, target_share double, max_repeats int")
    clamped = plan_mix(docs, capped, "all")
    assert clamped["small"].wanted == clamped["small"].available and clamped["big_source"].wanted > 0.2 * clamped["small"].available
    assert {r.repeats for r in mix(docs, clamped).where("source = 'small'").collect()} == {1}
    empty = plan_mix(docs.limit(0), targets)
    assert mix(docs.limit(0), empty).count() == 0 and shares(mix(docs.limit(0), empty), empty).count() == 2


# ---- 10


def brute_kernel(a, b):
    def phi(s):
        s, out = s + string_kernel.PAD, {}
        for i in range(len(s) - len(string_kernel.PAD)):
            for offsets, w in string_kernel.SHAPES:
                g = "".join(s[i + o] for o in offsets)
                out[g] = out.get(g, 0.0) + w
        return out

    x, y = phi(a), phi(b)
    return sum(v * y.get(g, 0.0) for g, v in x.items()) / np.sqrt(len(a) * len(b))


def test_kernel_brute_force():
    s = [" you are a moron ", " you are a mo-ron ", " the lamp is out again ", " piss off "]
    got = np.stack([string_kernel.explicit(x) for x in s]) @ np.stack([string_kernel.explicit(x) for x in s], axis=1)
    want = np.array([[brute_kernel(a, b) for b in s] for a in s])
    assert np.allclose(got, want, rtol=0.15, atol=0.15)
    assert got[0, 1] > 3 * got[0, 2]


def test_collapsed_machine_is_the_landmark_machine():
    s = [f" {x.strip()} " for x in offence.ABUSIVE[:10] + offence.HARMLESS[:10]]
    landmarks, root = string_kernel.nystroem(s)
    x = string_kernel.kernel_with(s, landmarks) @ root
    w, b = string_kernel.fit_svm(x, np.r_[np.ones(10), -np.ones(10)], np.ones(20))
    assert np.allclose(string_kernel.collapse(landmarks, root, w, b).scores(s), x @ w + b, atol=1e-2)


def test_sentences_are_put_back():
    assert offence.sentences("Y0u $tup1d m0r0n!! Drop dеad, you B a s t a rds.") == [" you stupid moron ", " drop dead, you bastards "]
    assert offence.sentences("<p>Zażółć &amp; gęś</p>")[0].strip().startswith("zazolc")
    assert offence.sentences("") == [] and all(len(s) < 250 for s in offence.sentences("word " * 5000))


def test_pieces_of_a_long_run_overlap():
    rng = random.Random(4)
    machine = offence.fit([])
    rude = "go to hell you worthless bastards"
    for ahead in range(0, 500, 7):
        run = "the lamp near the chapel is out again and " * 12
        run = run[: run.rfind(" ", 0, ahead + 1) + 1] + rude + " " + run
        assert any(rude in s for s in offence.sentences(run)), ahead
    assert max(machine.scores(offence.sentences(run))) > max(machine.scores(offence.sentences(run.replace(rude, "the sign by the bridge is broken"))))
    for size, words in ((241, 8), (360, 8), (1000, 12), (3000, 300), (5000, 5000)):
        run = "".join(rng.choice("bcdfghjklmnp") + ("aeiou"[k % 5]) for k in range(size))[:size]
        at = 0
        while (at := at + rng.randint(3, words)) < size - 3:
            run = run[:at] + " " + run[at + 1 :]
            at += 1
        pieces = offence.sentences(run)
        assert all(any(run[i : i + offence.STATEMENT].strip() in p for p in pieces) for i in range(size))
        assert all(len(p) <= offence.PIECE + 2 for p in pieces) and len(pieces) <= size / 60 + 1


def test_short_sentences_are_scored(spark):
    assert offence.sentences("Twats! Oh. The lamp is out. 12.") == [" twats ", " oh ", " the lamp is out "]
    rude = ["Twats", "Tossers", "Morons"]
    docs = [(f"The lamp near the {a} is {b}. Thanks.", 0.0) for a in ("chapel", "school", "bridge") for b in ("out", "broken", "bent")] * 5
    machine = offence.fit(docs + [(f"The lamp near the chapel is out. {r}!", 1.0) for r in rude] * 4)
    df = spark.createDataFrame([(1, "Twats!"), (2, "Thanks."), (3, "!!!"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in offence.offence_scores(df, machine).collect()}
    assert got[1] > 0 > got[2] and got[3] == got[4] == -1.0


def test_fit_from_document_labels(spark):
    rng = random.Random(8)
    plain = [f"The {a} near the {b} {c}." for a in ("lamp", "hole", "bin", "sign") for b in ("chapel", "school", "library", "bridge") for c in ("is broken", "was reported", "needs repair", "smells")]
    rude = [f"{a} you {b} {c}." for a in ("Shut up", "Go to hell", "Drop dead") for b in ("stupid", "filthy", "lying") for c in ("morons", "bastards", "cretins", "wankers")]
    docs = []
    for i in range(600):
        bad = rng.random() < 0.25
        text = rng.sample(plain, rng.randint(1, 5)) + ([rng.choice(rude)] if bad else [])
        rng.shuffle(text)
        docs.append((" ".join(text), bad))
    noisy = [(t, float(y != (rng.random() < 0.03))) for t, y in docs[:400]]
    machine = offence.fit(noisy)
    rows = [(i, t) for i, (t, _) in enumerate(docs)] + [(900, None), (901, ""), (902, "Go to hell, you st-upid mo ro ns." + " The lamp is out." * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "score": F.lit(2)})
    got = {r.doc_id: r.score for r in offence.offence_scores(df, machine).collect()}
    held = range(400, 600)
    assert sum((got[i] > 0) == docs[i][1] for i in held) >= 0.95 * len(held)
    assert got[900] == got[901] == -1.0 and len(got) == len(rows)
    assert offence.offence_scores(df.limit(0), machine).count() == 0
    assert offence.fit([]).scores([" you stupid moron ", " the lamp is out "])[0] > 0


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_run(spark, small, name):
    df = plans.QUERIES[name](spark, small)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    assert rows or name == "p10_found"
