import random

import pytest

from brindle.llm.pii import SemiMarkov, candidates, find_personal_data, fit_finder, redact

GIVEN = "Mirelda Tobrik Selvina Karvo Jorrent Elbrina Vashiko Drenna Polvik Rishenda".split()
FAMILY = "Hargovik Stenholt Bramvessel Okterlund Fjelgard Munzarek Tarvolen Wexholm Garden Quillick".split()


def sentence(r):
    """(text before, span, kind, text after), or a decoy."""
    given, family = r.choice(GIVEN), r.choice(FAMILY)
    name = r.choice([f"{given} {family}", f"{family}, {given}", f"{given} {r.choice('ABC')}. {family}", f"{given[0]}. {family}"])
    return r.choice([
        ("My name is ", name, "name", " and I wait."), ("Mr ", name, "name", " asked for a copy."),
        ("Write to ", f"{given.lower()}.{family.lower()}@mail.example.org", "email", " if it fails."), ("Write to ", f"{given.lower()} (at) example (dot) org", "email", " please."),
        ("Call ", r.choice(["+49 30 23125 313", "(212) 555-0148", "0199 005630", "+1 212 555 0157", "212.555.0144"]), "phone", " after six, please."),
        ("The passport on file is ", r.choice(["XQ1016648", "967-47-8921", "QQ 02 31 54 C", "248.998.494-00"]), "id_number", ", it says."),
        ("I live at ", r.choice(["16 Copper Road", "Lindenstraße 24", "Calle del Molino 31", "262, rue des Glycines", "Am Teich 5"]), "address", ", near the garden."),
        ("The garden has a gate and the job ran at 2024-03-11 08:15:30 on port 8080.", "", None, ""), ("Ticket IDX-4547 and order 4471-22861 at 192.0.2.44 cost 1 250 000 units.", "", None, ""), ("Please read the garden notes and call the gate twice.", "", None, ""),
    ])


def corpus(n, seed):
    r = random.Random(seed)
    rows, truth = [], set()
    for k in range(n):
        text = ""
        for _ in range(r.randrange(1, 4)):
            a, span, kind, b = sentence(r)
            text += (" " if text else "") + a
            if kind:
                truth.add((f"m{k}", kind, len(text), len(text) + len(span)))
            text += span + b
        rows.append((f"m{k}", text))
    return rows, truth


@pytest.fixture(scope="module")
def finder(spark):
    rows, _ = corpus(600, 1)
    known = [(n, "given") for n in GIVEN[:7]] + [(n, "family") for n in FAMILY[:9]]
    return fit_finder(spark.createDataFrame(rows, "id string, text string").select("text"), spark.createDataFrame(known, "name string, kind string"))


def test_held_out_texts(spark, finder):
    rows, truth = corpus(400, 2)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "id string, text string, kind string")
    found = {tuple(r) for r in find_personal_data(df, "id", "text", *finder).collect()}
    right = len(found & truth)
    assert right / len(found) > 0.95 and right / len(truth) > 0.9


def test_marginals_and_decoding_agree_with_all_segmentations(finder):
    lexicon, model = finder
    text = "Mr Hargovik, Mirelda B. Stenholt lives at 16 Copper Road, call 0199 005630"
    cs = candidates(text, lexicon)
    assert len(cs) >= 4
    import itertools
    import math

    sets = []
    for n in range(len(cs) + 1):
        for pick in itertools.combinations(range(len(cs)), n):
            spans = sorted((cs[k].start, cs[k].end) for k in pick)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                sets.append((sum(model.score(cs[k]) for k in pick), pick))
    best = max(sets)[0]
    assert sum(model.score(c) for c in model.decode(cs)) == pytest.approx(best)
    free = SemiMarkov({k: v / 10 for k, v in model.weights.items()})
    scored = [(sum(free.score(cs[k]) for k in pick), pick) for _, pick in sets]
    whole = sum(math.exp(s) for s, _ in scored)
    for k, p in enumerate(free.marginals(cs)):
        assert p == pytest.approx(sum(math.exp(s) for s, pick in scored if k in pick) / whole)


def test_rows_and_redaction(spark, finder):
    long = "The gate is read. " * 4000 + "Write to a.b@example.org now."
    df = spark.createDataFrame([("1", None), ("2", ""), ("3", "Mr Tobrik Stenholt asked."), ("3", "Mr Tobrik Stenholt asked."), (None, "call 0199 005630"), ("4", long), ("5", "no data 世界")], "id string, text string")
    found = {tuple(r) for r in find_personal_data(df, "id", "text", *finder).collect()}
    assert found == {("3", "name", 3, 18), (None, "phone", 5, 16), ("4", "email", long.index("a.b@"), long.index(" now."))}
    out = [r.text for r in redact(df, "text", *finder).collect()]
    assert out[:3] == [None, "", "Mr [NAME] asked."] and out[4] == "call [PHONE]" and out[5].endswith("Write to [EMAIL] now.") and out[6] == "no data 世界"
    assert find_personal_data(df.limit(0), "id", "text", *finder).count() == 0


def test_fit_on_nothing(spark):
    lexicon, model = fit_finder(spark.createDataFrame([], "text string"), spark.createDataFrame([], "name string, kind string"))
    assert model.decode(candidates("call 0199 005630", lexicon)) is not None


def test_words_are_counted_in_all_texts(spark):
    rows = [(f"The gate of Mirelda number {k} is read.",) for k in range(200)]
    rows += [("x " * 10_500 + "zorvane and mirelda",)] * 3 + [("Zorvane",), ("mirelda",), (None,), ("",)]
    known = spark.createDataFrame([("Mirelda", "given"), ("Zorvane", "family")], "name string, kind string")
    lexicon, _ = fit_finder(spark.createDataFrame(rows, "text string"), known, sample=2)
    assert "gate" in lexicon.words and lexicon.odds("gate") == -3.0
    # three whole texts have it in small letters, one otherwise; the other name is written with a capital more often
    assert lexicon.ordinary == {"zorvane"} and lexicon.odds("mirelda") == 3.0
    small, _ = fit_finder(spark.createDataFrame(rows, "text string").repartition(7), known, sample=200)
    assert (small.words.hashes == lexicon.words.hashes).all() and small.weights == lexicon.weights
