import numpy as np
import pytest

from weftwork.llm import pii, pii_forms, tagger

GIVEN = ["Anna", "Otto", "Rosa"]


#: Sentences of these tests; the last of each kind are held out of training.
CARRIERS = {
    "email": ("Please write to {} soon.", "The invoice went to {} on Monday.", "You find us under {} all day."),
    "phone": ("Please call {} after lunch.", "The driver rang {} twice.", "Nobody picks up at {} any more."),
    "id_number": ("The passport {} was shown.", "They noted {} at the desk.", "We wrote down {} in the file."),
    "address": ("Bring it to {} tomorrow.", "The van stopped at {} again.", "The shop moved to {} in May."),
    "name": ("We spoke to {} about it.", "The coat belongs to {} now.", "Yesterday {} came back."),
}


def labelled(text, given=()):
    return pii_forms.label([text], frozenset(x.lower() for x in given))[0][0]


def carried(maker, kinds=tagger.KINDS, which=(0, 1), head="The hem is sewn twice. "):
    """A text with one invented value of each of two kinds, and its spans."""
    text, spans = head, []
    for kind in maker.r.choices(kinds, k=2):
        before, after = CARRIERS[kind][maker.r.choice(which)].split("{}")
        value = maker.value(kind)
        spans.append((len(text) + len(before), len(text) + len(before) + len(value), kind))
        text += before + value + after + " It fits well and lasts. "
    return text, spans


def test_gradients_are_right():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in tagger.fresh(3, 1).items()}
    codes, flags = r.integers(1, 90, (6, 2)), r.integers(0, 3, (6, 2))
    gold = np.zeros((6, 2), int)
    gold[2, 0], gold[3, 0], gold[1, 1] = 1, 2, 9
    mask = (np.arange(6)[:, None] < np.array([6, 4])[None]).astype(float)
    _, g = tagger.gradients(codes, flags, gold, mask, w)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({a: b.copy() for a, b in w.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        slope = (tagger.gradients(codes, flags, gold, mask, up)[0] - tagger.gradients(codes, flags, gold, mask, down)[0]) / 2e-2
        assert g[k][at] == pytest.approx(slope, rel=2e-2, abs=1e-4)


def test_decoding_beats_every_other_path():
    r = np.random.default_rng(2)
    w = tagger.fresh(2, 0)
    w["move"] = r.standard_normal(w["move"].shape).astype(np.float32)
    scores = r.standard_normal((3, 4, tagger.K)).astype(np.float32)
    lengths = np.array([3, 2, 1, 3])
    tags = tagger.viterbi(scores, lengths, w)
    move = w["move"] + tagger.FORBIDDEN
    for b, n in enumerate(lengths):
        value = lambda path: tagger.START[path[0]] + scores[0, b, path[0]] + sum(move[p, q] + scores[t, b, q] for t, (p, q) in enumerate(zip(path, path[1:]), 1))  # noqa: E731, B023
        best = max(np.ndindex(*[tagger.K] * n), key=value)
        assert value(tuple(tags[:n, b])) == pytest.approx(value(best), abs=1e-4) and not tags[n:, b].any()


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("Write to anna.berg [at] mail [dot] example.", "email", "anna.berg [at] mail [dot] example"),
        ("mailto:x+y@shop.test,", "email", "x+y@shop.test"),
        ("Call (212) 555-0142 ext. 12", "phone", "(212) 555-0142"),
        ("Tel. +44 (0)7700 900123.", "phone", "+44 (0)7700 900123"),
        ("abends 030/23125717 anrufen", "phone", "030/23125717"),
        ("SSN 000-12-3456.", "id_number", "000-12-3456"),
        ("DNI 00.247.983-V;", "id_number", "00.247.983-V"),
        ("pick-up from 57 Merozen Drive, Apt 4A, Townstad", "address", "57 Merozen Drive, Apt 4A"),
        ("vivo en Calle Mayor 18, 2º C, 96882 Villa", "address", "Calle Mayor 18, 2º C"),
        ("ich wohne Elwailtastraße 135a.", "address", "Elwailtastraße 135a"),
        ("déposé 12 bis, avenue de Lumes à Ville", "address", "12 bis, avenue de Lumes"),
        ("We saw Berg, Anna this morning.", "name", "Berg, Anna"),
        ("A parcel for Mr O. Ostberg", "name", "O. Ostberg"),
        ("Regards, Rosa Lind\n", "name", "Rosa Lind"),
    ],
)
def test_labels(text, kind, found):
    spans = labelled(text, GIVEN)
    assert [(k, text[a:b]) for a, b, k in spans] == [(kind, found)]


@pytest.mark.parametrize("text", ["lot 807 317 49", "EAN 2993382659357", "Order 876-5391003,", "3 for 2 @ 58.99", "95 g per square metre", "Amber Lane collection", "12-04-2024", "ref. 46214064"])
def test_look_alikes_are_not_labelled(text):
    assert labelled(text) == []


def test_replaced_values_keep_their_spans():
    maker = pii_forms.Maker(3, GIVEN)
    spans = [(8, 22, "email"), (38, 47, "name")]
    for _ in range(50):
        text, found = maker.replaced("One is: anna@x.example, of the lady Anna Berg.", [(8, 22, "email"), (36, 45, "name")], share=0.5)
        assert [k for _, _, k in found] == [k for _, _, k in spans] and all(text[a:b].strip() == text[a:b] for a, b, _ in found)
        assert "@" in text or " at " in text.lower() or "at)" in text.lower() or "at]" in text.lower()


def test_contexts_and_fixed_phrases_are_learned_from_the_texts():
    named = [f"The parcel is for {n}, not for me." for n in ("Anna Berg", "Otto Lind", "Rosa Vane", "Hazel Quist", "Uwe Morn")]
    phrase = [f"Rosa Gold trim, {n} buttons." for n in (3, 4, 5)]
    alone = ["The gold is new.", "A gold hem."]
    other = [f"Our {b} range is new." for b in ("Velmor", "Tandil", "Quessa", "Brilo")]
    texts = named + phrase + other + alone
    spans = [[(t[a:b], k) for a, b, k in s] for t, (s, _) in zip(texts, pii_forms.label(texts, frozenset({"anna", "otto", "rosa"})))]
    assert [s[0][0] for s in spans[:5]] == ["Anna Berg", "Otto Lind", "Rosa Vane", "Hazel Quist", "Uwe Morn"]
    assert not any(spans[5:])


def test_settling():
    text = "Call <+1 212 555 0142>, or a@b.example\na@b.example."
    got = pii.settle(text, [(5, 22, "phone"), (27, 50, "email"), (0, 4, "name")])
    assert [(k, text[a:b]) for a, b, k in got] == [("phone", "+1 212 555 0142"), ("email", "a@b.example"), ("email", "a@b.example")]


def documents(spark):
    """Texts to train on, and others whose sentences were held out."""
    maker = pii_forms.Maker(11, GIVEN)
    rows, truth, held, held_truth = [], set(), [], set()
    for k in range(200):
        text, spans = carried(maker)
        rows.append((k, text, "x"))
        truth |= {(k, kind, text[a:b]) for a, b, kind in spans}
        text, spans = carried(maker, which=(2,))
        held.append((k, text, "x"))
        held_truth |= {(k, kind, text[a:b]) for a, b, kind in spans}
    rows += [(1000, None, ""), (1001, "", ""), (1002, " \n", ""), (None, "anna@x.example", ""), rows[3]]
    kinds = "doc_id long, text string, kind string"
    return spark.createDataFrame(rows, kinds), truth, spark.createDataFrame(held, kinds), held_truth


def test_trained_tagger_finds_and_replaces(spark, monkeypatch):
    df, truth, held, held_truth = documents(spark)
    options = dict(sample=200, made=3_000, hidden=24, shards=2, rounds=9, passes=1.5)
    weights = pii.fit(df, "doc_id", "text", GIVEN, **options)
    monkeypatch.setattr(tagger, "train", None)  # the stored model is read back
    assert pii.fit(df, "doc_id", "text", GIVEN, **options) == weights
    beyond = {tuple(r) for r in pii.pieces(pii.find(held, "doc_id", "text", weights, GIVEN), "doc_id").collect()}
    assert len(beyond & held_truth) / len(held_truth) > 0.6 and len(beyond & held_truth) / len(beyond) > 0.6
    found = pii.find(df, "doc_id", "text", weights, GIVEN)
    got = {tuple(r) for r in pii.pieces(found, "doc_id").collect()}
    assert len(got & truth) / len(truth) > 0.6 and len(got & truth) / len(got) > 0.6
    replaced = {r.doc_id: r.text for r in pii.replaced(found, "doc_id").collect()}
    assert len(replaced) == 203 and replaced[1000] is None and replaced[1001] == ""
    for r in found.where("doc_id = 5" if "doc_id" in found.columns else "id = 5").collect():
        assert all(s.found not in replaced[5] for s in r.spans)
    # A long text, cut into segments, gives what its parts give.
    w = tagger.unpack(weights)
    listed = frozenset(x.lower() for x in GIVEN)
    line = "Call me on (212) 555-0142. The hem is sewn twice and lasts for years. "
    whole = pii.spans_of([line * 40], w, listed)[0]
    monkeypatch.setattr(pii, "SEGMENT", 500)
    assert pii.spans_of([line * 40], w, listed)[0] == whole
    assert pii.spans_of([None, "", "x"], w, listed) == [[], [], []]


def test_windows_of_nothing():
    codes, flags, tags, lengths = pii.windows([], frozenset(), GIVEN, 50, 1)
    assert len(codes) == len(lengths) > 0 and tags.any()


def test_given_names(spark):
    df = spark.createDataFrame([("Otto",), (None,), ("Otto",)], "given_name string")
    assert pii.given_names(df) == ["Otto"]
    with pytest.raises(ValueError):
        pii.given_names(df, most=0)


def test_a_name_in_a_third_of_the_texts_is_found_and_a_hot_text_is_read_once(spark, monkeypatch):
    monkeypatch.setattr("weftwork.operators.skew.PIECE", 20)
    maker = pii_forms.Maker(12, GIVEN)
    rows = [(k, carried(maker, head="We spoke to Anna Ostberg about it. " if k % 3 == 0 else "The seam holds. ")[0]) for k in range(150)]
    rows += [(200 + k, "The coat belongs to Otto Ravley now. It fits well.") for k in range(75)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = pii.fit(df, "doc_id", "text", GIVEN, sample=200, made=3_000, hidden=24, shards=2, rounds=9, passes=1.5)
    got = {tuple(r) for r in pii.pieces(pii.find(df, "doc_id", "text", weights, GIVEN), "doc_id").collect()}
    assert sum((k, "name", "Anna Ostberg") in got for k in range(0, 150, 3)) > 40
    assert sum((200 + k, "name", "Otto Ravley") in got for k in range(75)) == 75


@pytest.mark.parametrize("text", ["mi móvil es 555000929.", "Tel.: 555025449 - Solicita cambio.", "Llámeme al 555067130.", "Teléfono de contacto 555036859 (tardes)"])
def test_nine_bare_digits_are_a_phone(text):
    number = "".join(c for c in text if c.isdigit())
    at = text.index(number)
    assert pii.settle(text, [(at, at + 9, "phone")]) == [(at, at + 9, "phone")] == pii.settle(text, [(at - 1, at + 8, "phone")])
    assert labelled(text) == [(at, at + 9, "phone")]


@pytest.mark.parametrize("text", ["Serial 555000929", "ref. 555000929.", "lot 555000929", "555000929 pieces", "Tel. lot 5550009291234"])
def test_nine_bare_digits_without_cue_are_not_labelled(text):
    assert labelled(text) == []


def test_nine_bare_digits_are_made():
    maker = pii_forms.Maker(4, GIVEN)
    assert any(len(p) == 9 and p.isdigit() for p in (maker.phone() for _ in range(300)))


@pytest.mark.parametrize("name", ["María de la Cruz", "Ludwig van Beethoven", "de la Cruz, María", "Anna von der Berg", "María del Carmen de la Cruz", "anna di rosa", "Otto Berg"])
def test_names_with_particles_are_kept(name):
    text = f"Spoke with {name} yesterday."
    assert pii.settle(text, [(11, 11 + len(name), "name")]) == [(11, 11 + len(name), "name")]


@pytest.mark.parametrize("name", ["Berg de la", "Tasche der Jacke", "Anna likes Berg", "de la Cruz"])
def test_particles_alone_make_no_name(name):
    assert pii.settle(f"Spoke with {name} yesterday.", [(11, 11 + len(name), "name")]) == []


@pytest.mark.parametrize("name", ["Anna de la Cruz", "Otto von Berg", "van der Berg, Anna"])
def test_names_with_particles_are_labelled(name):
    text = f"We spoke with {name} this morning."
    assert [text[a:b] for a, b, _ in labelled(text, GIVEN)] == [name]


@pytest.mark.parametrize(
    "text, span, kind, want",
    [
        ("see de Anna Berg here", (4, 16), "name", ["Anna Berg"]),
        ("to JONAH ARSEN at", (0, 14), "name", ["JONAH ARSEN"]),
        ("A Jean Maria del Mar de la Cruz Lopez Garcia Fernandez wrote", (2, 54), "name", ["Jean Maria del Mar de la Cruz Lopez Garcia Fernandez"]),
        ("no form: 12.34-56 78 90.", (9, 24), "phone", ["12.34-56 78 90"]),
        ("house 7 of the old harbour", (0, 26), "address", ["house 7 of the old harbour"]),
        ("212-555-0173 212-555-0173", (0, 25), "phone", ["212-555-0173", "212-555-0173"]),
        ("trim. @paselv", (0, 13), "email", []),
        ("only 123", (0, 8), "phone", []),
    ],
)
def test_forms_trim_and_spans_without_one_stay(text, span, kind, want):
    assert [text[a:b] for a, b, _ in pii.settle(text, [(*span, kind)])] == want
