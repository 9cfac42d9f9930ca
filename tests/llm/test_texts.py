import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectrail.llm import leakage, queries, subjects, tokens
from vectrail.llm.text import clean, sentences, words

needs_vocabulary = pytest.mark.skipif(not os.path.exists(queries.VOCABULARY), reason="the public vocabulary is not here")


# Text


@pytest.mark.parametrize(
    "text, want",
    [("<b>Race</b> cond-\nition", ["race", "condition"]), ("> quoted\n> line[12] x", ["quoted", "line", "x"]), ("nächste nächste NÄCHSTE", ["nachste"] * 3),
     ("RÃ¼ckfall", ["ruckfall"]), ("it&#39;s a b​c", ["it", "s", "a", "bc"]), ("ﬁne Ａ", ["fine", "a"]), ("", []), (" \n", []), ("x < y > z", ["x", "y", "z"])],
)
def test_words(text, want):
    assert words(text) == want


def test_sentences():
    assert len(sentences("One. Two? Three!\n\n- four\n- five 0.5 and\nwrapped")) == 5
    assert clean("a\x00b") == "a\x00b" and sentences("") == []


# Token ids


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(queries.VOCABULARY)


@pytest.fixture(scope="module")
def encoder(ranks):
    return tokens.Encoder(tokens.sentencepiece_model(ranks))


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_vocabularys(encoder, ranks, text):
    import tiktoken

    got = encoder.encode_batch([text])[0]
    assert got == tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    assert encoder.decode(got) == text


@needs_vocabulary
def test_ids_of_odd_texts(encoder, spark):
    long = "word " * 20000 + "a" * 30000
    assert encoder.decode(encoder.encode_batch([long])[0]) == long
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, "<|endoftext|> hi", "x", 0), (3, "<|endoftext|> hi", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, ids int")
    got = tokens.encode_texts(df, "doc_id", "text", queries.VOCABULARY).collect()
    assert sorted((r.doc_id, len(r.ids) > 0) for r in got) == [(1, False), (2, False), (3, True), (3, True)]
    assert all(i != 50256 for r in got for i in r.ids)
    assert tokens.encode_texts(df.limit(0), "doc_id", "text", queries.VOCABULARY).count() == 0


def test_model_needs_whole_ranks():
    with pytest.raises(ValueError):
        tokens.sentencepiece_model({b"a": 0})


# Leaks

ITEM = (
    "Suppose Golazo-18 blurred its mast cell after 221 days; which uneven complement cascade would a rotating annexe report once antigen "
    "receptor number 710 replaced the pilot archive with four spare entries and nobody had written down why the second reading failed"
)


def damaged(text, every, seed=0):
    r = random.Random(seed)
    out = text.split()
    for i in range(every - 1, len(out), every):
        out[i] = r.choice(["certain", "roughly"])
    return " ".join(out)


def found(doc, item=ITEM):
    return leakage.compare(leakage.pack(doc), leakage.pack(item))


def test_whole_and_partial_passages():
    assert found(f"Before. {ITEM} After.") == len(ITEM.split())
    w = ITEM.split()
    assert found("x y " + " ".join(w[5:20]) + " z") == 15
    assert found("x y " + " ".join(w[5:17]) + " z") == 0
    assert found(" ".join(w[5:22]).upper().replace(" ", " ")) == 17


def test_changes_up_to_one_in_eight():
    assert found(damaged(ITEM, 8)) >= 30 and found(damaged(ITEM, 4)) == 0
    w = ITEM.split()
    dropped = [x for i, x in enumerate(w) if i % 9 != 4]
    added = [y for i, x in enumerate(w) for y in ([x, "more"] if i % 9 == 4 else [x])]
    assert found(" ".join(dropped)) >= 30 and found(" ".join(added)) >= 30
    one = w[6:21]
    one[7] = "other"
    assert found("q " + " ".join(one) + " q") == 15


def test_reordered_parts_count():
    w = ITEM.split()
    assert found(" ".join(w[20:] + w[:20])) >= 18


def test_parts_in_another_order_are_caught_by_coverage():
    w = ITEM.split()
    parts = [w[k : k + 9] for k in range(0, len(w), 9)]
    mixed = " and then ".join(" ".join(p) for p in parts[::-1])
    assert found(mixed) >= 30 and leakage.leaks(leakage.Text.of(mixed), leakage.Text.of(ITEM))[0] == 0
    assert found(" and then ".join(" ".join(p) for p in parts[:2][::-1])) == 0


def test_a_hyphenated_word_is_one_word():
    w = ITEM.split()[1:17]
    assert "Golazo-18" in w
    w[0], w[9] = "Other-99", "else"
    assert found("a b " + " ".join(w) + " c d") == 15 or found("a b " + " ".join(w) + " c d") == 16
    one = "The off-target mast-cell reading of the mid-size archive came back with spare entries in the log-book again"
    assert found(one.replace("mast-cell", "other-one"), one) == len(one.split())


def test_runs_a_stretch_keeps():
    assert leakage.shared_runs(15, 8) == 5 and leakage.shared_runs(15, 7.5) == 4 and leakage.shared_runs(20, 10) == 9
    with pytest.raises(ValueError):
        leakage.shared_runs(15, 4)
    r = random.Random(3)
    for least, rate in ((15, 7.5), (20, 10), (30, 8)):
        need = leakage.shared_runs(least, rate)
        for _ in range(300):
            n = r.randrange(least, 3 * least)
            hit = set(r.sample(range(n), int(n / rate)))
            assert sum(not hit & set(range(k, k + leakage.SEED)) for k in range(n - leakage.SEED + 1)) >= need


def test_recall_of_damaged_stretches():
    """No stretch of the least length with as many changes as allowed is lost, wherever they are; none with many more is taken."""
    r = random.Random(11)
    words_ = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    lost = wrong = 0
    for n in (15, 16, 22, 30, 45):
        for _ in range(60):
            item = r.sample(words_, 60)
            at = r.randrange(60 - n)
            part = item[at : at + n]
            for k in r.sample(range(1, n - 1), int(n / 8)):
                part[k] = "zz" + part[k]
            lost += not found(" ".join(["q"] * 5 + part + ["q"] * 5), " ".join(item))
            bad = item[at : at + n]
            for k in range(2, n, 4):
                bad[k] = "zz"
            wrong += found(" ".join(["q"] * 5 + bad + ["q"] * 5), " ".join(item)) > 0
    print(lost, wrong)
    assert lost == 0 and wrong == 0


def test_typography_is_no_change():
    text = "> " + ITEM.replace("complement", "comple-\nment").replace(" ", "  ").replace("annexe", "<i>annexe</i>[3]").replace("-18", "‑18")
    assert found(text) == len(ITEM.split())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
def test_tiles_match_and_never_overlap(doc, item):
    seen_d, seen_i = set(), set()
    for i, j, n in leakage.tiles(doc, item, 2):
        assert n >= 2 and doc[i : i + n] == item[j : j + n]
        d, t = set(range(i, i + n)), set(range(j, j + n))
        assert not d & seen_d and not t & seen_i
        seen_d |= d
        seen_i |= t
    longest = max((n for i in range(len(doc)) for j in range(len(item)) for n in range(1, 26) if doc[i : i + n] == item[j : j + n] and i + n <= len(doc) and j + n <= len(item)), default=0)
    assert max((n for _, _, n in leakage.tiles(doc, item, 2)), default=0) == (longest if longest >= 2 else 0)


def test_find_leaks(spark):
    docs = [(1, ITEM, "a", 0), (2, ITEM, "b", 0), (3, None, "c", 0), (4, "", "d", 0), (5, "nothing here", "e", 0), (6, "pad " * 20000 + ITEM, "f", 0)]
    items = [(7, ITEM, "x"), (8, ITEM, "y"), (9, None, "z"), (10, "too short", "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string, k string, i int")
    i = spark.createDataFrame(items, "item_id long, text string, t string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {(a, b) for a in (1, 2, 6) for b in (7, 8)}
    assert leakage.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


# Subjects

TERMS = {"genomics": ["read depth", "guide library", "promoter region", "exon junction"], "software": ["memory leak", "unit test", "release branch", "thread pool"], "oncology": ["tumour margin", "driver mutation", "biopsy core", "grade shift"]}


def corpus(n=400, seed=3):
    r = random.Random(seed)
    frames = ["We could not explain why the {} moved while the {} stayed flat.", "Can the {} be shown without the {}?", "Each {} is listed with one {}.", "Nobody had documented the {}, so the {} was rebuilt."]
    filler = ["The minutes were approved without changes.", "See ticket 8 for the history.", "More on this in the next note."]
    docs, truth = [], {}
    for d in range(n):
        about = r.sample(sorted(TERMS), r.choice([0, 1, 1, 2]))
        passing = r.choice([s for s in TERMS if s not in about])
        lines = [r.choice(frames).format(*r.sample(TERMS[s], 2)) for s in about for _ in range(r.randint(3, 5))]
        lines += [r.choice(filler) for _ in range(3)] + [r.choice(frames).format(*r.sample(TERMS[passing], 2))] * (r.random() < 0.5)
        r.shuffle(lines)
        text = " ".join(lines)
        docs.append((d, text.upper() if d % 9 == 0 else text, "en", 0))
        truth[d] = set(about)
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    docs, truth = corpus()
    labels = [(d, s.title(), "r") for d in range(200) for s in truth[d]] + [(0, "Unknown area", "r"), (99999, "software", "r"), (None, "software", "r")]
    labels += labels[:20]
    d = spark.createDataFrame(docs + [(1000, None, "en", 0), (1001, "", "en", 0), (1002, "x " * 50000, "en", 0)], "doc_id long, text string, id string, terms int")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, b string")
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, "doc_id", "text", lab, sorted(TERMS)).collect()}
    want = {(k, s) for k, v in truth.items() for s in v}
    held = lambda x: {p for p in x if p[0] >= 200}
    assert len(held(got) & held(want)) / len(held(want)) > 0.97 and len(held(got) - held(want)) / len(held(got)) < 0.03
    assert not {k for k, _ in got} & {1000, 1001, 1002}


def test_subjects_without_labels_or_documents(spark):
    d = spark.createDataFrame(corpus(5)[0], "doc_id long, text string, id string, terms int")
    lab = spark.createDataFrame([], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, "doc_id", "text", lab, sorted(TERMS)).collect()}
    assert got and got <= {(k, s) for k, v in corpus(5)[1].items() for s in v}  # by the curated terms alone
    assert subjects.assign(d, "doc_id", "text", lab, ["cookery"]).count() == 0
    some = spark.createDataFrame([(1, "software")], "doc_id long, subject string")
    assert subjects.assign(d.limit(0), "doc_id", "text", some, sorted(TERMS)).count() == 0


def test_labels_speak_against_a_curated_term(spark):
    docs = [(i, ". ".join(["The tumour of the day"] * 4 if i % 2 else ["A plain word here"] * 4), "", 0) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string, id string, terms int")
    lab = spark.createDataFrame([(i, "software" if i % 2 else "oncology") for i in range(60)], "doc_id long, subject string")
    names = ["oncology", "software"]
    assert {r.subject for r in subjects.assign(d, "doc_id", "text", lab, names).where("doc_id % 2 = 1").collect()} == {"software"}


def test_beginnings_of_words():
    a = subjects.automaton(["immun*", "immune", "t cell*"])
    assert subjects.find(a, "immunity immune t cellular immun".split()) == [0, 1, 2, 0]


def test_longest_match_wins_and_neighbours_count():
    a = subjects.automaton(["cell", "t cell clone", "cell clone"])
    assert subjects.find(a, "the t cell clone cell".split()) == [1, 0]
    assert subjects.find(subjects.automaton([]), ["x"]) == []
