import itertools
import random

import numpy as np
import zlib

from faultline.llm import langid

from .conftest import awkward_rows

SOUNDS = {"en": ["the", "and", "ing", "th", "er", "wh"], "de": ["sch", "ung", "ich", "ei", "ß", "ür"], "fr": ["eau", "oi", "que", "é", "ç", "eux"]}


def text(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def model():
    pairs = [(text(c, s), c) for c in SOUNDS for s in range(25)]
    return langid.fit([t for t, _ in pairs], [c for _, c in pairs])


def brute_posteriors(scores, moves):
    t, n = scores.shape
    p = np.zeros((t, n))
    for path in itertools.product(range(n), repeat=t):
        w, before = 1.0, np.full(n, 1 / n)
        for i, c in enumerate(path):
            w *= (before @ moves)[c] if i == 0 else moves[path[i - 1], c]
            w *= np.exp(scores[i, c])
        for i, c in enumerate(path):
            p[i, c] += w
    return p / p.sum(1, keepdims=True)


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    moves = np.exp(rng.normal(size=(3, 3))).astype(np.float32)
    sizes = np.array([1, 0, 5, 7, 2, 8])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    parts = np.split(scores, np.cumsum(sizes)[:-1])
    want = np.concatenate([brute_posteriors(s, moves) for s in parts if len(s)])
    for step in (32, 3, 1):  # texts within one block and over many
        monkeypatch.setattr(langid, "STEP", step)
        assert np.allclose(langid.posteriors(scores, sizes, moves), want, atol=1e-4)


def test_words_of_code_switched_text():
    lab = langid.Labeller(model())
    mixed = text("de", 900, 30) + " " + text("fr", 901, 30) + " " + text("en", 902, 30)
    p = lab.words([mixed])[0]
    best = [lab.model.languages[i] for i in p.argmax(1)]
    truth = ["de"] * 30 + ["fr"] * 30 + ["en"] * 30
    assert sum(a == b for a, b in zip(best, truth)) >= 85
    assert (np.diag(lab.model.moves) > 1).all()  # staying in a language is learned


def test_no_letters_is_undetermined():
    lab = langid.Labeller(model())
    assert [x[0] for x in lab.documents(["", "123 ?! ²½", "the"])] == ["und", "und", "en"]


def test_results_do_not_depend_on_the_batch():
    lab = langid.Labeller(model())
    texts = [text(c, s, 1 + s * 7) for c in SOUNDS for s in range(20)]
    assert lab.documents(texts) == [lab.documents([t])[0] for t in texts]


def test_held_out_accuracy_on_the_documents(spark, sf, small_docs):
    from faultline.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op9_language"](spark, sf).collect()}
    assert set(got) == {d["doc_id"] for d in small_docs}
    held = [d for d in small_docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {d["doc_id"] for d in held}
    assert np.mean([got[d["doc_id"]].lang_pred == d["lang"] for d in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_jobs_over_awkward_rows(awkward, nothing):
    m = langid.train(awkward)
    got = langid.predict(awkward, m).collect()
    texts = {r[0]: r[1] for r in awkward_rows() if r[0] is not None}
    assert len(got) == len(awkward_rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or "")))
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = langid.keep_identified(awkward, m)
    assert kept.columns == awkward.columns
    assert all(any(map(str.isalpha, r.text)) for r in kept.collect())
    assert langid.train(nothing) is None
    assert {r.lang_pred for r in langid.predict(awkward, None).collect()} == {"und"}
    assert langid.predict(nothing, m).count() == 0 and langid.keep_identified(nothing, None).count() == 0


def test_sample_is_bounded_for_repeated_ids_and_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, langs: seen.update(n=len(texts), langs=set(langs)))
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:6]
    for doc in free:
        rows = [(doc, f"text number {i}", "en") for i in range(3000)]
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
        assert 50 < seen["n"] <= 200 and seen["langs"] == {"en"}
    rows = [(i, "one text", "en") for i in free for _ in range(2000)] + [(free[0], f"t {i}", "de") for i in range(40)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert seen["n"] <= 240 and "de" in seen["langs"]
