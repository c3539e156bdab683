"""Language, licences, chat, toxicity, quality: contracts, brute-force versions and edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, language, licenses, quality, toxicity
from tessera.llm.license_rules import BASE, rules

DOCS = "doc_id long, text string, lang string, score string, label int, first string"


def docs(spark, rows):
    """With extra columns whose names clash with those of results and intermediates."""
    return spark.createDataFrame([(i, t, lang, "x", 1, "y") for i, t, lang in rows], DOCS)


EN = "the quick brown fox jumps over the lazy dog and then the other thing with that which they thought"
DE = "der schnelle braune fuchs springt über den faulen hund und dann noch eine andere sache die sie dachten"


@pytest.fixture(scope="module")
def corpus(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(120):
        base, lang = (EN, "en") if i % 2 else (DE, "de")
        rows.append((i, " ".join(rnd.choices(base.split(), k=30)), lang))
    return docs(spark, rows + [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, EN * 400, None), (5, None, None), (5, EN, "en"), (None, EN, "en")])


def test_language(spark, corpus):
    got = {r["doc_id"]: r for r in language.identify(corpus, corpus.where("doc_id < 100")).collect() if r["doc_id"] is not None and r["doc_id"] != 5}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(120) if i != 5)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(corpus).count() == corpus.count()


def test_language_without_anything_to_learn(spark, corpus):
    empty = corpus.limit(0)
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(corpus, empty).collect()} == {"und"}


def test_language_histogram_is_whole_and_independent_of_chunks(monkeypatch):
    text = (EN + " " + DE + "\n") * 30
    whole = language.histogram(text)
    monkeypatch.setattr(language, "CHUNK", 101)
    assert (language.histogram(text) == whole).all()


def plain_scan(text):
    """Words, all hits and those that no other hit of the same or an earlier tier contains; every rule on every text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    norm = f" {' '.join(words)} "
    hits = [(norm.count(" ", 0, m.start()) - 1, norm.count(" ", 0, m.end()) - 1, r) for r in rules() for m in re.finditer(r.pattern, norm)]
    covers = lambda a, b: a[0] <= b[0] and a[1] >= b[1] and a[2].tier <= b[2].tier and ((a[0], a[1]) != (b[0], b[1]) or a[2].rank < b[2].rank)
    return words, hits, [h for h in hits if not any(covers(o, h) for o in hits)]


def test_licences_against_brute_force(spark):
    texts = [
        "Released under the MIT License. MIT LICENSE", None, "", "mit mit license license", "Licensed under the Apache License, Version 2.0.", "permit license", "mit-license\nMit  License", "é mit license é",
        "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1", "mit license " * 300, "Licensed under CC BY-NC 4.0.", "general public",
        "\u212a mit licen\u017fe \u0130", "filler words here " * 40_000 + "Apache License", " ".join(["GPL v2 or later; Apache License, Version 2.0 MIT License all rights reserved the unlicense"] * 150),
    ]
    df = docs(spark, [*[(i, t, "en") for i, t in enumerate(texts)], (0, texts[0], "en"), (None, texts[4], "en")])
    from unittest.mock import patch

    with patch.object(licenses, "table", lambda *_: df):
        rows = licenses.query(spark, "").collect()
        got = {r["doc_id"]: r for r in rows}
        assert licenses.query(spark, "").limit(0).count() == 0
    assert len(rows) == len(texts) + 2 and got[None]["labels"] == got[4]["labels"]
    for i, t in enumerate(texts):
        words, hits, alone = plain_scan(t)
        at, labels = [], set()
        for label, phrase in BASE:
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), t and t[:80]
        assert r["labels"] == ",".join(sorted(labels | {h[2].label for h in alone}))
        assert r["n_detections"] == len(alone)
        assert r["score"] == max([h[2].confidence for h in alone] + [h[2].confidence for h in hits if h[2].base], default=0.0)
    assert got[4]["labels"] == "apache,apache-2.0"
    assert got[9]["labels"].split(",") == ["gpl", "lgpl-2.1"]  # base label stays, though the longer name contains it
    assert got[11]["labels"] == "cc-by-nc"


def test_licence_rules_suppression(spark):
    assert len({r.pattern for r in rules()}) == len(rules()) >= 250
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0"), (2, "apache license")], "doc_id long, text string")
    got = {r["doc_id"]: [(d["first"], d["last"], d["label"]) for d in r["detections"]] for r in licenses.scan(df).collect()}
    assert got[1] == [(0, 7, "apache-2.0")]
    assert got[2] == [(0, 1, "apache")]
    assert licenses.scan(df.limit(0)).count() == 0


def texts_of(pattern):
    """Every text that a rule's pattern matches."""

    def alternatives(i):
        out, cur = [], [""]
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                out, cur, i = out + cur, [""], i + 1
                continue
            if pattern.startswith("(?:", i):
                part, i = alternatives(i + 3)
                i += 1
            elif pattern[i] == "[":
                part, i = list(pattern[i + 1 : pattern.index("]", i)]), pattern.index("]", i) + 1
            else:
                part, i = [pattern[i]], i + 1
            if i < len(pattern) and pattern[i] == "?":
                part, i = ["", *part], i + 1
            cur = [a + b for a in cur for b in part]
        return out + cur, i

    pattern = pattern.removeprefix("(?<= )").removesuffix("(?= )")
    return alternatives(0)[0]


def test_licence_keywords_are_implied():
    for r in rules():
        inner = r.pattern.removeprefix("(?<= )").removesuffix("(?= )")
        for t in texts_of(r.pattern):
            assert re.fullmatch(inner, t)
            assert r.keyword in f" {t} " and r.gate in f" {t} ", (r, t)


def test_licence_scan_is_the_same_without_keywords(spark):
    from dataclasses import replace

    texts = sorted({pick(texts_of(r.pattern), key=len) for r in rules() for pick in (min, max)})
    said = {
        "licensed to you under MIT": ("mit", 0.95), "licensed to you under Expat": ("mit", 0.95), "licensed to you under MPL 2.0": ("mpl", 0.95), "licensed to you under the Apache/MIT License": ("apache", 0.95),
        "licensed to you under the Apache License": ("apache", 0.95), "SPDX-License-Identifier: 0BSD": ("bsd-zero", 1.0), "0BSD": ("bsd-zero", 0.7), "0BSD license": ("bsd-zero", 0.7),
        "FreeBSD License": ("bsd-2-clause", 0.7), "Berkeley Software Distribution License": ("bsd", 0.7), "Internet Systems Consortium License": ("isc", 0.7),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": ("mit", 1.0),
        "SPDX-License-Identifier: GPL-2.0-or-later": ("gpl-2.0", 1.0), "https://creativecommons.org/licenses/by-sa/4.0/": ("cc-by-sa", 0.95),
    }
    df = spark.createDataFrame(list(enumerate([*said, *texts])), "doc_id long, text string")
    got = {r["doc_id"]: r["detections"] for r in licenses.scan(df).collect()}
    assert got == {r["doc_id"]: r["detections"] for r in licenses.scan(df, [replace(r, gate=" ", keyword=" ") for r in rules()]).collect()}
    for i, (text, (label, sure)) in enumerate(said.items()):
        assert (label, sure) in [(d["label"], d["confidence"]) for d in got[i]], (text, got[i])
    for i, text in enumerate([*said, *texts]):
        assert sorted((d["first"], d["last"], d["rank"]) for d in got[i]) == sorted((a, b, r.rank) for a, b, r in plain_scan(text)[2])


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <|end|> & [INST] <b> &l; &amp;"), (1, 1, "assistant", "x\ny"), (1, 2, "assistant", None), (2, 0, None, "q"), (None, 3, "ro\nle", "<|turn|>"), (3, None, "user", "t"), (3, None, "user", "t"), (3, 1, "assistant", "long " * 50_000)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_turns(t.select("conv_id", "turn", "role", chat.text_part(F.coalesce("text", F.lit(""))).alias("parts"))).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r["conv_id"]: r for r in done.collect()}
    for conv in (1, 2, None, 3):
        want = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(x["role"], x["text"]) for x in got[conv]["turns"]] == [(b, c) for _, b, c in want]
        assert "[INST]" not in got[conv]["formatted"]


def test_chat_ignores_clashing_columns_and_takes_empty_tables(spark, tmp_path):
    rows = [(7, 0, "user", "hi", "x", 1, None), (7, 0, "user", "hi", "x", 1, None), (7, 1, "assistant", "yo", None, 2, "z")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, ts int, content string")
    plain = t.select("conv_id", "turn", "role", "text")
    parts = lambda df: df.withColumn("parts", chat.text_part(F.col("text")))
    assert chat.format_turns(parts(t)).collect() == chat.format_turns(parts(plain)).collect() != []
    assert chat.format_turns(parts(t).limit(0)).count() == 0
    t.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r["n_turns"] for r in chat.query(spark, str(tmp_path)).collect()}
    assert got == {-1: 2, 7: 3}


def test_chat_parts(spark):
    t = spark.sql("""select 1L conv_id, 0L turn, 'user' role, array(
        named_struct('kind','text','text','see <','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
        named_struct('kind','image','text',null,'ref','a.png','width',57,'height',28,'seconds',null,'pages',null),
        named_struct('kind','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.0D,'pages',null),
        named_struct('kind','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',3),
        null, named_struct('kind','odd','text','z','ref',null,'width',null,'height',null,'seconds',null,'pages',null)) parts""")
    r = chat.format_turns(t.withColumn("parts", F.col("parts").cast(f"array<{chat.PART}>"))).first()
    assert r["formatted"] == "<|turn|>user\nsee &l;<|image:0|><|audio:1|><|document:2|>z<|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 25), ("document", "c.pdf", 768)]
    assert r["expanded_tokens"] == 796


def test_chat_query_digest(spark, tmp_path):
    spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert set(got) == {-1, 7}
    assert got[7]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()
    assert (got[7]["loss_chars"], got[7]["loss_sha256"]) == (2, hashlib.sha256(b"yo").hexdigest())


def test_toxicity(spark):
    import random

    rnd = random.Random(1)
    fill = lambda: " ".join(rnd.choices(EN.split(), k=8)) + "."
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = [fill() for _ in range(6)]
        if bad:
            text[rnd.randrange(6)] = "you are a blorf idiot."
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    d = docs(spark, [*rows, (900, None, None), (901, "", None), (902, "... !!", None), (903, "calm words. " * 5000, None)])
    lab = spark.createDataFrame([*labels, (None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab.where("doc_id < 200"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(d, model).collect()}
    assert all((got[i]["score"] >= 0.7) == (i % 3 == 0) for i in range(200, 300))
    assert [got[i]["score"] for i in (900, 901, 902)] == [0.0] * 3 and got[903]["score"] < 0.7
    text = dict((r[0], r[1]) for r in rows)[201]
    spans = got[201]["offending"]
    assert len(spans) == 1 and text[spans[0]["start"] : spans[0]["end"]] == "you are a blorf idiot."
    assert toxicity.score_documents(d.limit(0), model).count() == 0
    none = toxicity.fit(d, lab.limit(0))
    assert {r["score"] for r in toxicity.score_documents(d, none).collect()} == {0.0}


def test_quality(spark):
    import random

    rnd = random.Random(2)
    prose = lambda: " ".join(rnd.choices(EN.split() + DE.split(), k=60)).capitalize() + "."
    junk = [lambda: " ".join(w + "$$$ ***" for w in rnd.choices(EN.split(), k=30)), lambda: " | ".join(rnd.choices(EN.split(), k=40)), lambda: ("BUY NOW!! " * 40), lambda: "spam spam spam " * 30]
    rows = [(i, prose() if i % 5 else junk[i // 5 % 4](), "en") for i in range(400)]
    d = docs(spark, [*rows, (900, None, None), (901, "", None), (902, " \n", None), (3, rows[3][1], "en"), (None, prose(), None)])
    out = quality.judge(d)
    got = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert sum(got[i] != bool(i % 5) for i in range(400)) <= 4
    assert not any(got[i] for i in (900, 901, 902)) and out.count() == d.count()
    assert quality.judge(d.limit(0)).count() == 0


def test_label_model_frees_texts_that_only_a_poor_labeller_calls_bad():
    """The first labeller votes bad on a tenth of the good texts and on a tenth of the bad ones: its lone bad vote doesn't make a text bad,
    while the second one's, which otherwise stands with the others', does."""
    import itertools

    k, counts, truth = len(quality.LABELLERS), {}, {}
    for bad in (False, True):
        rates = [0.1, *[0.5 if bad else 0.002] * 3]
        for cast in itertools.product((0, 1), repeat=4):
            n = (2_000 if bad else 20_000) * np.prod([r if c else 1 - r for r, c in zip(rates, cast, strict=True)])
            p = "".join(str(quality.BAD if c else quality.GOOD) for c in cast) + str(quality.ABSTAIN) * (k - 4)
            counts[p] = counts.get(p, 0) + round(float(n))
            truth.setdefault(p, [0, 0])[bad] += n
    good = quality.label_model({p: n for p, n in counts.items() if n})
    for p, belief in good.items():
        share = truth[p][0] / sum(truth[p])
        assert abs(belief - share) < 0.1, (p, belief, share)
    lone = "0222" + "1" * (k - 4)
    assert good[lone] > quality.THRESHOLD and good["2000" + "1" * (k - 4)] < 0.01 and good["2022" + "1" * (k - 4)] < quality.THRESHOLD
    assert any((str(quality.BAD) not in p) != (g >= quality.THRESHOLD) for p, g in good.items())


def test_quality_scores_ignore_clashing_columns_and_judge_whole_texts(spark):
    long_junk = EN.capitalize() + ". " + " | ".join(EN.split() * 400)
    rows = [(i, EN.capitalize() + "." if i % 4 else " | ".join(EN.split() * 3), 0.5, True) for i in range(80)] + [(90, long_junk, None, None), (90, long_junk, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality_score double, kept boolean")
    got = [(r["doc_id"], r["kept"], r["quality_score"]) for r in quality.judge(d).collect()]
    assert len(got) == 82 and all(kept == bool(i % 4) for i, kept, _ in got if i < 80)
    assert [(i, kept) for i, kept, _ in got if i == 90] == [(90, False)] * 2 and len({x for i, _, x in got if i == 90}) == 1


def test_toxicity_places_what_it_finds(spark):
    import random

    rnd = random.Random(1)
    fill = lambda: " ".join(rnd.choices(EN.split(), k=8)) + "."
    rows = [(i, " ".join([fill(), "what a blorf day." if i % 3 == 0 else fill(), "such grumph here." if i % 3 == 0 else fill()]), "en") for i in range(240)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    d = docs(spark, [*rows, (300, (fill() + " ") * 5000 + "what a blorf day. such grumph here.", "en"), (300, None, "en")])
    model = toxicity.fit(d, lab)
    got = toxicity.score_documents(d, model).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == bool(r["offending"]) for r in got)
    hit = [r for r in got if r["doc_id"] == 300 and r["offending"]]
    assert len(hit) == 1 and hit[0]["score"] >= 0.7  # the whole of a very long text is read


def test_toxicity_weights_the_sample_to_the_share_of_labelled_documents(spark):
    """With both classes cut to the same number, the model has the table's share and not the sample's."""
    rows = [(i, "blorf here." if i % 10 == 0 and i % 20 else "calm words here.", "en") for i in range(400)]
    lab = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    got, share = toxicity.sample(docs(spark, rows), lab, per_class=40)
    assert share == 0.1 and got["toxic"].value_counts().to_dict() == {0: 40, 1: 40}


def test_language_knows_every_language(spark):
    """600 languages, of which each has its own letters; the hot one has most rows."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    rows = [(10 * k + j, (c + " ") * 3 + c * 4, f"l{k:03}") for k, c in enumerate(letters) for j in range(3)] + [(10_000 + j, EN, "en") for j in range(300)]
    got = language.identify(docs(spark, rows)).collect()
    want = {i: lang for i, _, lang in rows}
    assert language.train(language.sample(docs(spark, rows))).languages == sorted(set(want.values()))
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in got) > 0.6 * len(rows)
