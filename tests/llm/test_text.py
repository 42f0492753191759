import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import langid, lm_score, pii, quality, sharding

SHORT = "doc_id long, text string, lang string, source string"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# language models

def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


LM = [(1, "a b c a b d"), (2, "A B\tC"), (3, "x"), (4, None), (5, " "), (6, "a b"), (7, "a b c " * 400), (8, "é ü é"), (9, "z y"), (None, "q r s t")]


@pytest.mark.parametrize("order", [2, 3])
def test_corpus_scores(spark, order):
    counts = collections.Counter()
    for _, t in LM:
        w = words(t)
        for n in range(1, order + 1):
            counts.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    total = sum(len(words(t)) for _, t in LM)
    got = {r["doc_id"]: r for r in lm_score.score_corpus(docs(spark, LM), order).collect()}
    assert len(got) == len(LM)
    for i, t in LM:
        w, s = words(t), 0.0
        for k in range(len(w)):
            n = min(order, k + 1)
            g = tuple(w[k - n + 1:k + 1])
            s += math.log(counts[g] / (counts[g[:-1]] if n > 1 else total))
        r = got[i]
        assert r["n_words"] == len(w) and abs(r["log_score"] - s) < 1e-6 * max(1, abs(s))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = ("some words " * 50).encode()
    want = lm_score._text_words(text)
    monkeypatch.setattr(lm_score, "BATCH_BYTES", 64)
    lm_score._powers.cache_clear()
    assert (lm_score._text_words(text) == want).all()
    lm_score._powers.cache_clear()


def test_long_words_are_one_word(monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_BYTES", 64)
    lm_score._powers.cache_clear()
    a, b = "x" * 300, "Y" * 70
    for text in (f"{a} b", f"b\t{a}\t{b}\tc", "\t".join(f"w{k}" for k in range(100)), f"{a}", f"  \r\f{a}\v "):
        want = text.lower().split()
        got = lm_score._text_words(text.encode())
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
        assert (lm_score._text_words(text.replace("\t", " ").encode()) == got).all()
    assert (lm_score._text_words(b"short") == lm_score.word_hashes(b"short")[0]).all()
    lm_score._powers.cache_clear()


def test_repeated_rows_are_scored_apart(spark):
    rows = [(1, "a b"), (1, "a b"), (1, None), (None, "b c"), (None, "b c")]
    for scored in (lm_score.score_corpus(docs(spark, rows)), lm_score.score_against(docs(spark, rows), docs(spark, rows))):
        got = sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in scored.collect())
        assert [x[:2] for x in got] == [("1", 0), ("1", 2), ("1", 2), ("None", 2), ("None", 2)] and got[1] == got[2] and got[3] == got[4] and got[0][2] == 0


def test_scores_back_off(spark):
    ref = docs(spark, [(1, "a b c"), (2, "a b d"), (3, "b c")])
    got = {r["doc_id"]: r["log_score"] for r in lm_score.score_against(docs(spark, [(1, "a b c"), (2, "c a"), (3, "new"), (4, None)]), ref).collect()}
    n = 8
    assert got[1] == pytest.approx(math.log(0.16 * 2 / n) + math.log(0.4 * 2 / 2) + math.log(1 / 2))
    assert got[2] == pytest.approx(math.log(0.16 * 2 / n) + math.log(0.16 * 2 / n))
    assert got[3] == pytest.approx(math.log(0.16 / n)) and got[4] == 0


def test_empty_corpus(spark):
    assert lm_score.score_corpus(docs(spark, [])).count() == 0
    assert [tuple(r) for r in lm_score.score_corpus(docs(spark, [(1, "")])).collect()] == [(1, 0, 0.0)]


# languages

def test_language_accuracy(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(docs_.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    model = langid.train(docs(spark, [(1, "the cat and the dog", "en", None), (2, "le chat et le chien", "fr", None), (3, None, "en", None), (4, "zzz", None, None)], SHORT), "text", "lang", "doc_id")
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, [(1, "the dog"), (2, None), (3, ""), (4, "123 !?"), (5, "le chien " * 300_000)]), model).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 6)] == ["en", "und", "und", "und", "fr"] and got[2]["score"] == 0
    nothing = langid.train(docs(spark, [], SHORT), "text", "lang", "doc_id")
    assert langid.predict(docs(spark, [(1, "the")]), nothing).first()["lang_pred"] == "und"


def brute_language(train, text):
    """Log posteriors by dictionaries of n-grams themselves."""
    def grams(t):
        t = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        t = re.sub(" +", " ", t)
        return collections.Counter(t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))

    known, sizes = {}, collections.Counter(lang for _, lang in train)
    for t, lang in train:
        known.setdefault(lang, collections.Counter()).update(grams(t))
    found = grams(text)
    out = {}
    for lang, counts in known.items():
        total = sum(counts.values()) + langid.SMOOTHING * langid.DIMENSIONS
        out[lang] = math.log((sizes[lang] + 1) / (len(train) + len(known))) + sum(n * math.log((counts[g] + langid.SMOOTHING) / total) for g, n in found.items())
    root = math.sqrt(sum(found.values()))
    top = max(out, key=out.get)
    return top, 1 / sum(math.exp((v - out[top]) / root) for v in out.values())


def test_language_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    words = {"en": "the cat and dog house with some".split(), "fr": "le chat et chien maison avec été".split(), "de": "der hund und katze haus mit größe".split()}
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30))) + rng.choice(["", "!", "\n7", "İ"])
    train = [(make(lang), lang) for lang in ("en",) * 40 + ("fr",) * 10 + ("de",) * 5]
    model = langid.train(docs(spark, [(k, t, lang, None) for k, (t, lang) in enumerate(train)], SHORT), "text", "lang", "doc_id")
    tests = [make(rng.choice(["en", "fr", "de"])) for _ in range(60)] + ["a", "zzz qq", "e été the"]
    tests += [t + " " + make("en") * 40 for t in tests[:5]]
    got = [(r["lang_pred"], r["score"]) for r in langid.predict(docs(spark, list(enumerate(tests))).coalesce(1), model).orderBy("doc_id").collect()]
    want = [brute_language(train, t) for t in tests]
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-3 for g, w in zip(got, want, strict=True))
    whole = model.score(tests)
    monkeypatch.setattr(langid, "CHUNK_CHARS", 3)  # cuts inside words change nothing
    cut = model.score(tests)
    assert cut[0] == whole[0] and np.allclose(cut[1], whole[1])


def test_language_of_odd_tables(spark):
    model = langid.train(docs(spark, [(1, "the cat", "en", None), (2, "le chat", "fr", None)], SHORT), "text", "lang", "doc_id")
    odd = docs(spark, [(1, "the cat"), (1, "the cat"), (None, None)]).selectExpr("*", "'x' lang_pred", "1 score", "2 l", "3 t", "4 i")
    got = langid.predict(odd, model)
    assert got.columns == odd.columns and [r["lang_pred"] for r in got.collect()] == ["en", "en", "und"]
    assert langid.predict(docs(spark, []), model).count() == 0
    assert langid.train(odd.selectExpr("*", "'en' lang"), "text", "lang", "doc_id").languages == ["en"]


# quality

def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "a", " x y", "# | <", "😀 é", "a b c d e f g h " * 3, "one\ntwo\none\n\n one"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "\t", "#", "long word "]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, list(enumerate(texts))).selectExpr("*", "'en' lang", "cast(null as string) source")).collect()}
    for k, t in enumerate(texts):
        r, want = got[k], base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r["base_failed"] or not r["kept"])


def clean(rng, n=None):
    n = n or rng.randint(60, 400)
    out = []
    for k in range(n):
        w = "".join(rng.choice("aeioubcdfghlmnprst") for _ in range(rng.randint(2, 9)))
        out.append((w.capitalize() if k % 12 == 0 else w) + ("." if k % 12 == 11 else "") + ("\n" if k % 60 == 59 else ""))
    return " ".join(out)


def test_outliers_are_rejected_and_clean_text_stays(spark):
    rng = random.Random(9)
    rows = [(k, clean(rng), "en", f"s{k % 2}") for k in range(500)]
    bad = [(1000 + k, " ".join(w + rng.choice(["###", "&&&", "|"]) for w in clean(rng).split()), "en", f"s{k % 2}") for k in range(30)]
    bad += [(2000 + k, " ".join(w.upper() + "!!" for w in clean(rng).split()), "en", f"s{k % 2}") for k in range(30)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows + bad, SHORT)).collect()}
    assert not any(got[i] for i, *_ in bad) and sum(got[i] for i, *_ in rows) == len(rows)


def test_odd_word_lengths_are_rejected(spark):
    rng = random.Random(11)
    rows = [(k, clean(rng), "en", "s") for k in range(500)]
    glued = [(1000 + k, re.sub(r"(\w+) (\w+) (\w+)", r"\1\2\3", clean(rng, 400)), "en", "s") for k in range(20)]
    spaced = [(2000 + k, " ".join(clean(rng, 100).replace(" ", "")), "en", "s") for k in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows + glued + spaced, SHORT)).collect()}
    assert sum(got[i] for i, *_ in rows) == len(rows) and not any(got[i] for i, *_ in glued + spaced)


def brute_mcd(x, names):
    """Squared distances to the minimum covariance determinant estimate of rows ``x``, in numpy."""
    floors = np.array([quality.STATISTICS[n] for n in names])
    low = lambda v, p: np.sort(v)[max(0, math.ceil(p * len(v)) - 1)]
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    m0 = np.array([low(v, 0.5) for v in x.T])
    spread = np.array([low(np.abs(v - m), 0.5) for v, m in zip(x.T, m0, strict=True)])
    found = []
    for c in (np.diag(np.maximum(1.4826 * spread, floors) ** 2), np.eye(len(names))):
        m = m0
        for _ in range(quality.STEPS):
            d = distance(m, c)
            core = x[d <= low(d, quality.CORE)]
            m, c = core.mean(axis=0), np.cov(core.T, bias=True) + np.diag(floors**2)
        found.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    d = distance(m, c)
    return d / max(1.0, low(d, 0.5) / quality.CHI2_MEDIAN)


def test_verdicts_against_numpy(spark):
    rng = random.Random(21)
    rows = []
    for k in range(900):
        t = clean(rng)
        if k % 25 == 0:
            t = " ".join(w + rng.choice(["", "#", "&&&", "!", "|"]) for w in t.split())
        elif k % 11 == 0:
            t = "\n".join(x for line in t.split("\n") for x in [line] * rng.randint(1, 3))
        rows.append((k, t, ["en", "fr", None][k % 3], ["a", "b"][k % 2]))
    rows += [rows[5], rows[18]]
    got = quality.judge(docs(spark, rows, SHORT)).join(docs(spark, rows, SHORT).select("doc_id", "lang", "source").distinct(), "doc_id").toPandas()
    names = list(quality.STATISTICS)
    usable = got[~got["base_failed"]]
    pooled = [(usable["lang"].isna() if lang is None else usable["lang"] == lang) for lang in ("en", "fr", None)]  # 150 rows a source are few: a language is a group
    for at in pooled:
        part = usable[at]
        want = brute_mcd(part[names].to_numpy(), names)
        assert len(part) >= quality.MIN_GROUP and np.allclose(part["distance2"], want, rtol=1e-6)
        assert ((want <= quality.CHI2_CUT) == part["kept"]).all()
    assert 0 < (~usable["kept"]).sum() < 200 and len(got) == len(rows)


def test_quality_keeps_rows_by_their_own_text(spark):
    rng = random.Random(3)
    good, bad = clean(rng, 100), "a b"
    out = quality.keep_good(docs(spark, [(1, good, "en", "s"), (1, bad, "en", "s"), (1, good, "en", "s"), (None, good, None, None), (2, None, None, None)], SHORT))
    assert [(r["doc_id"], r["text"]) for r in out.orderBy("doc_id").collect()] == [(None, good), (1, good), (1, good)]
    assert quality.keep_good(docs(spark, [], SHORT)).count() == 0


def test_quality_edges(spark):
    few = docs(spark, [(1, clean(random.Random(1), 100), None, None), (2, None, None, "s")], SHORT)
    assert {r["doc_id"]: r["kept"] for r in quality.judge(few).collect()} == {1: True, 2: False}
    assert quality.judge(docs(spark, [], SHORT)).count() == 0
    more = few.selectExpr("*", "1 as n_words", "2 as g", "3 as d2", "4 as _words")
    assert quality.keep_good(more).columns == more.columns and quality.keep_good(more).count() == 1


def test_quality_plan_has_no_python(spark):
    plan = quality.judge(docs(spark, [(1, "a b", "en", "s")], SHORT))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# personal data

def oracle(t):
    luhn = lambda s: sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15],
    ]
    return [(k, *s) for k, spans in enumerate(found) for s in spans]


def test_long_runs_of_digits():
    began = time.perf_counter()
    for t in ("1" * 400_000, "1" * 5000 + ".1.1.1", "0" * 5000 + "7.1.1.1", "1." * 100_000, "1.1.1." * 50_000, "+1" + "(" * 200_000, "+1" * 100_000, "a" * 300_000 + "@", "a@" * 100_000, "=" * 100_000 + "x" * 100_000, "A" * 100_000, "Ab " * 60_000):
        base = pii.base_spans(t)
        pii.candidates(t, base)
        if t[-6:] == ".1.1.1" and len(t) < 10_000:
            assert base == ([(1, 0, len(t))] if t[0] == "0" else [])
    assert time.perf_counter() - began < 20


def test_spans_beside_columns_of_their_names(spark):
    d = docs(spark, [(1, "a@b.io"), (1, "a@b.io"), (None, None)]).selectExpr("*", "1 as spans", "'x' as n_email", "2 as `odd name`", "3 as base_sha256")
    out = pii.find_spans(d, pii.fit(d))
    assert out.columns == ["doc_id", "odd name", *pii.FOUND]
    got = out.collect()
    assert [r["n_email"] for r in got] == [1, 1, 0] and got[0]["spans"] == "email:0:6" and [r["n_spans"] for r in got] == [1, 1, 0]
    assert pii.mask(d, pii.fit(d)).columns == d.columns


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab1259@@..-+ ()%é\n")), max_size=60))
def test_base_spans(text):
    assert sorted(pii.base_spans(text)) == sorted(oracle(text))


def test_spans_and_masks(spark):
    card = "4539 1488 0343 6467"
    rows = [(1, f"mail a.b@c.example.com from 10.0.0.1, card {card}, call +49 (30) 1234567"), (2, None), (3, ""), (4, "nothing here, version 1.2.3.4000"), (5, "x" * 200_000 + " z@y.io")]
    rows += [(k, f'the token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and call (555) 123-4567 phone') for k in range(10, 40)]
    d = docs(spark, rows)
    model = pii.fit(d)
    got = {r["doc_id"]: r for r in pii.find_spans(d, model).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 1, 1)
    assert got[2]["spans"] == got[3]["spans"] == got[4]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all("secret:" in got[k]["spans"] for k in range(10, 40))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(d, model).collect()}
    assert masked[1] == "mail <EMAIL> from <IP>, card <CARD>, call <PHONE>" and masked[2] is None and masked[5].endswith(" <EMAIL>")
    assert pii.find_spans(docs(spark, []), pii.fit(docs(spark, []))).count() == 0


@pytest.mark.parametrize("text, name", [
    ("Dear John Smith, hello", "John Smith"), ("Contact Maria Lopez now", "Maria Lopez"), ("An Herr Klaus Weber", "Klaus Weber"), ("Frau Anna Müller", "Anna Müller"),
    ("wrote José García", "José García"), ("Hola María López", "María López"), ("Mr. Smith came", "Smith"), ("Dear Zoltán Kovács", "Zoltán Kovács"), ("by John O'Neill", "John O'Neill")])
def test_names_are_proposed(text, name):
    found = {text[s:e]: pii.decode(code)[1] for (kind, s, e), code in pii.candidates(text, []) if pii.KINDS[kind] == "name"}
    assert name in found and list(found).count(name) == 1 and found[name][pii.LABELERS.index("gazetteer")] == (0 if " " not in name else -1 if "Zolt" in name else 1)


def test_labelers_decide_on_names():
    known = [f"Dear {g} Smith, the plan is set. " for g in ("John", "Maria", "Klaus", "José")] * 50
    titled = ["We met Mr. Lindqvist there. "] * 40
    other = [f"In the {a} {b} of that year. " for a in ("United", "Old", "Grand", "Second") for b in ("House", "Bridge")] * 100
    counts = collections.Counter(code for t in known + titled + other for _, code in pii.candidates(t, []))
    accepted = pii.SpanModel(counts).accepted
    named = lambda t: [t[s:e] for k, s, e in pii.spans_of(t, accepted)[1]]
    assert [named(t) for t in known[:4]] == [["John Smith"], ["Maria Smith"], ["Klaus Smith"], ["José Smith"]]
    assert named(titled[0]) == ["Lindqvist"] and not any(named(t) for t in other)


def test_codes_hold_votes():
    text = "card 4539148803436468 and 555 123 4567"
    for span, code in pii.candidates(text, []):
        kind, votes, _ = pii.decode(code)
        assert kind == span[0] and len(votes) == len(pii.LABELERS) and set(votes) <= {-1, 0, 1}


# shards

def test_jump_hash_moves_only_to_the_new_shard():
    keys = np.arange(-5000, 20000)
    for n in range(1, 12):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(a, minlength=n).max() < 1.15 * len(keys) / n
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_shards_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 50)
    rows = [(k, f"t{k}") for k in range(500)] + [(3, "t3"), (3, None), (None, "n")]
    placed = sharding.assign_shards(docs(spark, rows), "doc_id", 8)
    got = sharding.number_slots(placed, "doc_id", ["text"]).collect()
    assert len(got) == len(rows)
    for s in range(8):
        mine = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == s)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine)
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    assert sharding.number_slots(sharding.assign_shards(docs(spark, []), "doc_id", 8), "doc_id", ["text"]).count() == 0


def test_nulls_beside_large_ids_move_nothing(spark):
    rows = [(9007199254740993 + k, "x") for k in range(50)]
    alone = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs(spark, rows), "doc_id", 8).collect()}
    beside = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs(spark, [*rows, (None, "y")]).coalesce(1), "doc_id", 8).collect()}
    assert beside.pop(None) == int(sharding.jump_hash(np.zeros(1, np.int64), 8)[0]) and beside == alone
    more = sharding.assign_shards(docs(spark, rows).selectExpr("*", "'a' shard", "1 size", "2 slot"), "doc_id", 8)
    got = sharding.number_slots(more, "doc_id", ["text"])
    assert sorted(got.columns) == sorted(["doc_id", "text", "size", "shard", "grown_shard", "slot"]) and got.agg({"slot": "max"}).first()[0] < 50


def test_shards_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = c.execute(f"select {', '.join(names)} from ({sharding.op9_oracle()})").fetchall()
    assert sorted(tuple(r) for r in sharding.op9_jump_shards(spark, d).select(names).collect()) == sorted(want)


def test_checksums_in_sql():
    import duckdb
    import zlib

    c = duckdb.connect()
    texts = [None, "", "a", "abc", "é日" * 500, "0" * 70_000]
    c.execute("create table t (doc_id bigint, text varchar)")
    c.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    got = dict(c.execute(f"with {sharding.crc32_sql('t')} select doc_id, text_crc32 from crcs").fetchall())
    assert got == {k: zlib.crc32((t or "").encode()) for k, t in enumerate(texts)}
