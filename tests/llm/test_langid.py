import math
import random
from collections import Counter

import numpy as np

from tidelog.llm import langid

WORDS = {"aa": ["the", "thing", "of", "and"], "bb": ["über", "schön", "und", "ein"], "cc": ["qué", "niño", "los", "ir"]}


def text(rnd, lang, n):
    return " ".join(rnd.choices(WORDS[lang], k=n))


def brute_bits(model, counts, data):
    """Code length by walking the contexts of each byte."""
    size, total = model.size, 0.0
    s = [0, 0, 0] + [int(model.symbol[b | 32 if 65 <= b <= 90 else b]) for b in data]
    for i in range(3, len(s)):
        cost = 0.0
        for order in (3, 2, 1, 0):
            seen = counts[tuple(s[i - order : i])]
            if not seen:
                continue
            all_, kinds = sum(seen.values()), len(seen)
            if seen[s[i]]:
                cost -= math.log2(seen[s[i]] / (all_ + kinds))
                break
            cost -= math.log2(kinds / (all_ + kinds))
        else:
            cost += math.log2(size)
        total += cost
    return total


def test_code_lengths_and_languages(spark):
    rnd = random.Random(3)
    rows = [(i, text(rnd, lang, rnd.randrange(1, 30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa"), (901, "the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df, alphabet=24)
    assert model.langs == ["aa", "bb", "cc"] and model.size == 24

    tests = [(i, text(rnd, lang, 3), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    tests += [(100, None, "und"), (101, "", "und"), (102, "12 !?", "und"), (102, "12 !?", "und")]
    out = langid.identify(spark.createDataFrame([(*t, 0.5) for t in tests], "doc_id long, text string, lang string, score double"), model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out) and len(out) == len(tests)

    for number, lang in enumerate(model.langs):
        counts = {}
        for _, t, own in rows:
            if own == lang and t is not None:
                s = [0, 0, 0] + [int(model.symbol[b]) for b in t.lower().encode()]
                for i in range(3, len(s)):
                    for order in range(4):
                        counts.setdefault(tuple(s[i - order : i]), Counter())[s[i]] += 1
        counts = {k: counts.get(k, Counter()) for k in counts} | {}
        look = type("D", (dict,), {"__missing__": lambda self, k: Counter()})(counts)
        for _, t, _ in tests[:6] + [(0, "zzz THE ßß", "")]:
            raw = np.frombuffer(t.encode(), np.uint8)
            code = langid._codes(raw, np.array([0, len(raw)]), model.symbol, model.size)
            assert math.isclose(model.bits[number][code].sum(dtype=float), brute_bits(model, look, t.encode()), rel_tol=1e-4)


def test_without_languages_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(none)
    df = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [tuple(r) for r in langid.identify(df, model).collect()] == [(1, "word", "und", 0.0)]
    assert langid.identify(none, model).collect() == []


def test_every_byte_has_its_own_cost(spark):
    """With 20 languages, each byte counts: two languages that differ in a rare byte only are told apart by it."""
    rows = [("abcdefghijklmnopqrstuvwxyz 0123456789 äëïöüßñçéèêíóú " * 3, f"l{i:02}") for i in range(20)]
    rows += [("zahl 7", "l07"), ("zahl 8", "l08")] * 5
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.size == 256 and len(set(model.symbol[:255].tolist()) - {0}) == 255
    tests = [("zahl 7", "l07"), ("zahl 8", "l08")]
    got = langid.identify(spark.createDataFrame(tests, "text string, lang string"), model).collect()
    assert [(r.text, r.lang_pred) for r in got] == tests

    data = rows[7][0].encode()
    counts = {}
    for t, own in rows:
        if own == "l07":
            s = [0, 0, 0] + [b + 1 for b in t.lower().encode()]
            for i in range(3, len(s)):
                for order in range(4):
                    counts.setdefault(tuple(s[i - order : i]), Counter())[s[i]] += 1
    look = type("D", (dict,), {"__missing__": lambda self, k: Counter()})(counts)
    for t in (data, "zahl 7 ÿ 𝄞 %&".encode()):
        raw = np.frombuffer(t, np.uint8)
        code = langid._codes(raw, np.array([0, len(raw)]), model.symbol, model.size)
        assert math.isclose(model.bits[7][code].sum(dtype=float), brute_bits(model, look, t), rel_tol=1e-4)


def test_counts_that_leave_a_task_early(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(text(rnd, lang, 20), lang) for lang in ["aa", "bb", "cc"] * 30]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    whole = langid.train(df)
    monkeypatch.setattr(langid, "HELD_RUNS", 50)
    parted = langid.train(df)
    for a, b in zip(whole.bits, parted.bits, strict=True):
        assert all((x == y).all() for p, q in zip(a.orders, b.orders, strict=True) for x, y in zip(p, q, strict=True))


SCRIPTS = {"latin": range(0x61, 0x7B), "greek": range(0x3B1, 0x3CA), "cyrillic": range(0x430, 0x450), "hebrew": range(0x5D0, 0x5EB), "arabic": range(0x627, 0x64B), "devanagari": range(0x915, 0x93A), "thai": range(0xE01, 0xE2F), "kana": range(0x3042, 0x3094), "hangul": range(0xAC00, 0xAC40), "han": range(0x4E00, 0x4E60)}


def test_sixty_languages_of_ten_scripts(spark):
    """Six languages to a script, told apart by their words alone; predictions equal the least code length by a plain walk."""
    rnd = random.Random(12)
    vocabulary = {}
    for script, letters in SCRIPTS.items():
        for k in range(6):
            vocabulary[f"{script}{k}"] = ["".join(chr(rnd.choice(letters)) for _ in range(rnd.randrange(3, 8))) for _ in range(12)]
    rows = [(" ".join(rnd.choices(words, k=40)), lang) for lang, words in vocabulary.items() for _ in range(3)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert len(model.langs) == 60 and model.size == 256
    tests = [(" ".join(rnd.choices(words, k=4)), lang) for lang, words in vocabulary.items()]
    got = langid.identify(spark.createDataFrame(tests, "text string, lang string"), model).collect()
    assert [(r.text, r.lang_pred) for r in got if r.lang_pred == r.lang] == tests

    counts = {lang: {} for lang in model.langs}
    for t, lang in rows:
        s = [0, 0, 0] + [b + 1 for b in t.lower().encode()]
        for i in range(3, len(s)):
            for order in range(4):
                counts[lang].setdefault(tuple(s[i - order : i]), Counter())[s[i]] += 1
    look = {lang: type("D", (dict,), {"__missing__": lambda self, k: Counter()})(c) for lang, c in counts.items()}
    for r in got[::9]:
        bits = {lang: brute_bits(model, look[lang], r.text.encode()) for lang in model.langs}
        best = min(bits, key=lambda x: (bits[x], x))
        assert r.lang_pred == best
        assert math.isclose(r.score, 1 / sum(2.0 ** -min(1000, b - bits[best]) for b in bits.values()), rel_tol=1e-2)


def test_ties_go_to_the_first_language(spark):
    model = langid.train(spark.createDataFrame([("same words here", "zz"), ("same words here", "aa")], "text string, lang string"))
    got = langid.identify(spark.createDataFrame([("same words",), ("other",)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["aa", "aa"] and all(abs(r.score - 0.5) < 1e-9 for r in got)


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    model = langid.train(spark.createDataFrame([(text(rnd, lang, 200), lang) for lang in WORDS], "text string, lang string"))
    got = langid.identify(spark.createDataFrame([(text(rnd, "bb", 400_000),)], "text string"), model).first()
    assert got.lang_pred == "bb" and got.score == 1.0
