import re

from tidelog.llm import secrets as S

KEY = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
TEXTS = [
    (1, f'some words token = "{KEY}" and more'),
    (2, f"see commit {KEY} for it"),
    (3, "😀 id 123e4567-e89b-12d3-a456-426614174000 and https://www.example.com/static/page/index2.html end"),
    (4, 'password: "hunter2!x" here'),
    (5, None),
    (6, ""),
    (7, "only words of some length internationalization"),
    (1, f'some words token = "{KEY}" and more'),
    (None, f"api_key={KEY}" + " word" * 50_000 + f' secret: "{KEY}"'),
]


def test_findings(spark):
    forest = S.train(S.labelled_findings(spark))
    df = spark.createDataFrame([(k, t, 1.0) for k, t in TEXTS], "doc_id long, text string, score double")
    rows = S.scan(df, forest).collect()
    for r in rows:
        assert any(k == r.doc_id and t and t[r.start : r.start + len(r.candidate)] == r.candidate for k, t in TEXTS)
    found = sorted((r.doc_id or 0, r.finding, r.is_secret) for r in rows)
    assert found == [(0, 0, True), (0, 1, True), (1, 0, True), (1, 0, True), (2, 0, False), (3, 0, False), (3, 1, False), (4, 0, True)]
    assert S.scan(df.limit(0), forest).collect() == []


def test_places_equal_those_of_a_plain_search(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    pattern = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{16,}={0,2}"
    expected = sorted((k or 0, m.start(), m[0]) for k, t in TEXTS for m in re.finditer(pattern, t or ""))
    got = sorted((r.doc_id or 0, r.start, r.candidate) for r in S.candidates(df).collect() if re.fullmatch(pattern, r.candidate))
    assert got == expected


def test_held_out_labels(spark):
    forest = S.train(S.labelled_findings(spark, 3_000, seed=1))
    test = S.featured(S.labelled_findings(spark, 1_000, seed=2), forest.turns).withColumn("score", forest.score()).collect()
    right = sum((r.score >= S.THRESHOLD) == bool(r.label) for r in test)
    assert right / len(test) > 0.97


def test_one_class_only(spark):
    only = S.labelled_findings(spark, 50).where("label = 1")
    assert S.train(only).trees == []


def test_candidates_hold_all_labelled_secrets(spark):
    rows = [(i, r.before, r.candidate, r.after) for i, r in enumerate(S.labelled_findings(spark, 1_000, seed=3).where("label = 1").collect())]
    df = spark.createDataFrame([(i, b + c + a) for i, b, c, a in rows], "doc_id long, text string")
    got = {(r.doc_id, r.candidate) for r in S.candidates(df).collect()}
    assert [(b, c) for i, b, c, _ in rows if (i, c) not in got] == []


def test_unquoted_and_digit_free_secrets(spark):
    cases = {
        "PASSWORD=hunter2!x": "hunter2!x",
        "a: 1\nsecret: abcdEFGHijklMNOPqrst\nb: 2": "abcdEFGHijklMNOPqrst",
        "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIbPxRfiCYzKEYqLmNo": "wJalrXUtnFEMIbPxRfiCYzKEYqLmNo",
        "user=me&token=q7#xW!9zLp&lang=en": "q7#xW!9zLp",
        "private key ZkQwXvBnTrPsLmGhYcJd end": "ZkQwXvBnTrPsLmGhYcJd",
        "see ZkQwXvBnTrPsLmGhYcJdQQxW end": "ZkQwXvBnTrPsLmGhYcJdQQxW",
    }
    forest = S.train(S.labelled_findings(spark))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, "secret internationalization of passwords somewhere"])], "doc_id long, text string")
    rows = S.scan(df, forest).collect()
    got = {(r.doc_id, r.candidate): r for r in rows}
    for i, (t, c) in enumerate(cases.items()):
        assert (i, c) in got and t[got[i, c].start :].startswith(c)
    assert all(got[i, c].is_secret for i, c in enumerate([*cases.values()][:5]))
    assert not any(r.is_secret for r in rows if r.doc_id == len(cases))
    long = spark.createDataFrame([(1, "token " + "x!" * 500_000)], "doc_id long, text string")
    assert [r.candidate for r in S.candidates(long).collect()] == ["x!" * 500_000]


def test_many_candidates_of_one_text(spark):
    """Places of 20,000 candidates in one text; the work grows with the text, not with its square."""
    words = [f"{i:016x}" for i in range(20_000)]
    got = S.candidates(spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words[:3]))], "doc_id long, text string")).collect()
    whole = sorted((r.start, r.candidate) for r in got)
    assert whole == sorted([(17 * i, w) for i, w in enumerate(words)] + [(17 * i, w) for i, w in enumerate(words[:3])])


def test_recall_of_planted_secrets(spark):
    """Secrets of forms that the labelled findings do not have, planted in the words of the test data, among look-alikes."""
    import random

    rnd = random.Random(11)

    def drawn(alphabet, n):
        return "".join(rnd.choices(alphabet, k=n))

    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200 and lang = 'en'").orderBy("doc_id").limit(200).collect()]
    planted, rows = {}, []
    for i, t in enumerate(texts):
        true = i % 2 == 0
        if true:
            value = rnd.choice([drawn(low + up + digit, 24), drawn("0123456789abcdef", 40), "AKIA" + drawn(up + digit, 16), drawn(low + digit, 32), drawn(up + low + digit + "+/", 44)])
            line = rnd.choice(["export APP_TOKEN={}", 'client.secret = "{}"', "Authorization: Bearer {}", "db_password: {}", "AWS_ACCESS_KEY_ID={}", '{{"api_key": "{}"}}'])
        else:
            value = rnd.choice([drawn("0123456789abcdef", 40), "-".join(rnd.sample(["house", "water", "light", *(w for w in t.lower().split() if w.isalpha() and len(w) > 4)], 3)), drawn(digit, 17)])
            line = rnd.choice(["commit {}", "sha1 checksum {}", "see https://www.example.org/path/{}/index.html", "order {}"])
        at = t.index(" ", len(t) // 2 if " " in t[len(t) // 2 :] else 0)
        planted[i] = (value, true)
        rows.append((i, f"{t[:at]}\n{line.format(value)}\n{t[at:]}"))
    found = {(r.doc_id, r.candidate): r.is_secret for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string"), S.train(S.labelled_findings(spark))).collect()}
    hits = [any(s and d == i and v in c for (d, c), s in found.items()) for i, (v, true) in planted.items() if true]
    false = [any(s and d == i and v in c for (d, c), s in found.items()) for i, (v, true) in planted.items() if not true]
    print("recall", sum(hits) / len(hits), "false", sum(false) / len(false))
    assert sum(hits) / len(hits) > 0.9 and sum(false) / len(false) < 0.1
