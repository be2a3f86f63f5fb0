"""Held-out accuracy of the reading levels on texts of known difficulty, and edge cases."""

import random
from datetime import datetime

from srcquarry.llm.reading import _counts, _curves, _first, reading_levels, word_blocks, word_vectors, words

EASY = ["the cat is on the mat", "we see it and run", "it is a red box", "you can go to the shop and be back"]
HARD = [
    "notwithstanding the asymptotic guarantees the canonicalization of heterogeneous representation is indispensable",
    "the epistemological status of interoperability circumscribes methodological scrutiny",
    "it follows that idempotence cannot be disentangled from combinatorial reconciliation",
]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = i % 5 / 4
        out.append((i, ". ".join(rng.choice(HARD if rng.random() < p else EASY) for _ in range(12)), 1 + i % 5))
    return out


def rank_correlation(a, b):
    def ranks(v):
        order = sorted(range(len(v)), key=lambda i: v[i])
        r = [0.0] * len(v)
        for k, i in enumerate(order):
            r[i] = k
        return r

    x, y = ranks(a), ranks(b)
    m = (len(a) - 1) / 2
    return sum((i - m) * (j - m) for i, j in zip(x, y)) / sum((i - m) ** 2 for i in x)


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, level string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, grade int, rated_at timestamp")
    return {r.doc_id: r for r in reading_levels(d, lab, key="doc_id", text="text", rounds=3).collect()}


def test_held_out(spark):
    t = datetime(2030, 1, 1)
    rng = random.Random(5)
    docs = corpus()
    labels = [(i, r, max(1, min(5, g + rng.choice([-1, 0, 0, 1]))), t) for i, _, g in docs if i % 4 == 0 for r in ("x", "y")] + [(0, "x", None, t), (0, "y", 1, t), (0, "y", 1, t)]
    got = run(spark, [(i, x) for i, x, _ in docs], labels)
    held = [(got[i].level, g) for i, _, g in docs if i % 4]
    assert len(got) == len(docs) and rank_correlation([a for a, _ in held], [g + i * 1e-6 for i, (_, g) in enumerate(held)]) > 0.85
    assert all(1 <= r.level <= 5 and r.band in (1, 2, 3, 4, 5) and r.lang_used == "en" for r in got.values())


def test_without_labels_and_odd_texts(spark):
    docs = [(i, x) for i, x, _ in corpus(100)] + [(900, None), (901, ""), (902, "```\ncode only\n```"), (903, "🙂 ... 123"), (904, "先编码副本。请打开索引再试。" * 2000)]
    got = run(spark, docs, [])
    assert len(got) == 105 and got[900].n_words == got[901].n_words == got[902].n_words == 0 and got[904].lang_used == "zh"
    easy, hard = [got[i].level for i in range(100) if i % 5 == 0], [got[i].level for i in range(100) if i % 5 == 4]
    assert sum(hard) / len(hard) > sum(easy) / len(easy)
    assert run(spark, [], []) == {}


def test_words():
    assert words("Der Dienst kopiert jeden Eintrag und die Sperre ist leer")[0] == "de"
    assert words("Le service copie chaque bloc et la page est vide dans le registre")[0] == "fr"
    assert words("El servicio copia cada bloque y la página no es del registro")[0] == "es"
    assert words("foo bar baz")[0] == "other"
    assert words("a `code` https://x.y/z <b>the end is near</b> &amp;")[1] == ["a", "the", "end", "is", "near"]


def test_blocks_hold_the_counts_of_every_word(spark, monkeypatch):
    monkeypatch.setattr("srcquarry.llm.reading.BLOCK_DOCS", 7)
    docs = [(i, x) for i, x, _ in corpus(60)] + [(900, None), (901, "的服务器先写日志再写数据")] + [(902, "w" + "x" * i) for i in range(50)]
    vectors = word_vectors(spark.createDataFrame(docs, "id long, text string"), key="id", text="text").selectExpr("*", "if(id % 2 = 0, 1.0D, null) as grade")
    blocks = word_blocks(vectors, key="id").cache()
    assert sorted(k for r in blocks.collect() for k in r["keys"]) == sorted(i for i, _ in docs) and blocks.count() > 8
    got = {(r.lang, r.word): (r.n, r.gn) for r in _counts(blocks).collect()}
    want = {}
    for i, t in docs:
        lang, ws = words(t) if t else ("other", [])
        for w in ws:
            a, b = want.get((lang, w), (0, 0))
            want[lang, w] = (a + 1, b + (i % 2 == 0))
    assert got == want  # words are told apart exactly
    first = _first(_counts(blocks), {"en": 30})
    curves, moved = _curves(first)
    assert moved == 0 and set(curves) == {k for k, _ in want} and all(abs(c.norm[40]) < 1e-9 for c in curves.values())
    blocks.unpersist()


def test_rounds_end_by_themselves(spark, monkeypatch):
    calls = []
    from srcquarry.llm import reading

    own = reading._newton
    monkeypatch.setattr(reading, "_newton", lambda *a: (calls.append(1), own(*a))[1])
    d = spark.createDataFrame([(i, t) for i, t, _ in corpus(200)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, "x", g) for i, _, g in corpus(200) if i % 2], "doc_id long, rater string, grade int")
    assert reading_levels(d, lab, key="doc_id", text="text", rounds=40).count() == 200 and 2 <= len(calls) < 40


def test_shuffled_and_sent_tables_agree(spark, monkeypatch):
    d = spark.createDataFrame([(i, t) for i, t, _ in corpus(120)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, "x", g) for i, _, g in corpus(120) if i % 2], "doc_id long, rater string, grade int")
    run = lambda: {r.doc_id: round(r.level, 6) for r in reading_levels(d, lab, key="doc_id", text="text", rounds=2).collect()}
    sent = run()
    monkeypatch.setattr("srcquarry.llm.reading.SMALL_TABLE", 0)
    assert run() == sent
