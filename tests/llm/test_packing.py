import random

import pytest

from srcquarry.llm.packing import best_two_fit, pack_documents
from srcquarry.llm.tokens import DEFAULT_VOCABULARY, count, cut_to


def test_best_two_fit_is_a_packing():
    rng = random.Random(1)
    for capacity in (10, 100, 2048):
        for n in (0, 1, 5, 400):
            sizes = [rng.randrange(0, capacity + 1) for _ in range(n)]
            bins = best_two_fit(sizes, capacity)
            assert sorted(i for b in bins for i in b) == list(range(n))
            assert all(sum(sizes[i] for i in b) <= capacity for b in bins)


def test_two_fit_beats_greedy():
    # Greedy takes 6 and 3 of capacity 10; two unpacked items of 2 fit its place and gap exactly.
    bins = best_two_fit([6, 3, 2, 2], 10)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]


def test_little_space_unused():
    rng = random.Random(2)
    sizes = [min(2048, int(rng.lognormvariate(5.5, 0.8))) for _ in range(4000)]
    assert sum(sizes) / 2048 / len(best_two_fit(sizes, 2048)) > 0.99
    assert len(best_two_fit([0, 0], 5)) == 1 and len(best_two_fit([5] * 100, 5)) == 100


@pytest.mark.parametrize("text", ["word " * 3000, "中文" * 4000, "🙂é" * 3000, "x" * 30_000, "a\n" * 5000])
def test_cut_round_trip(text):
    parts = cut_to(text, 500, DEFAULT_VOCABULARY)
    assert "".join(p for p, _ in parts) == text
    assert all(0 < n <= 500 and n == count(p, DEFAULT_VOCABULARY) for p, n in parts)


def test_operator_round_trip(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "中文", "🙂"]) for _ in range(rng.randrange(400))) for i in range(300)}
    texts |= {900: "", 901: "word " * 2000}
    rows = [(k, v, "clash") for k, v in texts.items()] + [(902, None, ""), (None, "no key", "")]
    df = spark.createDataFrame(rows, "id long, text string, items string")
    got = pack_documents(df, key="id", text="text", capacity=256, shard_items=100).collect()
    found = {}
    for b in got:
        assert b.n_tokens <= 256 and b.n_tokens == sum(i.n_tokens for i in b["items"]) and b.n_items == len(b["items"])
        for i in b["items"]:
            assert i.n_tokens == count(i.text, DEFAULT_VOCABULARY)
            found.setdefault(i.id, {})[i.part] = i.text
    assert {k: "".join(p[i] for i in sorted(p)) for k, p in found.items()} == {**texts, 902: "", None: "no key"}
    assert all(len(p) == 1 or k == 901 or count(texts[k], DEFAULT_VOCABULARY) > 256 for k, p in found.items())
    assert len({b.container_id for b in got}) == len(got)


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "id long, text string"), key="id", text="text", capacity=10).collect() == []


@pytest.mark.parametrize(
    "text",
    [
        "don't we'll " * 4000, "a  \n  b\t\t c " * 4000, "x" * 50_000, "abc123" * 9000, "中文，" * 9000, "中" * 30_000, " " * 45_000 + "a", "\u2003a\u00a0 b\x1c c" * 6000, "it's5'5's''s" * 5000,
        "!?'re-" * 8000, "".join(random.Random(5).choice(["a", "1", " ", "\n", "'", "s", "é", "²", "\u3000", "-", "中"]) for _ in range(60_000)),
    ],
)
def test_spans_have_the_tokens_of_the_whole(text):
    from srcquarry.llm.tokens import spans, tokenizer

    encode = tokenizer(DEFAULT_VOCABULARY).encode_ordinary
    parts = list(spans(text))
    assert "".join(parts) == text and [t for p in parts for t in encode(p)] == encode(text)


def test_repeated_rows_and_other_keys(spark):
    got = pack_documents(spark.createDataFrame([(7, "same text")] * 400, "id short, text string"), key="id", text="text", capacity=16, shard_items=50)
    shards = got.selectExpr("split(container_id, '-')[0] as s", "n_items").groupBy("s").sum("n_items").collect()
    assert len(shards) == 8 and max(r[1] for r in shards) < 120 and sum(r[1] for r in shards) == 400 and got.first()["items"][0].id == 7
    dates = spark.sql("select date'2020-01-01' as id, 'x' as text union all select null, 'y'")
    assert sorted(str(i.id) for b in pack_documents(dates, key="id", text="text", capacity=9).collect() for i in b["items"]) == ["2020-01-01", "None"]
