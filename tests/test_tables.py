from pyspark.sql import functions as F

from srcquarry.functions.tokenizers import bpe_counter
from srcquarry.operators.slicing import token_slices
from srcquarry.tables import cut, latest, shared_dir, spread


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (None, 1, "c"), (None, None, "d"), (2, None, "e")] + [(9, i, "x") for i in range(500)], "k int, t int, __delivery_rank string")
    got = sorted(map(tuple, latest(df, ["k"], [F.col("t").desc_nulls_last()]).collect()), key=str)
    assert got == [(1, 7, "b"), (2, None, "e"), (9, 499, "x"), (None, 1, "c")]
    assert latest(df.where("false"), ["k"], [F.col("t").desc()]).count() == 0


def test_spread_and_cut(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() >= 4 and sorted(r.id for r in spread(one).collect()) == list(range(100))
    many = spark.range(0, 100, 1, 50)
    assert spread(many).rdd.getNumPartitions() == 50
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert cut(many).count() == 100


def test_subword_slices(spark):
    text = "def alpha(value):\n    return value * 3\n" * 40 + "🙂é中" * 50
    df = spark.createDataFrame([(1, text, None), (2, "", "why")], "id int, body string, doc string")
    got = token_slices(df, bpe_counter(), max_tokens=32).collect()
    own = sorted((r for r in got if r.id == 1), key=lambda r: r.char_start)
    assert "".join(r.piece for r in own) == text and all(r.token_count <= 32 for r in got)
    assert [(r.source_field, r.piece) for r in got if r.id == 2] == [("body", ""), ("doc", "why")]
