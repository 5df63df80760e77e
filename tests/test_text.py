"""Goldens for the text functions (FIXTURES section 3)."""
from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.functions import text as T

ADD_GOLDEN = [
    ("add a big red hat on the horse", "hat"), ("include a beach umbrella", "umbrella"),
    ("add a cup of coffee in his hand", "cup"), ("add a fresh fruit bowl on the table", "bowl"),
    ("add a person taking a bath", "person"), ("Add some Butterflies above", "butterfly"),
    ("add vases", "vas"), ("add glasses", "glass"), ("add a bookshelves", "bookshelve"),
    ("add boxes", "box"), ("add apple on the table", "pple"), ("put on a hat", None),
    ("add the", "the"), ("remove a hat", None), ("add a dog to the left", "dog"),
    ("insert clouds sky", "cloud"), (None, None), ("", None), ("add two cats", "cat"),
    ("add a bus", "bus"), ("add ties", "tie"), ("add a dress", "dress"),
    ("add a large sailboat, left side", "sailboat"),
]


def test_add_object_goldens(spark):
    df = spark.createDataFrame(ADD_GOLDEN, "i string, want string")
    got = df.select("want", T.add_object(F.col("i")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_add_object_strict_article(spark):
    df = spark.createDataFrame([("add apple on the table",), ("add a hat",)], "i string")
    got = [r[0] for r in df.select(T.add_object(F.col("i"), strict_article=True)).collect()]
    assert got == ["apple", "hat"]


def test_classify_real_captions(spark):
    want = ["painting", "rain_storm", "rain_storm", "snow_winter", "snow_winter", "cartoon_anime",
            "desert", "fire_lava", "night", "night", "space_scifi", "drawing_sketch",
            None, None, None, None]
    p = fx.pairs(spark, "/root/testdata/sf0.001").where("row_id < 16").orderBy("row_id")
    rows = p.select(T.classify_real(F.col("caption")).alias("a"),
                    T.classify_real_by_rule_table(F.col("caption")).alias("b")).collect()
    assert [r.a for r in rows] == want
    assert [r.b for r in rows] == want


def test_classify_tune_instructions(spark):
    texts = ["change the weather to snow", "make the season autumn", "make it a snowy night",
             "change the time to dusk", "let it fall", "make the weather foggy",
             "turn it to stormy evening", "brighten the room", "make it summer",
             "change the season to winter", "mist at midnight"]
    want = ["weather_snow", "season_autumn", "time_night", "time_evening", "season_autumn",
            "weather_fog", "time_evening", None, "season_summer", "season_winter", "time_night"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(T.classify_tune(F.col("t"))).collect()]
    assert got == want


def test_classify_edit_and_ids(spark):
    from editlake import taxonomy as tx
    rows = [("replace", "replace the dog with a cat"), ("style_change", "apply style_change"),
            ("add", "add a bus"), ("add", "add two cats")]
    df = spark.createDataFrame(rows, "et string, i string")
    got = [r[0] for r in df.select(T.classify_edit(F.col("et"), F.col("i"))).collect()]
    assert got == [None, "style_change", None, "add_cat"]
    ids = {"null": 0, "black_and_white": 1, "low_contrast": 13, "painting": 14, "drawing_sketch": 23,
           "season_winter": 24, "season_summer": 31, "style_change": 32, "background_change": 33,
           "add_ball": 34, "add_hat": 56, "add_ribbon": 63}
    assert all(tx.TYPE_ID[k] == v for k, v in ids.items())
    assert tx.N_TYPES == 64


def test_word_tokens_python_split(spark):
    df = spark.createDataFrame([("  Make it \"Snowy!\" and the  winter's...\tday  ",)], "t string")
    got = df.select(T.word_tokens(F.col("t"))).first()[0]
    want = [w.strip(".,!?\"'") for w in "  Make it \"Snowy!\" and the  winter's...\tday  ".lower().split()]
    from editlake import taxonomy as tx
    want = [w for w in want if len(w) > 2 and w not in tx.PROFILE_STOP_WORDS]
    assert got == want


def test_fixture_totals(spark):
    p = fx.pairs(spark, "/root/testdata/sf0.01")
    assert p.count() == 15000
    assert p.select("shard").distinct().count() == 150
    assert p.where("edit_type_nullable is null").count() == 2143
    assert p.where("edit_type = 'add'").select("instruction").distinct().count() == 1669
    c = {r.edit_type: (r.n, r.d) for r in
         p.groupBy("edit_type").agg(F.count("*").alias("n"), F.count_if("decodable").alias("d")).collect()}
    assert c["add"] == (3000, 2968) and c["replace"] == (3000, 2970)
