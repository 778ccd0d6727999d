import pytest
from pyspark.sql import functions as F

from tidemark.functions import external as E
from tidemark.functions import vectors as V
from tidemark.operators import store as S

FIELDS = "dog_id string, field string, value string, soft_value string, vis string, ord int"
CHUNK = "dog_id string, layer string, trait string, conf float, vis string, video_id string, t_start float, t_end float, text string, embedding array<float>"
ANALYSIS = "dog_id string, video_id string, job_id string, segments array<struct<start:double,end:double,group:string,action:string,conf:double,uncertain:boolean>>, profile string"


def chunk(text, video="v1", layer="L2", vis="public", dog="d1", vec=(1.0, 0.0)):
    return (dog, layer, None, None, vis, video, None, None, text, list(vec))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = S.Store(spark, str(tmp_path_factory.mktemp("store")))
    s.init()
    s.init()
    return s


def test_cards(spark, store):
    dog = spark.createDataFrame([("d1", "Tori", "open")], "dog_id string, name string, status string")
    rows = [("d1", "age", "3", None, "public", 0), ("d1", "home", "x street", "north", "public_soft", 1), ("d1", "phone", "1", "", "public_soft", 2), ("d1", "note", "n", None, "staff", 3)]
    store.upsert_card(dog, spark.createDataFrame(rows, FIELDS))
    name, status, card = S.load_card(store.read("dogs"), store.read("dog_fields"), "d1")
    assert (name, status) == ("Tori", "open") and [tuple(r) for r in card.collect()] == [("age", "3"), ("home", "north")]
    assert [r.value for r in S.load_card(store.read("dogs"), store.read("dog_fields"), "d1", staff=True)[2].collect()] == ["3", "x street", "1", "n"]
    store.upsert_card(dog.withColumn("status", F.lit("gone")), spark.createDataFrame(rows[:1], FIELDS))
    name, status, card = S.load_card(store.read("dogs"), store.read("dog_fields"), "d1")
    assert status == "gone" and card.count() == 1 and store.read("dog_fields").first().id == 5
    with pytest.raises(KeyError):
        S.load_card(store.read("dogs"), store.read("dog_fields"), "nobody")
    with pytest.raises(ValueError, match="allowed: vis"):
        store.upsert_card(dog, spark.createDataFrame([("d1", "a", "b", None, "secret", 0)], FIELDS))


def test_ingest_search_delete(spark, store):
    a = spark.createDataFrame([("d1", "v1", "j", [], None), ("d1", "v2", "j", [], None)], ANALYSIS)
    store.ingest("d1", a, spark.createDataFrame([chunk("one"), chunk("two", "v2", vec=(0.6, 0.8)), chunk("hidden", vis="staff")], CHUNK))
    store.ingest("d1", a.where("video_id = 'v1'"), spark.createDataFrame([chunk("one again", vec=(0.9, 0.1))], CHUNK))
    texts = lambda **k: [r.text for r in S.search(store.read("chunks"), [1.0, 0.0], **k).collect()]
    assert texts() == ["one again", "two"] and texts(dog_id="x") == [] and texts(k=1) == ["one again"]
    store.ingest("d1", a.where("video_id = 'v1'"), spark.createDataFrame([], CHUNK))
    assert texts() == ["one again", "two"] and store.read("video_analysis").count() == 2
    store.replace_traits("d1", spark.createDataFrame([chunk("trait", None, "L1")], CHUNK))
    assert texts()[0] == "trait"
    store.replace_traits("d1", spark.createDataFrame([], CHUNK))
    assert texts() == ["one again", "two"]
    with pytest.raises(ValueError, match="parent"):
        store.replace_traits("dx", spark.createDataFrame([chunk("x", None, "L1", dog="dx")], CHUNK))
    store.delete("d1")
    assert store.read("chunks").count() == 0 and store.read("dogs").count() == 0


def test_search_ties_and_bad_vectors(spark):
    c = spark.createDataFrame([(3, "public", [1.0, 0.0]), (1, "public", [2.0, 0.0]), (2, "public", [0.0, 0.0]), (4, "public", None), (5, "public", [1.0])], "id long, vis string, embedding array<float>")
    assert [(r.id, r.score) for r in S.search(c, [1.0, 0.0]).collect()] == [(1, 1.0), (3, 1.0), (2, None), (4, None), (5, None)]
    plan = S.search(c, [1.0, 0.0])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_gate_tags_claims(spark):
    with pytest.raises(RuntimeError, match="v9"):
        S.ingest_gate(spark.createDataFrame([(["v9"],)], "foster_uncertain array<string>"))
    S.ingest_gate(spark.createDataFrame([([],)], "foster_uncertain array<string>"))
    tags = lambda rows: spark.createDataFrame(rows, "video_id string, tags array<string>")
    got = {r.video_id: r.tags for r in S.scene_tags(tags([("a", ["x"]), ("b", ["y"])]), tags([("a", ["h"]), ("_c", ["z"])]), tags([("q", ["w"])])).collect()}
    assert got == {"a": ["h"], "b": ["y"]} and S.scene_tags(tags([]), tags([]), tags([("q", ["w"])])).count() == 1
    claims = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k long, claim string")
    rec = spark.createDataFrame([(1, "a"), (1, "c")], "k long, record string")
    ok = F.col("claim") == F.col("record")
    assert {(r.k, r.claim): r.supported for r in S.verified(claims, rec, ok, ["k"]).collect()} == {(1, "a"): True, (1, "b"): False, (2, "a"): False}
    assert {(r.k, r.claim): r.supported for r in S.verified_everywhere(claims, rec, ok, ["k"]).collect()} == {(1, "a"): False, (1, "b"): False, (2, "a"): True}


def test_vectors(spark):
    d = spark.createDataFrame([([0.123456789, -12345678.0, 0.0],)], "v array<double>")
    assert d.select(V.six_digits(F.col("v"))).first()[0] == pytest.approx([0.123457, -12345700.0, 0.0])
    m = spark.createDataFrame([(1, [3.0, 4.0]), (1, [4.0, 3.0])], "k long, v array<double>")
    assert V.mean_pool(m, ["k"], "v").first().pooled == pytest.approx([0.5**0.5] * 2, abs=1e-6)
    z = spark.createDataFrame([([], [1.0])], "a array<double>, b array<double>")
    assert tuple(z.select(V.cosine(F.col("a"), F.col("b")), V.cosine_or_zero(F.col("a"), F.col("b"))).first()) == (None, 0.0)


def test_external(spark, tmp_path):
    log = str(tmp_path / "calls")

    def backend():
        def f(xs):
            with open(log, "a") as out:
                out.write("".join(f"{x}\n" for x in xs))
            return [x.upper() for x in xs]

        return f

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], "i long, t string")
    cache = spark.createDataFrame([("c", "kept")], "t string, up string")
    got = {r.i: r.up for r in E.call(df, "t", "up", "string", backend, cache).collect()}
    assert got == {1: "A", 2: "A", 3: "B", 4: None, 5: "kept"} and sorted(open(log).read().split()) == ["a", "b"]
    v = E.embed_texts(df, "t", 8).collect()
    assert all(len(r.embedding) == 8 for r in v if r.t)
    with pytest.raises(Exception, match="length 8"):
        E.embed_texts(df, "t", 4, backend=lambda: E.stub_embed(8)).collect()
    calls = []

    def flaky(xs):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return xs

    assert E._answer(flaky, ["x"], 3) == ["x"]
    lp = spark.createDataFrame([([("yes", -0.1), ("no", -3.0)],), ([("no", -0.1)],), ([],)], "a array<struct<class:string,logprob:double>>")
    assert [r[0] for r in lp.select(E.supported(F.col("a"))).collect()] == [True, False, True]
    claims = spark.createDataFrame([("good",), ("bad",), ("worse",)], "c string")
    out = E.verify_and_rewrite(claims, lambda d: d.withColumn("supported", F.col("c").contains("good")), lambda d: d.withColumn("c", F.when(F.col("c") == "bad", "good now").otherwise(F.col("c"))))
    assert sorted(r.c for r in out.collect()) == ["good", "good now"]
