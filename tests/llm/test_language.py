import numpy as np

from treeledger.llm import langid
from treeledger.llm.langid import Training


def test_held_out_accuracy(spark, small_dir):
    folder = small_dir.parent / "sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = langid.predicted(docs, langid.learned(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 150 and (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all() and found.agreement.between(0, 1).all()


def test_gradients_by_differences():
    """Backpropagation through time equals small differences of the loss."""
    rng = np.random.default_rng(0)
    h, steps, n = 3, 6, 4
    ways = [[rng.standard_normal(s) * 0.5 for s in ((256, 3 * h), (h, 2 * h), (h, h))] for _ in range(2)]
    out = [rng.standard_normal((2 * h, 3)), rng.standard_normal(3)]
    text, truth = rng.integers(0, 256, (steps, n)).astype(np.uint8), np.array([0, 1, 2, 0])

    def loss():
        states = [langid.read(text, ways[0], range(steps)).astype(float), langid.read(text, ways[1], range(steps)[::-1]).astype(float)]
        return -np.log(langid.probabilities(states, out)[:, np.arange(n), truth]).sum()

    trace = []
    states = [langid.read(text, ways[0], range(steps), trace), langid.read(text, ways[1], range(steps)[::-1])]
    error = langid.probabilities([s.astype(float) for s in states], out)
    error[:, np.arange(n), truth] -= 1
    grads = langid.back(ways[0], trace, text, error @ out[0][:h].T)
    for weights, grad in zip(ways[0], grads):
        for spot in [(int(text[2, 1]), 4) if len(weights) == 256 else (1, 2)]:
            weights[spot] += 1e-2
            up = loss()
            weights[spot] -= 2e-2
            down = loss()
            weights[spot] += 1e-2
            assert abs((up - down) / 2e-2 - grad[spot]) < 2e-2 * max(1, abs(grad[spot]))


def test_edges(spark):
    rows = [(k, "the cat and the dog of the house " * 3, "en", 1) for k in range(30)] + [(100 + k, "der Hund und die Katze über das Haus " * 3, "de", 2) for k in range(30)]
    rows += [(200, None, "en", 3), (201, "", "de", 4), (202, "12 34 !?", "en", 5), (None, "und der Hund und die Katze", None, 6), (203, "the house " * 30_000, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = langid.learned(docs, Training(epochs=30, batch=8))
    got = {r.doc_id: r for r in langid.predicted(docs, net).collect()}
    assert [got[k].lang_pred for k in (200, 201, 202, None, 203, 1, 101)] == ["und"] * 3 + ["de", "en", "en", "de"]
    assert got[200].score == 0 and got[202].score == 0
    kept = langid.accepted(docs, net)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    none = langid.learned(docs.limit(0))
    assert none is None and {r.lang_pred for r in langid.predicted(docs, none).collect()} == {"und"}
    assert langid.predicted(docs.limit(0), net).count() == 0 and langid.accepted(docs, none).count() == 0


def test_learns_from_text_and_language_alone(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    from pyspark.sql import functions as F

    plain = langid.training_sample(docs)
    assert plain == langid.training_sample(docs.withColumn("doc_id", -F.col("doc_id")).withColumn("source", F.lit("x")))


def test_a_language_of_mostly_one_text_is_learned(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'en', 'de') AS lang", "IF(id % 2 = 0, IF(id < 40, concat('an english text ', id), 'the same english text'), concat('ein deutscher text ', id)) AS text")
    sample = langid.training_sample(docs)
    found = {lang: sum(1 for x, _ in sample if x == lang) for lang in ("en", "de")}
    assert found["en"] == 21 and found["de"] == langid.Training().per_language
