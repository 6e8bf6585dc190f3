"""The language model of ``op7_language`` and of the pipeline's first stage learns from every row with a language."""

import random

from strandline.llm import langid


def words(rng, letters):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(30)]


def test_rows_beyond_any_sample_are_learnt(spark):
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {k: words(rng, letters) for k in ("aa", "bb")}
    rows = [(k, " ".join(rng.choice(own[k]) for _ in range(8))) for k in own for _ in range(6000)]
    # Each of these has words of its own, so only who has read the row itself knows its language.
    alone = [("ab"[i % 2] * 2, " ".join(words(rng, letters)[:12])) for i in range(300)]
    rare = [("cc", " ".join(rng.choice(letters.upper()[:3] + "éü") * 5 for _ in range(8))) for _ in range(3)]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows + alone + rare)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.model.classes == ["aa", "bb", "cc"]
    out = {r.doc_id: r.lang_pred for r in langid.predict(df.where(f"doc_id >= {len(rows)}"), model).collect()}
    right = [out[len(rows) + i] == k for i, (k, _) in enumerate(alone)]
    assert sum(right) >= 2 / 3 * len(right) and [out[i] for i in range(len(rows) + len(alone), len(rows) + len(alone) + 3)] == ["cc"] * 3
    # The model does not follow the order or the number of parts of the rows.
    again = langid.train(df.repartition(7, "text"))
    assert (again.model.table == model.model.table).all() and (again.model.temperature, again.reject_below) == (model.model.temperature, model.reject_below)
