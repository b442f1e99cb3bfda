"""Where models are trained."""

import numpy as np

from tessera.llm import toxicity


def test_toxicity_trains_on_an_executor(spark, monkeypatch):
    """Training needs more memory than the model: a task has it, the driver only gets the model, the one that fit() makes of the rows by id."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 61}" for j in range(30)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen = sorted(r.doc_id for r in labels.filter(~toxicity.held_out("doc_id")).collect())
    want = toxicity.fit([rows[i][1] for i in seen], [rows[i][2] for i in seen])
    nothing = toxicity.fit([], [])
    with monkeypatch.context() as here:
        here.setattr(toxicity.Network, "backward", None)  # in the driver's process only
        here.setattr(type(docs), "toPandas", None)
        got = toxicity.train(docs, labels)
        empty = toxicity.train(docs.filter("false"), labels)
    texts = [r[1] for r in rows] + ["", "vile w3"]
    assert np.allclose(got.score(texts), want.score(texts), atol=1e-4)
    assert np.allclose(empty.score(texts), nothing.score(texts))
