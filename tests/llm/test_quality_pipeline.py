import random
import zlib

import numpy as np
import pytest

from leafmill.llm import quality

from .helpers import DOCS, cases, wide

LABELS = "doc_id long, quality int, toxic int"


def _corpus(n=240):
    rng = random.Random(6)
    words = "the of and river stone quiet morning walked toward garden house letter winter"
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words.split()) + ("" if good else rng.choice(["!!!", "###", "$$$"])) for _ in range(rng.randint(20, 300)))
        rows.append((i, text + "."))
        labels.append((i, int(good), 0))
    return rows, labels


def test_classifier_holds_out_and_learns(spark):
    rows, labels = _corpus()
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    for i, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)
    held = [i for i, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) >= 0.95
    # labels of held-out documents make no difference
    flipped = [(i, 1 - q if got[i].held_out else q, t) for i, q, t in labels]
    again = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(flipped, LABELS)).collect()
    assert all(abs(r.score - got[r.doc_id].score) < 1e-9 for r in again)


def test_scores_against_a_plain_forward_pass(spark):
    """The registered score, number by number, from passages made one at a time."""
    rows, labels = _corpus(60)
    rows += [(500, None), (501, ""), (502, "word " * 70_000), (503, "x" * 100_000)]
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.train(docs, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r.score for r in quality.score(docs.repartition(3), model).collect()}
    p, sigmoid = model.p, lambda v: 1 / (1 + np.exp(-v))
    for i, text in rows:
        encoded, weight = [], []
        for x in quality.Passages()(text or ""):
            h = np.tanh(np.clip((x.astype(float) - model.mean) / model.scale, -8, 8) @ p["W"] + p["b"])
            encoded.append(h)
            weight.append(np.exp((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"])[0])
        z = sum(w * h for w, h in zip(weight, encoded)) / sum(weight)
        assert got[i] == pytest.approx(sigmoid(z @ p["c"] + p["d"])[0], abs=1e-6)


def test_every_passage_of_a_labelled_text_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, parts: seen.extend(len(b) for bags, _ in parts() for b in bags) or self)
    docs = spark.createDataFrame([(i, "word " * (64 * n)) for i, n in ((1, 3), (2, 90), (3, 400))], DOCS)
    quality.train(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], LABELS))
    of = {i: n for i, n in ((1, 3), (2, 90), (3, 400)) if zlib.crc32(str(i).encode()) % 5}
    assert sorted(seen) == sorted(of.values()) and max(seen) > 64


def test_long_labelled_texts_are_fitted_part_by_part(spark, monkeypatch):
    """Texts of 20,000 words, a few of them at a time: all are met in every round, and the model still tells them apart."""
    rows, labels = _corpus(60)
    rows = [(i, (t + " ") * (20_000 // max(1, len(t.split())))) for i, t in rows]
    docs, marks, met = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), []
    fit = quality.Model.fit

    def counted(self, parts, **how):
        def seen():
            for bags, y in parts():
                met.append(sum(b.nbytes for b in bags))
                yield bags, y

        return fit(self, seen, **how)

    monkeypatch.setattr(quality.Model, "fit", counted)
    model = quality.train(docs, marks, part=400_000)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    marked = {i: q for i, q, _ in labels if i in got}
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, q in marked.items()]) >= 0.95
    n = len(met) // 32  # two passes for the scale and 30 rounds
    assert n > 3 and met == met[:n] * 32 and max(met) < 3_000_000


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    model = quality.Model(5, 4, 3)
    x, starts, y = rng.standard_normal((9, 5)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        s, _ = model.forward(x, starts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    score, kept = model.forward(x, starts)
    for name, g in model.gradient(kept, starts, score, y).items():
        p = model.p[name]
        for at in list(np.ndindex(p.shape))[:6]:
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_classifier_of_every_case(spark):
    docs = wide(spark, cases())
    labels = spark.createDataFrame([(1, 1, None), (5, 0, 0), (7, None, 1), (None, 1, 1), (8, 1, 0), (8, 0, 0), (999, 0, 0)], LABELS)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(cases()) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.without_rejected(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_passages_cover_the_whole_text():
    of = quality.Passages()
    text = " ".join(f"word{k % 50}" for k in range(64 * 300 + 40))
    vectors = of(text)
    assert len(vectors) == 301 and np.isfinite(vectors).all()
    assert of("").shape == (1, quality.WIDTH) and not np.array_equal(of("tail " + text), of("text " + text))


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels = _corpus(160)
    line = "\nfirst shared line of text\nsecond shared line of text\nthird shared line of text"
    rows = [(i, t + line if i % 10 == 3 else t) for i, t in rows] + [(1000 + i, rows[0][1]) for i in range(5)]
    rows += [(2000, None), (2001, ""), (2002, "pay with 4111111111111111 quiet morning in the garden house today")]
    wide(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert docs.columns == names
        sizes.append(docs.count())
        if name == "quality classifier":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            wrong = [i for i, q, _ in labels if (i in kept) != bool(q)]
            assert len(wrong) <= 4
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    of = {r.doc_id: r.text for r in docs.collect()}
    assert "4111111111111111" not in of.get(2002, "")
    assert sum("second shared line" in (t or "") for t in of.values()) == 1
    assert len({t for i, t in of.items() if i >= 1000 and i < 2000}) == 0
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.select("doc_id").collect()} == set(of)
